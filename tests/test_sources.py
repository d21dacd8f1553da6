"""Readers on small files of our own, with the traps each format has."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from meterline.operators.dedup import changed_files, keep_first
from meterline.sources import fleet, ledgers, lines, snapshots, transcripts
from meterline.schemas import KNOWN_AGENTS

AT = "2026-02-17T11:06:42.318Z"
AT_MS = 1771326402318
TOKENS = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")


def write(path, rows, end="\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, separators=(",", ":")) for r in rows) + end)
    return path


def tokens(row):
    return tuple(row[c] for c in TOKENS)


def claude_row(mid, request="r", usage=(1, 2, 3, 4), **more):
    row = {"type": "assistant", "timestamp": AT, "sessionId": "s", "cwd": "/w/a", "requestId": f"{request}{mid}",
           "message": {"id": mid, "model": "claude-fable-5", "usage": dict(zip(
               ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens"), usage))}}
    row.update(more)
    return row


def test_claude_skips_noise_and_dedups_over_files(spark, tmp_path):
    no_usage = claude_row("m3")
    del no_usage["message"]["usage"]
    no_id = claude_row("m4")
    del no_id["message"]["id"]
    synthetic = claude_row("m5")
    synthetic["message"]["model"] = "<synthetic>"
    write(tmp_path / "a/one.jsonl", [
        "", "not json", '{"type":"assistant"', '[{"type":"assistant"}]', "42", '"type":"assistant"',
        {"type": "user", "sample": {"type": "assistant"}}, no_usage, no_id, synthetic,
        claude_row("m6", timestamp="not-a-timestamp"), claude_row("m1"), claude_row("m1"),
        claude_row("m2", usage=("7", 2.5, -3, True), cwd=None)])
    write(tmp_path / "b/two.jsonl", [claude_row("m1"), claude_row("m7", usage=(7, 3, 2, 1))])
    events = keep_first(transcripts.claude(lines.read_log(spark, str(tmp_path)))).collect()
    got = {r["dedup_key"]: tokens(r) for r in events}
    assert got == {"m1:rm1": (1, 2, 3, 4), "m2:rm2": (0, 0, 0, 0), "m7:rm7": (7, 3, 2, 1)}
    assert {r["ts_ms"] for r in events} == {AT_MS}


def codex_reading(i, cached, o, ts=AT, **payload):
    return {"timestamp": ts, "type": "event_msg", "payload": {"type": "token_count", "info": {
        "total_token_usage": {"input_tokens": i, "cached_input_tokens": cached, "output_tokens": o}}, **payload}}


LIMITS = {"primary": {"used_percent": 12.5, "resets_at": 1772618400},
          "secondary": {"used_percent": 3, "resets_at": None}, "plan_type": "pro"}


def test_codex_differences_and_resets(spark, tmp_path):
    name = "rollout-2025-7d3e9b52-c04f-4a86-91be-2f60d8a713c5.jsonl"
    write(tmp_path / name, [
        codex_reading(100, 60, 10),
        {"timestamp": AT, "type": "session_meta", "payload": {"session_id": "sess", "cwd": "/w/x"}},
        {"timestamp": AT, "type": "turn_context", "payload": {"model": "gpt-5.2-codex", "cwd": "/w/y"}},
        codex_reading(300, 200, 30, rate_limits=LIMITS), codex_reading(300, 200, 30),
        codex_reading("nope", 0, 99), codex_reading(-5, 0, 99), codex_reading(400, 200, 40, ts="bad"),
        codex_reading(350, 190, 45),
        {"timestamp": AT, "type": "event_msg", "payload": {"type": "token_count", "info": None, "rate_limits": LIMITS}}])
    log = lines.read_log(spark, str(tmp_path))
    events = transcripts.codex(log).orderBy("line_seq").collect()
    assert [tokens(r) for r in events] == [(40, 10, 0, 60), (60, 20, 0, 140), (160, 45, 0, 190)]
    assert [(r["session_id"], r["model"], r["cwd"]) for r in events] == [
        ("7d3e9b52-c04f-4a86-91be-2f60d8a713c5", "codex", ""), ("sess", "gpt-5.2-codex", "/w/y"),
        ("sess", "gpt-5.2-codex", "/w/y")]
    limits = transcripts.codex_limits(log).collect()
    assert len(limits) == 2 and limits[0]["plan"] == "pro"
    assert [(w["kind"], w["used_percent"], w["resets_at_ms"]) for w in limits[0]["windows"]] == [
        ("five_hour", 12.5, 1772618400000), ("weekly", 3.0, 0)]


@pytest.mark.parametrize("split", ["64", "128m"])
def test_codex_is_the_same_however_the_file_is_split(spark, tmp_path, split):
    rows = [{"timestamp": AT, "type": "turn_context", "payload": {"model": "m1"}}]
    total = 0
    for i in range(200):
        total = total + i if i % 41 else 1
        rows.append(codex_reading(total, 0, i // 7))
        if i % 50 == 49:
            rows.append({"timestamp": AT, "type": "turn_context", "payload": {"model": f"m{i}"}})
    write(tmp_path / "rollout.jsonl", rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split if split.endswith("m") else "2048")
    try:
        log = lines.read_log(spark, str(tmp_path))
        if not split.endswith("m"):
            assert log.select("line_start").distinct().count() > 5
        got = transcripts.codex(log).orderBy("line_start", "line_seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want, base, model = [], (0, 0), None
    for row in rows:
        if row["type"] == "turn_context":
            model = row["payload"]["model"]
            continue
        usage = row["payload"]["info"]["total_token_usage"]
        now = (usage["input_tokens"], usage["output_tokens"])
        delta = now if now[0] < base[0] or now[1] < base[1] else (now[0] - base[0], now[1] - base[1])
        base = now
        if any(delta):
            want.append((model, *delta))
    assert [(r["model"], r["input_tokens"], r["output_tokens"]) for r in got] == want


def test_unterminated_line_is_held_back(spark, tmp_path):
    write(tmp_path / "open.jsonl", [claude_row("a"), claude_row("b")], end="")
    write(tmp_path / "closed.jsonl", [claude_row("c"), claude_row("d")])
    (tmp_path / "bom.jsonl").write_bytes(b"\xef\xbb\xbf" + (json.dumps(claude_row("e"), separators=(",", ":")) + "\n").encode() * 2)
    (tmp_path / "crlf.jsonl").write_bytes((json.dumps(claude_row("f"), separators=(",", ":")) + "\r\n").encode())
    events = transcripts.claude(lines.read_log(spark, str(tmp_path)))
    assert sorted(r["dedup_key"] for r in events.collect()) == ["a:ra", "c:rc", "d:rd", "e:re", "e:re", "f:rf"]


def test_pi_gemini_qwen_kimi(spark, tmp_path):
    usage = {"input": 731, "output": 58, "cacheRead": 2222, "cacheWrite": 91, "reasoning": 6}
    message = {"type": "message", "id": "x1", "timestamp": AT, "message": {"role": "assistant", "model": "gpt-5.5", "usage": usage}}
    write(tmp_path / "pi/2026_sess-1.jsonl", [
        {"type": "session", "id": "h", "timestamp": AT, "cwd": "/w/pi"}, message, "junk {{{",
        {"type": "message", "id": "u", "timestamp": AT, "message": {"role": "user"}}])
    write(tmp_path / "pi/2027_fork.jsonl", [message])
    pi = keep_first(transcripts.pi(lines.read_log(spark, str(tmp_path / "pi")))).collect()
    assert [(tokens(r), r["session_id"], r["cwd"], r["dedup_key"]) for r in pi] == [
        ((731, 58, 91, 2222), "sess-1", "/w/pi", f"x1:{AT_MS}")]

    counted = {"id": "m2", "timestamp": AT, "type": "gemini", "model": "gemini-2.5-pro",
               "tokens": {"input": 8008, "output": 212, "cached": 3001, "thoughts": 77, "tool": 19}}
    write(tmp_path / "g/session-abc.jsonl", [
        counted, {"sessionId": "head", "kind": "metadata"}, {k: v for k, v in counted.items() if k != "tokens"},
        counted, counted, {"$set": {"tokens": 1}}])
    gemini = keep_first(transcripts.gemini(lines.read_log(spark, str(tmp_path / "g")))).orderBy("line_seq").collect()
    assert [(tokens(r), r["session_id"]) for r in gemini] == [((5007, 289, 0, 3001), "abc"), ((5007, 289, 0, 3001), "head")]

    row = {"uuid": "u1", "sessionId": "q", "timestamp": AT, "type": "assistant", "cwd": "/w/q", "model": "qwen3",
           "usageMetadata": {"promptTokenCount": 10, "candidatesTokenCount": 5, "cachedContentTokenCount": 20, "thoughtsTokenCount": 1}}
    write(tmp_path / "q/file.jsonl", [row, row, {**row, "uuid": "u2", "sessionId": "", "cwd": "/w/other"}, {**row, "type": "user"}])
    qwen = keep_first(transcripts.qwen(lines.read_log(spark, str(tmp_path / "q")))).orderBy("line_seq").collect()
    assert [(tokens(r), r["session_id"], r["cwd"]) for r in qwen] == [
        ((0, 6, 0, 20), "q", "/w/q"), ((0, 6, 0, 20), "file", "/w/other")]

    def status(ts, mid, usage):
        return {"timestamp": ts, "message": {"type": "StatusUpdate", "payload": {"message_id": mid, "token_usage": usage}}}

    use = {"input_other": 913, "output": 31, "input_cache_read": 4040, "input_cache_creation": 77}
    wire = [status(1771326402.25, "m1", use), status(1771326403.0, "m2", None), status(1.0, None, use), status(1e13, "m3", use)]
    write(tmp_path / "k/h/sess/wire.jsonl", wire)
    write(tmp_path / "k/h/sess/context.jsonl", wire)
    kimi = transcripts.kimi(lines.read_log(spark, str(tmp_path / "k"))).collect()
    assert [(tokens(r), r["session_id"], r["ts_ms"]) for r in kimi] == [((913, 31, 77, 4040), "sess", 1771326402250)]


def test_rewritten_documents(spark, tmp_path):
    (tmp_path / "c").mkdir()
    metrics = {"inputTokens": 10, "outputTokens": 2, "cacheReadTokens": 3, "cacheWriteTokens": -4}
    (tmp_path / "c/s1.messages.json").write_text(json.dumps({"version": 1, "sessionId": "", "messages": [
        {"id": "a", "ts": 5, "modelInfo": {"id": "m"}, "metrics": metrics}, {"id": "b", "ts": 6},
        {"id": "z", "ts": 7, "metrics": {"inputTokens": 0}}, {"ts": 8, "metrics": metrics}]}, indent=2))
    got = snapshots.cline_messages(lines.whole_files(spark, str(tmp_path / "c"), "*.messages.json")).collect()
    assert [(r["key"], tokens(r), r["model"], r["session_id"]) for r in got] == [("a", (10, 2, 0, 3), "m", "s1")]

    (tmp_path / "t/task9").mkdir(parents=True)
    text = json.dumps({"tokensIn": 3310, "tokensOut": 271, "cacheWrites": 815, "cacheReads": 6007, "cost": 1})
    (tmp_path / "t/task9/ui_messages.json").write_text(json.dumps([
        {"ts": 1, "type": "say", "say": "task", "text": "x"}, {"ts": 2, "type": "say", "say": "api_req_started", "text": text},
        {"ts": 3, "type": "say", "say": "api_req_started", "text": "{broken"},
        {"ts": 4, "type": "say", "say": "deleted_api_reqs", "text": text},
        {"ts": 5, "type": "say", "say": "api_req_started", "text": '{"tokensIn": {"n": 4}, "tokensOut": 2}'},
        {"ts": 6, "type": "say", "say": "api_req_started", "text": '{"tokensIn": 3, "cacheReads": true}'}], indent=1))
    got = snapshots.task_messages(lines.whole_files(spark, str(tmp_path / "t"), "ui_messages.json"), "roo").collect()
    assert [(r["key"], tokens(r), r["session_id"]) for r in got] == [
        ("2", (3310, 271, 815, 6007), "task9"), ("4", (3310, 271, 815, 6007), "task9")]


def database(path, *statements):
    db = sqlite3.connect(path)
    for statement in statements:
        db.execute(statement)
    db.commit()
    db.close()
    return str(path)


def test_goose_ledger(spark, tmp_path):
    path = database(
        tmp_path / "g.db",
        "CREATE TABLE usage_ledger (session_id TEXT, created_timestamp INTEGER, model TEXT, input_tokens INTEGER, "
        "output_tokens INTEGER, cache_read_tokens INTEGER, cache_write_tokens INTEGER)",
        "INSERT INTO usage_ledger VALUES ('s',1700000000,'m',10,5,3,2),('s',1700000001,'m',0,0,0,0),"
        "(NULL,1700000002,'m',1,1,1,1),('s',1700000003,'m',NULL,-4,7,0),('t',1700000004,'n',1,0,0,0)")
    rows = ledgers.goose_rows(spark, path)
    got = ledgers.goose(rows).orderBy("row_id").collect()
    assert [(tokens(r), r["ts_ms"]) for r in got] == [
        ((10, 5, 2, 3), 1700000000000), ((0, 0, 0, 7), 1700000003000), ((1, 0, 0, 0), 1700000004000)]
    assert ledgers.goose(rows, above_row=4).count() == 1
    split = ledgers.read_table(spark, path, "usage_ledger", {"model": "model : string"}, rows_per_task=2)
    assert split.rdd.getNumPartitions() == 3 and split.count() == 5


def test_kilo_and_opencode_ledgers(spark, tmp_path):
    def message(i, data, at=1000):
        return f"INSERT INTO message VALUES ('m{i}','s1',{at},{at + 1},'{data if isinstance(data, str) else json.dumps(data)}')"

    layout = ("CREATE TABLE message (id TEXT, session_id TEXT, time_created INTEGER, time_updated INTEGER, data TEXT)",)
    full = {"role": "assistant", "model": {"id": "opus"}, "tokens": {"input": 100, "output": 20, "reasoning": 7, "cache": {"read": 30, "write": 4}}}
    kilo = database(tmp_path / "kilo.db", *layout, "CREATE TABLE session (id TEXT, model TEXT)",
                    "INSERT INTO session VALUES ('s1','{\"id\":\"sonnet\"}')", message(1, full),
                    message(2, {"role": "assistant", "tokens": {"input": 50}}), message(3, {"role": "user"}),
                    message(4, "{bad"), "INSERT INTO message VALUES ('m5','none',1,1,'{\"role\":\"assistant\",\"tokens\":{\"input\":1}}')")
    got = ledgers.kilo(*ledgers.kilo_rows(spark, kilo)).orderBy("id").collect()
    assert [(r["id"], r["model"], tokens(r)) for r in got] == [("m1", "opus", (100, 27, 4, 30)), ("m2", "sonnet", (50, 0, 0, 0))]

    v1 = {"role": "assistant", "modelID": "gpt", "time": {"created": 1100, "completed": 1900}, "tokens": {"input": 10, "output": 20, "reasoning": 3, "cache": {"read": 40, "write": 5}}}
    database(tmp_path / "oc1.db", *layout, "CREATE TABLE session (id TEXT, directory TEXT)",
             "INSERT INTO session VALUES ('s1','/work')", message(1, v1), message(2, "{bad"),
             message(3, {**v1, "tokens": {"input": -1}}), message(4, {**v1, "tokens": {"input": 1.5}}))
    database(tmp_path / "oc2.db", *layout, "CREATE TABLE session (id TEXT, directory TEXT)",
             "INSERT INTO session VALUES ('s1','/next')", message(9, v1),
             "CREATE TABLE session_message (id TEXT, session_id TEXT, type TEXT, time_created INTEGER, time_updated INTEGER, data TEXT)",
             "INSERT INTO session_message VALUES ('n1','s1','assistant',3000,4000,'" + json.dumps({"model": {"id": "sonnet"}, "tokens": {"input": 7}}) + "')",
             "INSERT INTO session_message VALUES ('n2','s1','user',3000,4000,'{}')")
    got = ledgers.opencode(*ledgers.opencode_rows(spark, str(tmp_path / "oc*.db"))).orderBy("key").collect()
    assert [(r["key"], r["model"], tokens(r), r["ts_ms"], r["cwd"]) for r in got] == [
        ("m1", "gpt", (10, 23, 5, 40), 1900, "/work"), ("n1", "sonnet", (7, 0, 0, 0), 3000, "/next")]


def test_quota_response(spark):
    body = json.dumps({"five_hour": {"utilization": 40, "resets_at": AT}, "seven_day": None,
                       "seven_day_opus": {"utilization": 1.5, "resets_at": None}, "other": 1})
    df = spark.createDataFrame([(1, 99, "max", body), (2, 100, "max", "not json")], "seq bigint, read_at_ms bigint, plan string, body string")
    rows = snapshots.quota_responses(df).filter(F.size("windows") > 0).collect()
    assert [[(w["kind"], w["used_percent"], w["resets_at_ms"]) for w in r["windows"]] for r in rows] == [
        [("five_hour", 40.0, AT_MS), ("weekly_opus", 1.5, 0)]]


def test_fleet_goes_on_without_a_broken_source(spark, tmp_path):
    write(tmp_path / "c/a.jsonl", [claude_row("m1")])
    write(tmp_path / "x/rollout-a.jsonl", [codex_reading(5, 0, 1)])
    paths = {"claude": str(tmp_path / "c"), "codex": str(tmp_path / "x"), "qwen": str(tmp_path / "missing"), "pi": str(tmp_path / "c")}
    events, status = fleet.sweep(spark, paths, ["claude", "codex", "qwen"])
    assert {r["agent"] for r in events.collect()} == {"claude", "codex"}
    assert {r["agent"]: r["ok"] for r in status.collect()} == {"claude": True, "codex": True, "qwen": False}
    assert set(fleet.SOURCES) < set(KNOWN_AGENTS)


def test_file_gate_and_corpus_size(spark, tmp_path):
    write(tmp_path / "a.jsonl", ["x"])
    write(tmp_path / "b.jsonl", ["yy"])
    listed = lines.listing(spark, str(tmp_path), "*.jsonl")
    assert tuple(lines.corpus_size(spark, str(tmp_path)).first()) == (2, 5)
    known = spark.createDataFrame(listed.filter(F.col("path").endswith("a.jsonl")).collect(), listed.schema)
    assert [r["path"][-7:] for r in changed_files(listed, known).collect()] == ["b.jsonl"]


def test_logs_stream_into_the_cube(spark, tmp_path):
    from meterline.operators import cube
    from meterline.streaming import cube_stream

    def run():
        cube_stream.append_cube(
            lines.stream_log(spark, str(tmp_path / "in")), str(tmp_path / "cube"), str(tmp_path / "ck"),
            keyed=True, parse=transcripts.claude).awaitTermination()
        total = cube.query(cube.read_tier(spark, str(tmp_path / "cube"), "day"), ["project"]).collect()
        return {r["project"]: (r["input_tokens"], r["events"]) for r in total}

    write(tmp_path / "in/a.jsonl", [claude_row("m1"), claude_row("m2", cwd="/w/a/.claude/worktrees/x")])
    assert run() == {"/w/a": (2, 2)}
    write(tmp_path / "in/b.jsonl", [claude_row("m2"), claude_row("m3", usage=(5, 0, 0, 0)), claude_row("m3", usage=(5, 0, 0, 0))])
    assert run() == {"/w/a": (7, 3)}


def test_task_requests_with_odd_counters_are_none_however_they_are_written(spark):
    texts = {
        1: '{"request":"plain","tokensIn":5}',
        2: '{"tokensIn":5,"tokensOut":{"a":1}}',
        3: '{"tokensIn":5,"cacheReads":[1]}',
        4: '{"tokensIn":5,"cacheWrites":true}',
        5: '{"tokensIn":5,"tokensOut":"false"}',
        6: '{"tokensIn":5,"tokensOut":"\\u007bx"}',  # a brace that only shows once the text is read
        7: '{"request":"a { b [ true","tokensIn":5}',
        8: ' {"tokensIn":5,"tokensOut":"truely"}',
        9: '{"request":"\\\\","tokensIn":5}',
    }
    value = json.dumps([{"ts": ts, "type": "say", "say": "api_req_started", "text": t} for ts, t in texts.items()])
    files = spark.createDataFrame([(value, "/t/s/ui_messages.json")], "value string, source_file string")
    found = snapshots.task_messages(files, "roo")
    assert sorted((r["ts_ms"], r["input_tokens"]) for r in found.collect()) == [(1, 5), (7, 5), (8, 5), (9, 5)]
    # Texts that cannot hold an odd value are not parsed once more for every counter.
    assert "CASE WHEN" in found._jdf.queryExecution().optimizedPlan().toString().partition("get_json_object")[0]


def test_all_sources_read_the_events_and_their_json_once(spark, tmp_path):
    from meterline.catalog import QUERIES

    spark.range(40).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id) AS ts", "id % 3 AS user_id",
        "'click' AS event_type", "double(id + 1) AS value", "concat('{\"k\": ', id, '}') AS props").write.parquet(str(tmp_path / "events.parquet"))
    found = QUERIES["all_sources"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object(props" not in plan and "props#" not in plan
    events = {r["agent"]: r["events"] for r in found.collect()}
    assert events["pi"] == sum(k % 10 != 0 for k in range(40)) and events["roo"] == sum(k % 5 != 2 for k in range(40))

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from meterline.llm import chat

LOG = "conv_id long, seq long, turn long, kind string, role string, text string"
CODES = [("\\", "\\s"), ("###", "\\h"), ("</turn>", "\\t")]


def low(x):
    return (x is not None, x if x is not None else 0)


def begins(e):
    return e[3] != "delta"


def brute(log):
    """Step through each conversation's events in order."""
    out = {}
    for conv in {e[0] for e in log}:
        events = sorted((e for e in log if e[0] == conv), key=lambda e: (low(e[1]), not begins(e), e[4] or "", e[5] or ""))
        left = []
        for e in events:
            if e[3] in ("edit", "regenerate") and e[1] is not None:
                left = [x for x in left if low(x[2]) < low(e[2]) or (x[1] is not None and x[1] >= e[1])]
            left.append(e)
        messages = []
        for turn in sorted({e[2] for e in left}, key=low):
            first = True
            for e in (x for x in left if x[2] == turn):
                if begins(e) or first:
                    messages.append([e[4] or "", ""])
                messages[-1][1] += e[5] or ""
                first = False
        out[conv] = [tuple(m) for m in messages]
    return out


def rendered(messages):
    text, spans = "", []
    for role, body in messages:
        for plain, code in CODES:
            role, body = role.replace(plain, code), body.replace(plain, code)
        text += "### " + role.replace(":", "\\c") + ": "
        if role == "assistant":
            spans.append((len(text), len(body), len(text.encode()), len(body.encode())))
        text += body + "</turn>\n"
    return text, spans


def run(spark, log, **parameters):
    frame = spark.createDataFrame(log, LOG).repartition(3).withColumns({"formatted": F.lit("clash"), "_cut": F.lit(1)})
    samples = chat.format_chats(frame, **parameters).withColumns({
        "back": chat.read_back(F.col("formatted")), "loss": chat.loss_text(F.col("formatted"), F.col("loss_spans"))})
    return {r["conv_id"]: r for r in samples.collect()}


def held(spark, log, **parameters):
    got, want = run(spark, log, **parameters), brute(log)
    assert set(got) == set(want)
    for conv, messages in want.items():
        r = got[conv]
        text, spans = rendered(messages)
        assert r["formatted"] == text
        assert [tuple(s) for s in r["loss_spans"]] == spans
        assert [tuple(t) for t in r["back"]] == messages and r["n_turns"] == len(messages)
        assert r["loss"] == "".join(body for role, body in messages if role == "assistant")
    return got


TEXTS = [None, "", "\\", "###", "####", "##", "#", "</turn>", "</tur", "n>\n", "\\s\\h", "### assistant: x</turn>\n", "plain é \U0001f600", ": ", "\n"]


@pytest.mark.parametrize("turns_per_chunk", [1, 3, 256])
def test_random_logs_fold_as_step_by_step(spark, turns_per_chunk):
    rng = random.Random(turns_per_chunk)
    kinds = ["message"] * 3 + ["delta"] * 5 + ["edit", "regenerate", None, "other"]
    log = []
    for conv in [None, -7, 0, 1, 2, 3]:
        log += [(conv, rng.choice([None, *range(60)]), rng.choice([None, *range(-4, 9)]), rng.choice(kinds),
                 rng.choice(["user", "assistant", "a:b\\", None]), rng.choice(TEXTS)) for _ in range(70)]
    held(spark, log, turns_per_chunk=turns_per_chunk)


def test_deltas_edits_and_regenerations(spark):
    log = [(1, 1, 0, "message", "user", "questoin"), (1, 2, 1, "message", "assistant", "An"), (1, 3, 1, "delta", "assistant", "swer"),
           (1, 4, 2, "message", "user", "thanks"), (1, 5, 0, "edit", "user", "question"),
           (1, 6, 1, "message", "assistant", "Wro"), (1, 7, 1, "delta", "assistant", "ng #"), (1, 8, 1, "regenerate", "assistant", ""),
           (1, 9, 1, "delta", "assistant", "Right #"), (1, 10, 1, "delta", "assistant", "## done")]
    got = held(spark, log)
    assert [tuple(t) for t in got[1]["back"]] == [("user", "question"), ("assistant", "Right ### done")]
    assert got[1]["formatted"] == "### user: question</turn>\n### assistant: Right \\h done</turn>\n"


def test_a_mark_across_deltas_is_escaped(spark):
    log = [(1, k, 0, "delta" if k else "message", "assistant", t) for k, t in enumerate("#|##|</|turn|>|\\|h".split("|"))]
    got = held(spark, log)
    assert "###" not in got[1]["formatted"][4:] and got[1]["formatted"].count("</turn>") == 1


def test_one_long_conversation_and_a_long_text(spark):
    log = [(5, k, k // 3, "delta" if k % 3 else "message", ["user", "assistant"][k // 3 % 2], f"part {k} é ") for k in range(6000)]
    log.append((6, 0, 0, "message", "assistant", "x#</turn>\\ " * 100_000))
    held(spark, log, turns_per_chunk=256)


def test_chunks_of_one_conversation_are_many_tasks(spark):
    log = spark.createDataFrame([(5, k, k, "message", "user", "x") for k in range(1000)], LOG)
    pieces = chat._pieces(chat.final_messages(log, 100))
    assert pieces.count() == 10 and pieces.agg(F.max("n_turns")).first()[0] == 100


def test_streamed_log_gives_the_rows_back(spark):
    rows = [(1, 0, "user", "a" * 1300 + "\n" + "é\U0001f600" * 700), (1, 1, "assistant", None), (1, 1, "assistant", ""), (1, 1, "assistant", "dup" * 400),
            (1, 1, "assistant", "dup" * 400), (None, None, None, None), (2, 3, "user", "\r\n" * 600)]
    frame = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "conv_id long, turn long, role string, text string, row long")
    back = chat.format_chats(chat.streamed_log(frame, "row")).select("conv_id", chat.read_back(F.col("formatted")).alias("t")).collect()
    got = {r["conv_id"]: [tuple(t) for t in r["t"]] for r in back}
    for conv in (1, 2, None):
        want = sorted((low(t), ro or "", hashlib.md5((x or "").encode()).hexdigest(), ro or "", x or "") for c, t, ro, x in rows if c == conv)
        assert got[conv] == [w[3:] for w in want]


def test_empty_log(spark):
    got = chat.format_chats(spark.createDataFrame([], LOG))
    assert got.count() == 0 and got.columns == ["conv_id", "n_turns", "formatted", "loss_spans"]


def test_texts_are_shuffled_once_for_short_conversations(spark):
    log = spark.createDataFrame([(k, 0, 0, "message", "user", "x") for k in range(50)], LOG).repartition(2)
    plan = chat.format_chats(log)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

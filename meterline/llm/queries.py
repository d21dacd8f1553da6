"""Registered queries of the operators, with their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm import chat, hardneg, jaccard, kneser_ney, merkle, mixing, packing, rules, secrets, sharding, substrings, topk, vectors, warc
from meterline.llm.common import scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


_LINE_RULES = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             string_split(text, chr(10)) AS ls FROM d),
b AS (SELECT doc_id, source, md5(text) AS whole, ws, ls, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             list_filter(ls, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS wl FROM w),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS s FROM (
          SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM b)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
line AS (SELECT doc_id, source, whole, unnest(wl) AS l FROM b),
norm AS (SELECT doc_id, source, whole, trim(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789',
             'abcdefghijklmnopqrstuvwxyz000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) AS l FROM line),
freq AS (SELECT source, l FROM norm GROUP BY source, l HAVING count(DISTINCT whole) >= 20),
gone AS (SELECT n.doc_id, count(*) AS ls, sum(len(string_split(n.l, ' ')))::BIGINT AS ws
         FROM norm n JOIN freq f ON n.source IS NOT DISTINCT FROM f.source AND n.l = f.l GROUP BY n.doc_id),
base AS (SELECT b.doc_id, n_words, word_chars, n_symbols, len(wl) - len(list_distinct(wl)) AS n_dup_lines,
                coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.ls, 0) AS n_removed_lines, coalesce(gone.ws, 0) AS n_removed_words
         FROM b LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND n_words - n_removed_words >= 20 AND n_removed_words <= 0.5 * n_words AS kept FROM failed"""

BASE_COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op1_line_frequency_rules", _LINE_RULES)
def line_frequency_rules(spark, sf_dir):
    ruled = rules.apply_rules(table(spark, sf_dir, "documents"))
    return ruled.select(*BASE_COLUMNS, "n_removed_lines", "n_removed_words")


@query("op3_kd_tree_shards")
def kd_tree_shards(spark, sf_dir):
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query("op9_poisson_replication", """
WITH d AS (SELECT doc_id, text, lang, source, n_chars, coalesce(strlen(text), 0) + 1 AS size FROM documents),
s AS (SELECT source, sum(size) AS size, pow(sum(size)::DOUBLE, 0.5) AS wanted FROM d GROUP BY source),
t AS (SELECT sum(size)::DOUBLE / sum(wanted) AS scale FROM s),
r AS (SELECT source, round(wanted * scale / size, 9) AS rate FROM s, t),
p AS (SELECT source, rate, greatest(ceil(rate / 32.0), 1)::INT AS parts FROM r),
u AS (SELECT d.*, rate, rate / parts AS mean, unnest(range(1, parts + 1)) AS j FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
v AS (SELECT *, ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || j), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM u),
n AS (SELECT doc_id, text, lang, source, n_chars, rate, sum(len(list_filter(range(0, 200), lambda k: u >= list_sum(list_transform(
        range(0, k + 1), lambda i: exp(i * ln(mean) - mean - lgamma(i + 1))))))) AS n
      FROM v GROUP BY ALL),
c AS (SELECT doc_id, text, lang, source, n_chars, rate, unnest(range(1, n::BIGINT + 1))::INT AS copy FROM n)
SELECT *, ('0x' || substr(md5('0:deal:' || coalesce(doc_id::VARCHAR, '') || ':' || copy), 1, 13))::BIGINT AS mix_key FROM c""")
def poisson_replication(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


def _secrets_sql() -> str:
    mark = "chr(57344)"
    lists = []
    for rank, rule in enumerate(secrets.RULES):
        head, tail = (x.replace("'", "''") for x in (rule.head, rule.tail))
        marked = f"string_split(regexp_replace(t, '({head})({tail})', {mark} || '\\1' || {mark} || '\\2' || {mark}, 'g'), {mark})"
        lists.append(f"(SELECT doc_id, {rank} AS r, '{rule.kind}' AS k, {rule.least} AS least, {marked} AS p FROM d)")
    return f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), {mark}, chr(65533)) AS t FROM documents),
p AS ({' UNION ALL '.join(lists)}),
c AS (SELECT doc_id, r, k, least, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM p WHERE len(p) > 1),
m AS (SELECT doc_id, r, k, least, i, length(x) AS n, sum(length(x)) OVER o AS b, lag(length(x)) OVER o AS head
      FROM c WINDOW o AS (PARTITION BY doc_id, r ORDER BY i)),
s AS (SELECT doc_id, r, k, (b - n - head)::BIGINT AS a, b::BIGINT AS b FROM m WHERE i % 3 = 0 AND n >= least),
g AS (SELECT doc_id, count(*) FILTER (k = 'assign') AS n_assign, count(*) FILTER (k = 'access') AS n_access, count(*) FILTER (k = 'hex') AS n_hex,
             string_agg(k || ':' || a || ':' || b, ',' ORDER BY a, r) FILTER (r < 3) AS base,
             string_agg(k || ':' || a || ':' || b, ',' ORDER BY a, r) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


@query("op10_blob_ledger_secrets", _secrets_sql())
def blob_ledger_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secrets.BlobLedger(spark, scratch(spark, "ledger"))
    ledger.ingest(docs, batch=0)
    found = F.col("found")
    base = F.filter(found, lambda s: s["kind"].isin([r.kind for r in secrets.BASE_RULES]))
    count = lambda kind: F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
    return ledger.on_paths(docs).select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(found).alias("spans"))


@query("op2_cost_balanced_packing")
def cost_balanced_packing(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), packing.public_vocabulary())
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost")


@query("op5_warc_archives", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest,
             max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM q""")
def warc_archives(spark, sf_dir):
    warc.register(spark)
    path = scratch(spark, "warc")
    warc.records(table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(path)
    back = spark.read.format("warc").load(path)
    # The digest of what was read, where a record has its payload; a revisit has it in its header only.
    whole = back.where("record_type = 'response'").select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
        "record_type", "refers_to")
    light = spark.read.format("warc").schema(warc.SCHEMA.rpartition(",")[0]).load(path).where("record_type = 'revisit'")
    return whole.unionByName(light.select(*whole.columns))


@query("op7_sorted_list_top_k", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""")
def sorted_list_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.scaled(F.col("embedding")).alias("v"))
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20)


@query("op8_kneser_ney_scores")
def kneser_ney_scores(spark, sf_dir):
    return kneser_ney.train_and_score(table(spark, sf_dir, "documents"))


@query("op4_relative_lz_substrings", r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
later AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM later) GROUP BY doc_id),
kept AS (SELECT w.doc_id, ws, coalesce(len(ps), 0) AS n,
                CASE WHEN ps IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(ps, i)), lambda i: ws[i]) END AS ks
         FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, len(ws) AS n_words, n AS n_removed, sha256(array_to_string(ks, ' ')) AS kept_sha256 FROM kept""")
def relative_lz_substrings(spark, sf_dir):
    return substrings.deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op6_metric_jaccard_join", r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, hash(unnest(sh)) AS h FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT doc_id AS node, doc_id AS label FROM n UNION SELECT l.b, r.label FROM r JOIN l ON l.a = r.node)
SELECT r.node AS doc_id, any_value(n.n) AS n_shingles, min(r.label) AS component_id FROM r JOIN n ON n.doc_id = r.node GROUP BY r.node""")
def metric_jaccard_join(spark, sf_dir):
    return jaccard.similar(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op11_anchor_tree_negatives", """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
             AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
             list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i]))::BIGINT AS score
      FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank,
       s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) <= 3""")
def anchor_tree_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), vectors.scaled(F.col("embedding"), 256).alias("v"))
    return hardneg.mine(rows, F.col("vec_id") % 50 == 0)


@query("op12_chat_samples", r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
              UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\s'), '###', '\h'), '</turn>', '\t') AS body,
             replace(replace(replace(replace(role, '\', '\s'), '###', '\h'), '</turn>', '\t'), ':', '\c') AS head FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, md5(text))) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, md5(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('### ' || head || ': ' || body || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""")
def chat_samples(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", "text", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    broken = r"\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", broken, 0, 0), (-7, 1, "assistant", broken, 0, 1)], rows.schema)
    samples = chat.format_chats(chat.streamed_log(rows.unionByName(added), "file", "row"))
    back = samples.withColumns({"turns": chat.read_back(F.col("formatted")), "loss": chat.loss_text(F.col("formatted"), F.col("loss_spans"))})
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
  lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295)"""


def _fields(*columns: str) -> str:
    return " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(({c})::VARCHAR) || ':' || ({c}) END" for c in columns)


@query("op13_merkle_manifest", f"""
WITH RECURSIVE d AS (SELECT *, sha256({_fields('doc_id', 'source', 'lang', 'n_chars', 'text')}) AS leaf,
    CASE WHEN {_CRC32} % 7 = 0 THEN sha256({_fields('doc_id', 'source', 'lang', 'n_chars + 1', 'text')}) END AS changed FROM documents),
l AS (SELECT doc_id, coalesce('=' || lang, '') AS k, leaf, coalesce(changed, leaf) AS claimed,
             row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
t AS (SELECT k, pos, leaf AS h, 0 AS lvl, n FROM l UNION ALL
      SELECT k, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), lvl + 1, (n + 1) // 2 FROM t WHERE n > 1 GROUP BY k, pos // 2, lvl, n),
g AS (SELECT k, h AS subroot, row_number() OVER (ORDER BY encode(k)) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT pos, subroot AS h, 0 AS lvl, n FROM g UNION ALL
      SELECT pos // 2, sha256(string_agg(h, '' ORDER BY pos)), lvl + 1, (n + 1) // 2 FROM u WHERE n > 1 GROUP BY pos // 2, lvl, n),
p AS (SELECT k, pos, claimed AS h, 0 AS lvl, n, '' AS proof, pos AS spot FROM l UNION ALL
      SELECT p.k, p.pos, sha256(CASE WHEN spot % 2 = 1 THEN coalesce(t.h, '') || p.h ELSE p.h || coalesce(t.h, '') END), p.lvl + 1, (p.n + 1) // 2,
             proof || coalesce(t.h, ''), spot // 2
      FROM p LEFT JOIN t ON t.k = p.k AND t.lvl = p.lvl AND t.pos = xor(p.spot, 1::BIGINT) WHERE p.n > 1),
q AS (SELECT p.k, p.pos, p.h, 0 AS lvl, g.n, proof, g.pos AS spot FROM p JOIN g ON g.k = p.k WHERE p.n = 1 UNION ALL
      SELECT q.k, q.pos, sha256(CASE WHEN spot % 2 = 1 THEN coalesce(u.h, '') || q.h ELSE q.h || coalesce(u.h, '') END), q.lvl + 1, (q.n + 1) // 2,
             proof || coalesce(u.h, ''), spot // 2
      FROM q LEFT JOIN u ON u.lvl = q.lvl AND u.pos = xor(q.spot, 1::BIGINT) WHERE q.n > 1)
SELECT l.doc_id, l.leaf, g.subroot, r.h AS root, sha256(q.proof) AS proof_sha256, q.h AS folded_root, q.h = r.h AS verified
FROM l JOIN g USING (k) JOIN q ON q.k = l.k AND q.pos = l.pos AND q.n = 1, (SELECT h FROM u WHERE n = 1) r""")
def merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    leaf = lambda n_chars: merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, leaf(F.col("n_chars") + 1))
    listed = merkle.manifest(docs, "lang", "doc_id", leaf(F.col("n_chars")), changed=changed)
    return merkle.checked(listed.withColumn("claimed", F.coalesce("changed", "leaf")), "doc_id", "claimed")

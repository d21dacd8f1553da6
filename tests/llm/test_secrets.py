import hashlib
import re

from pyspark.sql import functions as F

from meterline.llm import secrets
from tests.llm.fixtures import awkward, empty

HEX, KEY = "0123456789abcdef" * 2, "AKIA" + "Z9" * 8
TEXTS = [
    f"password = hunter22 and SECRET:'abc' token=\"abcdef", f"api_key={HEX} ApiKey: {KEY}", "token: token: abcdef", "secret: token=abcdefgh",
    f"é\U0001f600 {KEY} {KEY}Q and AKIAshort AKIA{'A' * 15}", f"{HEX}{HEX}g{HEX[:23]} {HEX[:24]}", "passwd\n=abcdef password  :  \"x+/_.=-1",
    "mark  password=abcdefgh", "ſecret=abcdefg toKen=abcdefg", "gho_" + "a1" * 20, "-----BEGIN RSA PRIVATE KEY-----", "x" * 30,
    "password=" + "a" * 5 + " " + "token=abcdefg " * 700, None, "",
]
PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20), "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}


def brute(text):
    out = []
    for rank, (kind, (pattern, group, least)) in enumerate(PATTERNS.items()):
        # re.I lets two non-ASCII letters match ASCII ones; they are not letters "in either case" here.
        source = (text or "").translate({0x17F: 0x1F600, 0x212A: 0x1F600})
        out += [(m.start(), rank, m.end(), kind) for m in pattern.finditer(source) if len(m[group]) >= least]
    return sorted(out)


def ledger(spark, tmp_path):
    return secrets.BlobLedger(spark, str(tmp_path / "ledger"))


def test_base_spans_match_brute_force(spark, tmp_path):
    docs = awkward(spark, extra="blob,found,rules,_salt").unionByName(
        spark.createDataFrame([(1000 + i, t, "en", "s", 1) for i, t in enumerate(TEXTS)],
                              "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    book = ledger(spark, tmp_path)
    book.ingest(docs, batch=0)
    rows = book.on_paths(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert [tuple(s) for s in r.found if s.kind in PATTERNS] == brute(r.text), (r.doc_id, r.text)
    kinds = {s.kind for r in rows for s in r.found}
    assert {"forge", "pem"} <= kinds


def test_only_unseen_pairs_are_scanned(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(50 + i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    blobs = len({t or "" for t in TEXTS})
    book = ledger(spark, tmp_path)
    book.ingest(docs, 0, secrets.BASE_RULES)
    assert book.read().count() == blobs
    book.ingest(docs, 1, secrets.BASE_RULES)
    assert spark.read.parquet(f"{book.root}/batch=1").count() == 0
    book.ingest(docs, 2, secrets.RULES)
    added = spark.read.parquet(f"{book.root}/batch=2")
    assert added.count() == blobs and {tuple(r.rules) for r in added.collect()} == {tuple(x.key for x in secrets.ADDED_RULES)}
    # A new version of a path: only its text is new. A replayed batch overwrites itself.
    changed = docs.where("doc_id = 3").withColumn("text", F.lit("now password=newsecret"))
    for _ in range(2):
        book.ingest(docs.unionByName(changed), 3)
        assert book.read().count() == 2 * blobs + 1
    newer = tuple(secrets.Rule(r.kind, 2, r.head, r.tail, 8) if r.kind == "assign" else r for r in secrets.RULES)
    book.ingest(docs, 4, newer)
    assert {tuple(r.rules) for r in spark.read.parquet(f"{book.root}/batch=4").collect()} == {("assign@2",)}
    old = {r.doc_id: r.found for r in book.on_paths(docs).collect()}
    new = {r.doc_id: r.found for r in book.on_paths(docs, newer).collect()}
    assert any(len(new[d]) < len(old[d]) for d in old) and all(len(new[d]) <= len(old[d]) for d in old)


def test_digest_and_redaction(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    book = ledger(spark, tmp_path)
    book.ingest(docs, 0)
    found = book.on_paths(docs)
    out = found.select("text", "found", secrets.listed(F.col("found")).alias("spans"),
                       secrets.redacted(F.col("text"), F.col("found"), "#").alias("clean")).collect()
    for r in out:
        assert r.spans == ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.found)
        covered = {p for s in r.found for p in range(s.start, s.end)}
        if r.text is None:
            assert r.clean is None
            continue
        kept = "".join("\0" if i in covered else c for i, c in enumerate(r.text))
        parts = [p for p in re.split("\0+", kept)]
        assert r.clean.replace("#", "") == "".join(parts).replace("#", "")
        assert not covered or "#" in r.clean
    assert hashlib.sha256(b"").hexdigest() == docs.limit(1).select(F.sha2(F.lit(""), 256)).first()[0]


def test_empty(spark, tmp_path):
    book = ledger(spark, tmp_path)
    book.ingest(empty(spark), 0)
    assert book.on_paths(empty(spark)).count() == 0

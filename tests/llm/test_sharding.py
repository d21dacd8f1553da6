import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from meterline.llm import sharding
from tests.llm.fixtures import awkward, empty


def brute(rows, whole, first, shards, out):
    """rows: (key, size, dims, tie); splits as the operator says, in one process."""
    if shards == 1 or not rows:
        for r in rows:
            out[r[0]] = first
        return
    share = [(max(r[2][k] for r in rows) - min(r[2][k] for r in rows)) / max(1, hi - lo) for k, (lo, hi) in enumerate(whole)]
    dim = max(range(len(share)), key=lambda k: (share[k], -k))
    rows = sorted(rows, key=lambda r: (r[2][dim], r[3]))
    target, before, at = sum(r[1] for r in rows) * (shards // 2) / shards, 0, 0
    while before < target:
        before += rows[at][1]
        at += 1
    if at and target - (before - rows[at - 1][1]) < before - target:
        at -= 1  # ids are unique here, so a key is a row
    brute(rows[:at], whole, first, shards // 2, out)
    brute(rows[at:], whole, first + shards // 2, shards - shards // 2, out)


def compared(docs, shards, dimensions=sharding.DIMENSIONS):
    """Shards by the operator and by brute force on the real values."""
    got = {r.doc_id: r for r in sharding.shard(docs, shards, dimensions=dimensions).collect()}
    meta = docs.select("*", F.xxhash64("doc_id", "text").alias("tie")).collect()
    places = {d: {v: k for k, v in enumerate(sorted({r[d] for r in meta}, key=lambda v: v.encode() if isinstance(v, str) else v))}
              for d in dimensions if isinstance(meta[0][d], str)}
    rows = [(r.doc_id, len(r.text.encode()) + 8, [places[d][r[d]] if d in places else r[d] for d in dimensions], r.tie) for r in meta]
    want = {}
    brute(rows, [(min(r[2][k] for r in rows), max(r[2][k] for r in rows)) for k in range(len(dimensions))], 0, shards, want)
    assert {k: r.shard for k, r in got.items()} == want
    return got, meta


def test_tree_matches_brute_force(spark):
    got, meta = compared(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), 24)
    for r in meta:
        assert got[r.doc_id].size == len(r.text.encode()) + 8 and got[r.doc_id].text_crc32 == zlib.crc32(r.text.encode())


def test_hosts_with_a_common_beginning_are_told_apart(spark):
    hosts = ["https://www.example.org/a", "https://www.example.org/b", "https://www.example.org/é", "https://www.example.org", "https://www.example.com"]
    rows = [(k, "x" * (k % 7), "en", hosts[k * k % 5], 5) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got, meta = compared(docs, 3, ("source", "n_chars"))
    of = {}
    for r in meta:
        of.setdefault(r.source, set()).add(got[r.doc_id].shard)
    assert any(len(shards) == 1 for shards in of.values()) and len(set().union(*of.values())) == 3


def test_values_beyond_the_broadcast(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    monkeypatch.setattr(sharding, "MOST_VALUES", 1)
    compared(docs, 6)


def test_sizes_slots_and_odd_rows(spark):
    docs = awkward(spark, extra="size,shard,slot,_size,_d0").where("doc_id IS NULL OR doc_id NOT IN (10, 11)")
    got = sharding.shard(docs, 5).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(5))
    assert max(sizes.values()) - min(sizes.values()) < 4 * max(r.size for r in got)
    assert {r.size for r in got if r.doc_id in (0, 1)} == {8} and {r.text_crc32 for r in got if r.doc_id in (0, 1)} == {0}


def test_one_value_for_all_and_fewer_rows_than_shards(spark):
    same = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("x" * 92).alias("text"), F.lit("en").alias("lang"),
                                   F.lit("s").alias("source"), F.lit(92).cast("long").alias("n_chars"))
    assert {r["count"] for r in sharding.shard(same, 4, dimensions=("lang", "source")).groupBy("shard").count().collect()} == {50}
    assert sharding.shard(same, 24, target_bytes=2000).select("shard").distinct().count() == 10
    few = sharding.shard(same.limit(3), 24).collect()
    assert len(few) == 3 and all(r.slot == 0 for r in few)


def test_empty(spark):
    assert sharding.shard(empty(spark), 24).count() == 0

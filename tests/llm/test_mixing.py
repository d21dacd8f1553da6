import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from meterline.llm import mixing
from tests.llm.fixtures import awkward, empty


def uniform(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16)


def poisson(u, mean):
    p = c = math.exp(-mean)
    n = 0
    while c <= u:
        n += 1
        p *= mean / n
        c += p
        if n > mean + 12 * math.sqrt(mean) + 60:
            break
    return n


def test_counts_match_brute_force(spark):
    docs = awkward(spark, extra="rate,copy,mix_key")
    weights = {"src0": 1.0, "src1": 3.0}
    rates = {r.source: r.rate for r in mixing.source_rates(docs, weights, epochs=4.0).collect()}
    assert rates[None] == 0.0
    got = Counter((r.doc_id, r.text, r.source) for r in mixing.mix(docs, weights, epochs=4.0, seed=3).collect())
    want = Counter()
    for r in docs.collect():
        rate = rates[r.source]
        parts = max(1, math.ceil(rate / mixing.SPLIT))
        own = "" if r.doc_id is None else r.doc_id
        n = sum(poisson(uniform(3, own, j) / 2**52, rate / parts) for j in range(1, parts + 1))
        want[r.doc_id, r.text, r.source] += n
    assert got == +want


def test_shares_follow_the_weights(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x" * 99).alias("text"),
                                    F.when(F.col("id") % 10 < 8, "big").when(F.col("id") % 10 < 9, "mid").otherwise("small").alias("source"))
    mixed = mixing.mix(docs, {"big": 1, "mid": 1, "small": 2}, epochs=1.0)
    n = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    for source, share in (("big", 0.25), ("mid", 0.25), ("small", 0.5)):
        assert n[source] / 6000 == pytest.approx(share, rel=0.08)
    # Counts are Poisson: mean and variance agree.
    counts = mixed.where("source = 'small'").groupBy("doc_id").count()
    drawn = [r["count"] for r in counts.collect()] + [0] * (600 - counts.count())
    mean = sum(drawn) / 600
    assert sum((x - mean) ** 2 for x in drawn) / 600 == pytest.approx(mean, rel=0.2)
    keys = [r.mix_key for r in mixed.collect()]
    assert len(set(keys)) == len(keys)


def test_very_large_rates_are_drawn_in_parts(spark):
    docs = spark.createDataFrame([(1, "a" * 99_999, "large"), (2, "b" * 9, "tiny")], "doc_id long, text string, source string")
    rate = {r.source: r.rate for r in mixing.source_rates(docs, {"large": 1, "tiny": 1}).collect()}["tiny"]
    n = mixing.mix(docs, {"large": 1, "tiny": 1}).where("source = 'tiny'").count()
    assert rate > 4000 and n == pytest.approx(rate, rel=0.1)


def test_no_weight_at_all_and_empty(spark):
    docs = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    assert mixing.mix(docs, {}).count() == 0 and mixing.mix(docs, {"other": 2.0}).count() == 0
    assert mixing.mix(empty(spark)).count() == 0

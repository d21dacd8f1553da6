import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterline.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k, asked):
    good = []
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, [math.floor(64 * float(np.float32(x))) for x in v]))
    out = []
    for q, a in good:
        if not asked(q):
            continue
        scored = [(-sum(x * y for x, y in zip(a, b)), c) for c, b in good if c != q and len(b) == len(a)]
        out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def run(spark, rows, k=20, asked="vec_id % 20 = 0", **parameters):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("score", F.lit("clash"))
    vectors = frame.select("vec_id", topk.scaled(F.col("embedding")).alias("v"))
    return sorted(tuple(r) for r in topk.top_k(vectors, vectors.where(asked), k, **parameters).collect())


def test_odd_vectors_ties_and_lengths(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(6)]) for i in range(300)]
    rows += [(400, None), (420, []), (440, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (460, [float("nan")] * 6), (480, [float("inf")] * 6),
             (None, [1.0] * 6), (500, [1.0, 2.0]), (501, [2.0, 1.0]), (502, [-1.0, 0.5])]
    assert run(spark, rows, k=7, block_rows=50, query_rows=4, least_tile=100) == brute(rows, 7, lambda q: q % 20 == 0)


@pytest.mark.parametrize("scale", [1.0, 1e4, 1e6, 2e6])
def test_rounds_of_reading_lose_nothing(spark, scale):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16))
    data = (centres[rng.integers(0, 8, 1500)] + 0.3 * rng.normal(size=(1500, 16))) * scale
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(data)]
    assert run(spark, rows, block_rows=400, query_rows=20, least_tile=800) == brute(rows, 20, lambda q: q % 20 == 0)


def test_reading_stops_early_and_reads_no_more_than_it_says():
    rng = np.random.default_rng(5)
    block = rng.integers(-5, 6, (4000, 8))
    block[:40] = 100 + rng.integers(0, 9, (40, 8))  # a few stand out; shallow lists tell
    names = np.arange(4000)
    lists, best = topk.Lists(names, block), topk.Best(20)
    read = topk.read_lists(np.full(8, 7), 10**6, lists, best)
    assert read == 8 * (4000 >> 5)  # one round of every list
    want = np.lexsort((names, -(block @ np.full(8, 7))))[:20]
    assert best.names.tolist() == want.tolist()
    # A block whose rows cannot reach the best so far is left after its first round.
    poor = topk.Lists(names + 5000, rng.integers(-5, 6, (4000, 8)))
    assert topk.read_lists(np.full(8, 7), 10**6, poor, best) == 8 * (4000 >> 5) and best.names.tolist() == want.tolist()


def test_bounds_come_from_entries_read_alone():
    """Rows beyond the depth reached may hold anything up to the place reached: changing them changes no decision before."""
    rng = np.random.default_rng(7)
    block = rng.integers(-50, 51, (500, 6))
    query = np.array([3, -2, 0, 5, -1, 4])
    lists, best = topk.Lists(np.arange(500), block), topk.Best(5)
    read = topk.read_lists(query, -1, lists, best)
    depth = read // 6
    assert 0 < depth < 500
    scores = block @ query
    assert best.scores.tolist() == np.sort(scores)[::-1][:5].tolist()
    # Every row that was dropped lies below the fifth best by its own score.
    assert (scores >= best.scores[-1]).sum() >= 5


def test_fewer_candidates_than_k_repeats_and_empty(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (20, [0.0, 1.0])]
    assert run(spark, rows) == brute(rows, 20, lambda q: q % 20 == 0)
    empty = spark.createDataFrame([], "vec_id long, v array<long>")
    assert topk.top_k(empty, empty).count() == 0


class Counted(topk.Lists):
    """Lists that count how often their entries are taken."""

    taken = 0

    def __getattribute__(self, name):
        if name == "entries":
            type(self).taken += 1
        return super().__getattribute__(name)


@pytest.mark.parametrize("scale", [5, 10**5, 10**8])
def test_queries_share_the_reading_of_entries_and_stop_on_their_own(scale):
    rng = np.random.default_rng(11)
    rows = rng.integers(-scale, scale + 1, (900, 6))
    rows[:30] = 3 * scale
    names = rng.permutation(900)
    names[5] = names[6]  # an id twice: both are the query's own
    queries = np.concatenate([rows[:8], np.full((1, 6), 7), np.zeros((1, 6), np.int64), rows[500:560]])
    own = np.concatenate([names[:8], [-1, -1], names[500:560]])
    best, counted = topk.Best(10, len(queries)), Counted(names, rows)
    Counted.taken = 0
    read = topk.read_together(queries, own, counted, best)
    assert 0 < Counted.taken <= len(topk.depths(900))  # a round's entries are taken once, not by every query
    assert len(set(read.tolist())) > 1
    for j, (query, name) in enumerate(zip(queries, own, strict=True)):
        one = topk.Best(10)
        assert topk.read_lists(query, name, topk.Lists(names, rows), one) == read[j]
        scores = np.where(names == name, -(1 << 62), rows @ query)
        want = np.lexsort((names, -scores))[:10]
        mine = best.of == j
        assert best.names[mine].tolist() == one.names.tolist() == names[want].tolist()
        assert best.scores[mine].tolist() == one.scores.tolist() == scores[want].tolist()

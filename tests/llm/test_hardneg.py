import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterline.llm import hardneg, vectors

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, positives=5, negatives=3, asked=lambda i: i % 50 == 0):
    good = []
    for i, label, v in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    anchors = {}
    for i, label, v in good:
        if asked(i):
            anchors[i] = max(anchors.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, l) for i, l, w in good if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            window = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(a, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(window[:negatives])]
    return sorted(out)


def run(spark, rows, **parameters):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"score": F.lit("clash"), "tree": F.lit(1), "asked": F.lit("x")})
    scaled = frame.withColumn("v", vectors.scaled(F.col("embedding"), 256))
    return sorted(tuple(r) for r in hardneg.mine(scaled, F.col("vec_id") % 50 == 0, **parameters).collect())


def clustered(n, dims, scale=1.0, seed=3, spread=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dims))
    data = (centres[rng.integers(0, 8, n)] + spread * rng.normal(size=(n, dims))) * scale
    return [(i, int(rng.integers(0, 4)), [float(np.float32(x)) for x in v]) for i, v in enumerate(data)]


@pytest.mark.parametrize("scale", [1e-3, 1.0, 1e5])
def test_small_tiles_trees_and_blocks(spark, scale):
    rows = clustered(1200, 12, scale)
    got = run(spark, rows, block_rows=100, tree_rows=5, most_pivots=3, least_tile=300)
    assert got == brute(rows) and got


def test_scores_beyond_doubles_are_exact(spark):
    rows = clustered(300, 6, 3e5)
    big = [(i, l, [x * 8 for x in v]) for i, l, v in rows]
    assert any(abs(r[4]) > 1 << 53 for r in brute(big))
    assert run(spark, big, block_rows=64, tree_rows=3) == brute(big)


def test_odd_rows_ties_repeats_and_lengths(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(3), [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(5)]) for i in range(400)]
    rows += [rows[50], rows[7], rows[7], (100, 9, [1.0] * 5), (400, None, [1.0] * 5), (450, 1, None), (500, 1, []), (550, 1, [1.0, None, 0, 0, 0]),
             (600, 1, [float("nan")] * 5), (650, 1, [float("inf")] * 5), (None, 1, [1.0] * 5), (700, 1, [1.0, 2.0]), (701, 1, [2.0, 1.0]),
             (702, 2, [1.0, 1.0]), (703, None, [1.0, 1.0]), (800, 1, [0.0] * 5)]
    rows = [(i, l, v and [None if x is None else float(x) for x in v]) for i, l, v in rows]
    assert run(spark, rows, block_rows=40, tree_rows=3, most_pivots=2, least_tile=100) == brute(rows)


def test_one_vector_of_a_third_of_all_rows(spark):
    rows = clustered(600, 8)
    rows = [(i, l, rows[0][2]) if i % 3 == 0 else (i, l, v) for i, l, v in rows]
    assert run(spark, rows, block_rows=64, tree_rows=4, least_tile=150) == brute(rows)


def test_few_rows_and_empty(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.5]), (2, 2, [0.7, 0.0])]
    assert run(spark, rows) == brute(rows) == [(0, 1, 1, 2, 65536, 45824)]
    assert run(spark, [(0, 1, [1.0])]) == []
    assert run(spark, []) == []


def test_spanning_tree_is_minimal_and_parents_come_first():
    rng = np.random.default_rng(2)
    points = rng.integers(-50, 50, (40, 3))
    order, parent, edge = hardneg.spanning_tree(points)
    assert sorted(order) == list(range(40)) and parent[0] == -1 and all(p < k for k, p in enumerate(parent))
    for k in range(1, 40):
        assert edge[k] == pytest.approx(np.linalg.norm(points[order[k]] - points[order[parent[k]]]))
    # Kruskal's total.
    pairs = sorted((float(np.linalg.norm(points[a] - points[b])), a, b) for a in range(40) for b in range(a))
    group, total = list(range(40)), 0.0
    for d, a, b in pairs:
        if group[a] != group[b]:
            total += d
            group = [group[a] if g == group[b] else g for g in group]
    assert edge.sum() == pytest.approx(total)


def test_bounds_spare_scores_where_anchors_lie_close():
    rng = np.random.default_rng(4)
    x = rng.integers(-300, 300, (3000, 16))
    near = rng.integers(-300, 300, (1, 16)) + rng.integers(-3, 4, (60, 16))
    order, parent, edge = hardneg.spanning_tree(near)
    norms = lambda m: np.sqrt((m.astype(float) ** 2).sum(axis=1))
    anchors = hardneg.Block(np.arange(60), np.zeros(60, np.int64), near[order], norms(near))
    block = hardneg.Block(np.arange(100, 3100), np.ones(3000, np.int64), x, norms(x))
    scores = near[order] @ x.T
    top = np.sort(scores, axis=1)[:, -1]
    wanted = [hardneg.Wanted([(int(t) // 2, int(t) * 95 // 100)], 3) for t in top]
    computed = hardneg.walk(anchors, parent, edge, wanted, block, False)
    assert computed < 0.5 * scores.size
    for w, row in zip(wanted, scores):
        inside = [s for s in sorted(row.tolist(), reverse=True) if w.windows[0][0] <= s <= w.windows[0][1]][:3]
        assert w.scores[0].tolist() == inside

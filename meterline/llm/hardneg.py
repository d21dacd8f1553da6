"""Hard negatives by score bounds along a spanning tree of the anchors.

An anchor's positives are the best rows of its own label. For each positive, negatives are the best rows of
other labels whose score lies in a window below the positive's.

Scores are inner products, so between two anchors a candidate's scores differ by at most the anchors'
distance times the candidate's norm. The anchors of a block hang on a minimum spanning tree: the root is scored
in full, and a child takes its parent's score, or the parent's bounds, plus and minus edge times norm. Only
candidates whose bounds meet a window of the child are scored; their exact score serves the child's own children. A window
narrows as results are found: its lower end rises to the worst result that still counts. Positives are found the
same way, with the window from the worst of the best so far upwards.

Anchors are put next to each other by the nearest of at most `most_pivots` anchors, drawn by a hash; that
decides how tight bounds are, not what is found. Blocks of anchors meet blocks of candidates (a stated query
set against all rows) in tiles of bounded size, so neither a hot label nor a hot vector is one task's group.

Whole numbers: scores are exact in 64-bit floats up to 2^53, in Python integers beyond; bounds are widened by more
than their rounding.

Defined cases. A row with a null id, label or vector, an empty vector, or a null or non-finite component takes no part. Only
vectors of equal length meet. Rows with the anchor's id are neither its positives nor its negatives; of several
rows with an anchor's id the greatest by label and vector is the anchor. Repeated rows are candidates
each. Ties go to the smaller id. An empty table gives an empty table. Scores must fit a long. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.llm.common import written
from meterline.llm.vectors import blocks_of, decoded, encoded, number

#: Rows of a candidate block; anchors of a tree; anchors that locate the others.
BLOCK_ROWS, TREE_ROWS, MOST_PIVOTS = 2048, 512, 256
#: A tile holds up to this many candidates and anchors; with few rows tiles are smaller, so that there are some 64.
LEAST_TILE, MOST_TILE, TILES = 4096, 65_536, 64
PAD = 1e-9


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge) of a minimum spanning tree, parents before children.

    `parent` counts in the new order, -1 for the root.
    """
    points = points.astype(float)
    n = len(points)
    near, link = np.full(n, np.inf), np.full(n, -1)
    place = np.full(n, -1)
    order, parent, edge = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n)
    at = int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1))) if n else 0
    for k in range(n):
        place[at], order[k] = k, at
        parent[k], edge[k] = (place[link[at]], np.sqrt(near[at])) if k else (-1, 0.0)
        far = ((points - points[at]) ** 2).sum(axis=1)
        closer = (far < near) & (place < 0)
        near[closer], link[closer] = far[closer], at
        at = int(np.argmin(np.where(place < 0, near, np.inf)))
    return order, parent, edge


@dataclass
class Block:
    """Rows of one vector length."""

    ids: np.ndarray
    labels: np.ndarray
    data: np.ndarray
    norms: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Block:
        ids, data = decoded(row["ids"], row["width"], row["data"])
        return cls(ids, np.frombuffer(row["labels"], "<i8"), data, np.sqrt((data.astype(float) ** 2).sum(axis=1)))


class Wanted:
    """The best `k` results of some windows of one anchor so far: (score, id) lists, highest first, smaller id first."""

    def __init__(self, windows: list[tuple[float, float]], k: int):
        self.windows, self.k = windows, k
        self.scores = [np.empty(0, np.int64) for _ in windows]
        self.names = [np.empty(0, np.int64) for _ in windows]

    def lowest(self, w: int):
        """What a newcomer to window `w` must reach."""
        full = len(self.scores[w]) == self.k
        return max(self.windows[w][0], int(self.scores[w][-1])) if full else self.windows[w][0]

    def may(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whose bounds meet a window."""
        hit = np.zeros(len(low), bool)
        for w, (_, top) in enumerate(self.windows):
            hit |= (high >= self.lowest(w)) & (low <= top)
        return hit

    def add(self, scores: np.ndarray, names: np.ndarray) -> None:
        for w, (_, top) in enumerate(self.windows):
            inside = (scores >= self.lowest(w)) & (scores <= top)
            if inside.any():
                s = np.concatenate([self.scores[w], scores[inside].astype(np.int64)])
                n = np.concatenate([self.names[w], names[inside]])
                best = np.lexsort((n, -s))[:self.k]
                self.scores[w], self.names[w] = s[best], n[best]


def walk(anchors: Block, parent: np.ndarray, edge: np.ndarray, wanted: list[Wanted], block: Block, same_label: bool) -> int:
    """Down the tree against one block of candidates, into `wanted`; how many scores were computed."""
    size = anchors.norms.max(initial=0) * block.norms.max(initial=0)
    kind = number(size)
    a, x = anchors.data.astype(kind), block.data.astype(kind)
    low, high = np.empty((len(a), len(x))), np.empty((len(a), len(x)))
    computed = 0
    for i in range(len(a)):
        up = parent[i]
        pad = PAD * anchors.norms[i] * block.norms + 1e-6
        eligible = ((block.labels == anchors.labels[i]) == same_label) & (block.ids != anchors.ids[i])
        if up < 0:
            some = np.arange(len(x))
        else:
            reach = edge[i] * (1 + PAD) * block.norms + pad
            low[i], high[i] = low[up] - reach, high[up] + reach
            some = np.flatnonzero(eligible & wanted[i].may(low[i], high[i]))
        if not len(some):
            continue
        scores = (x @ a[i])[some] if 2 * len(some) > len(x) else x[some] @ a[i]
        computed += len(some)
        low[i, some] = scores.astype(float) - pad[some]
        high[i, some] = scores.astype(float) + pad[some]
        mine = eligible[some]
        wanted[i].add(scores[mine].astype(object if kind is object else np.int64), block.ids[some][mine])
    return computed


def _trees(anchors: DataFrame, tree_rows: int, most_pivots: int) -> DataFrame:
    """(n, tree, ids, labels, width, data, parent, edge): spanning trees of anchors that lie near each other."""
    total = anchors.count()
    wanted = min(most_pivots, -(-total // tree_rows))
    drawn = anchors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).collect()
    by_length: dict[int, np.ndarray] = {}
    for length in {len(r["v"]) for r in drawn}:
        by_length[length] = np.array([r["v"] for r in drawn if len(r["v"]) == length], float)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for vector in batch.column("v"):
                values = vector.values.to_numpy(zero_copy_only=False).astype(float)
                pivots = by_length.get(len(values))
                found.append(0 if pivots is None else int(np.argmin(((pivots - values) ** 2).sum(axis=1))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], names=[*batch.schema.names, "pivot"])

    located = written(anchors.select("vec_id", "label", "v").mapInArrow(
        nearest, "vec_id long, label long, v array<long>, pivot int").withColumn("n", F.size("v")), "anchors")
    many = located.groupBy("n", "pivot").agg((F.ceil(F.count(F.lit(1)) / tree_rows)).cast("int").alias("parts"))
    dealt = located.join(many, ["n", "pivot"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))

    def grown(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        points = np.array(table["v"].to_pylist(), np.int64)
        order, parent, edge = spanning_tree(points)
        width, data = encoded(points[order])
        whole = lambda name: table[name].to_numpy()[order].astype("<i8").tobytes()
        return pa.table({
            "n": table["n"][:1], "tree": pa.array([f"{table['pivot'][0]}-{table['part'][0]}"]), "ids": [whole("vec_id")],
            "labels": [whole("label")], "width": pa.array([width], pa.int32()), "data": [data],
            "parent": [parent.astype("<i8").tobytes()], "edge": [edge.astype("<f8").tobytes()]})

    return dealt.select("n", "pivot", "part", "vec_id", "label", "v").groupBy("n", "pivot", "part").applyInArrow(
        grown, "n int, tree string, ids binary, labels binary, width int, data binary, parent binary, edge binary")


def _met(trees: DataFrame, held: DataFrame, tiles: int, sides: int, k: int, same_label: bool) -> DataFrame:
    """(tree, n, i, w, anchor_id, vec_id, score): up to `k` rows of each window, per tile of candidates."""
    out = pa.schema([("n", pa.int32()), ("tree", pa.string()), ("i", pa.int32()), ("w", pa.int32()), ("anchor_id", pa.int64()),
                     ("vec_id", pa.int64()), ("score", pa.int64())])
    spread = held.withColumn("tile", F.pmod(F.xxhash64("ids"), F.lit(tiles)).cast("int")).withColumn(
        "side", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    asked = trees.withColumn("side", F.pmod(F.xxhash64("tree"), F.lit(sides)).cast("int")).withColumn(
        "tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        blocks = [Block.of(r) for r in right.to_pylist()]
        rows = {name: [] for name in out.names}
        for tree in left.to_pylist():
            anchors = Block.of(tree)
            windows: list[list] = [[] for _ in anchors.ids]
            for w in tree["windows"] or ():
                windows[w["i"]].append((w["w"], (w["low"], w["high"])))
            if same_label:
                windows = [[(0, (-np.inf, np.inf))] for _ in anchors.ids]
            wanted = [Wanted([w for _, w in each], k) for each in windows]
            for block in blocks:
                walk(anchors, np.frombuffer(tree["parent"], "<i8"), np.frombuffer(tree["edge"], "<f8"), wanted, block, same_label)
            for i, each in enumerate(wanted):
                for (w, _), scores, names in zip(windows[i], each.scores, each.names, strict=True):
                    for score, name in zip(scores.tolist(), names.tolist(), strict=True):
                        for column, value in zip(rows.values(), (tree["n"], tree["tree"], i, w, int(anchors.ids[i]), name, score), strict=True):
                            column.append(value)
        return pa.table({f.name: pa.array(rows[f.name], f.type) for f in out}, schema=out)

    keys = ["n", "tile", "side"]
    return asked.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(
        scored, "n int, tree string, i int, w int, anchor_id long, vec_id long, score long")


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95,
         block_rows: int = BLOCK_ROWS, tree_rows: int = TREE_ROWS, most_pivots: int = MOST_PIVOTS,
         least_tile: int = LEAST_TILE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows `vec_id, label, v`.

    A negative's score lies between `least` and `most` percent of the positive's.
    """
    good = written(rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "v",
        F.coalesce(is_anchor, F.lit(False)).alias("asked")), "vectors")
    anchors = good.where("asked").groupBy("vec_id").agg(F.max(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    counts = good.agg(F.count(F.lit(1)), F.count(F.when(F.col("asked"), 1))).first()
    tile_rows = min(MOST_TILE, max(least_tile, counts[0] // TILES))
    tiles, sides = max(1, -(-counts[0] // tile_rows)), max(1, -(-counts[1] // MOST_TILE))
    held = written(blocks_of(good, block_rows), "blocks")
    trees = written(_trees(anchors, tree_rows, most_pivots), "trees")
    none = F.lit(None).cast("array<struct<i:int,w:int,low:long,high:long>>")
    near = _met(trees.withColumn("windows", none), held, tiles, sides, positives, True)
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    chosen = written(near.withColumn("w", F.row_number().over(best)).where(F.col("w") <= positives), "positives")
    percent = lambda share: F.col("score").cast("decimal(38,0)") * share / 100
    ends = chosen.where("score >= 0").select(
        "n", "tree", F.struct("i", "w", F.ceil(percent(least)).cast("long").alias("low"), F.floor(percent(most)).cast("long").alias("high")).alias("s"))
    windows = ends.groupBy("n", "tree").agg(F.collect_list("s").alias("windows"))  # a few windows for each anchor of one tree
    far = _met(trees.join(windows, ["n", "tree"]), held, tiles, sides, negatives, False)
    ranked = Window.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "vec_id")
    found = far.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "w", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(
        chosen.select("anchor_id", "w", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor_id", "w"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

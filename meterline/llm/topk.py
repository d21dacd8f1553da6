"""Exact top-k inner products by aggregation of sorted lists without random access.

Every vector component is a list of (value, row), sorted by value. A query's score is the sum of one
entry of each list. Lists are read in order, from the top where the query's weight is positive and from the bottom where it
is negative, some entries of each in a round. An entry adds its share to its row. What a row has not shown yet lies between the place
reached in that list and the list's far end, so every row has a lower and an upper bound from what was read alone. Once `k` lower
bounds reach t, rows whose upper bound is below t are out, rows not met at all among them; reading stops when few are
left, or at the lists' ends, and the scores of those are resolved. A block of queries goes down the lists together: an entry is read once, its
shares are added for all queries that have come as deep by one product, and each query stops on its own. The best `k` so far of a query
serve as its t from the first round of the next block.

Candidates come in blocks of vectors whose lists are sorted once in a task, queries in blocks too; blocks of queries meet
blocks of candidates (a stated query set against all rows) in tiles of bounded size. Each tile returns k rows per
query, and a window picks the best k of those.

Values are whole numbers, sums are exact: 32-bit floats up to 2^24, 64-bit floats up to 2^52, Python integers beyond.

Defined cases. A vector that is null, empty, or has a null or non-finite component takes
no part. Only vectors of equal length meet. A query's own id is no candidate, nor are
other rows with that id; repeated rows are candidates each. Ties go to the smaller id.
Null ids take no part. An empty table gives an empty table. Scores must fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterline.llm.common import written
from meterline.llm.vectors import blocks_of, decoded, encoded, number, scaled

__all__ = ["Best", "Lists", "read_lists", "read_together", "scaled", "top_k"]

#: Reading ends when at most so many times k rows are left.
FEW = 2
#: A tile holds up to this many candidates and queries; with few rows tiles are smaller, so that there are some 64.
LEAST_TILE, MOST_TILE, TILES = 4096, 65_536, 64


def depths(n: int) -> list[int]:
    """The depths at which a round of reading lists of `n` entries ends: doubling up to a half, then by eighths."""
    ends = [n >> k for k in range(5, 1, -1)] + [-(-n * k // 8) for k in range(4, 9)]
    return sorted({e for e in ends if e})


class Lists:
    """One block's candidates as sorted lists, list i from the least value up at i and from the greatest down at dims + i."""

    def __init__(self, names: np.ndarray, rows: np.ndarray):
        self.names, self.rows = names, rows
        order = np.argsort(rows, axis=0, kind="stable").T
        both = lambda rising: np.concatenate([rising, rising[:, ::-1]])
        self.entries = both(order)  # the row of each entry
        self.sorted = both(np.take_along_axis(rows.T, order, axis=1))
        self.most = float(np.abs(rows).max(initial=0))
        self._typed: dict[type, np.ndarray] = {}

    def values(self, kind: type) -> np.ndarray:
        """The lists' values."""
        if kind not in self._typed:
            self._typed[kind] = self.sorted.astype(kind)
        return self._typed[kind]


class Best:
    """The k best (score, id) so far of some queries; `of` is the query's number, best first within it."""

    def __init__(self, k: int, queries: int = 1):
        self.k, self.queries = k, queries
        self.of, self.scores, self.names = (np.empty(0, np.int64) for _ in range(3))

    def floors(self, kind: type) -> np.ndarray:
        """The score that a newcomer must reach, of each query; -inf while it has fewer than k."""
        last = np.cumsum(np.bincount(self.of, minlength=self.queries)) - 1
        full = np.bincount(self.of, minlength=self.queries) == self.k
        floors = np.full(self.queries, -np.inf, object if kind is object else float)
        floors[full] = self.scores[last[full]]
        return floors

    def add(self, of: np.ndarray, scores: np.ndarray, names: np.ndarray) -> None:
        of, scores, names = (np.concatenate(c) for c in ((self.of, of), (self.scores, scores), (self.names, names)))
        order = np.lexsort((names, -scores, of))
        ranked = of[order]
        order = order[np.arange(len(ranked)) - np.searchsorted(ranked, ranked) < self.k]
        self.of, self.scores, self.names = of[order], scores[order], names[order]


def read_together(queries: np.ndarray, own: np.ndarray, lists: Lists, best: Best, few: int = FEW) -> np.ndarray:
    """Queries down the lists of one block, into `best`; how many entries each has read.

    An entry is read once for all queries that have come as deep, and its shares are added to its row for all of them at once.
    """
    n, dims = lists.rows.shape
    most = float(np.abs(queries).max(initial=0)) * lists.most * dims * 4  # bounds are sums of differences
    kind = np.float32 if most < 1 << 24 else number(most)
    values = lists.values(kind)
    # A query reads one of the two lists of a component: its weight in the other is 0.
    weights = np.concatenate([np.minimum(queries, 0), np.maximum(queries, 0)], axis=1).T.astype(kind)
    floors = best.floors(kind)
    first = np.array([f == -np.inf for f in floors], bool)
    shown, seen = np.zeros((n, 2 * dims), kind), np.zeros((n, 2 * dims), bool)
    far, which = values[:, -1], np.arange(2 * dims)[:, None]
    read, going, depth = np.zeros(len(queries), np.int64), np.arange(len(queries)), 0
    for end in depths(n):
        # The next entries of every list show their rows a value.
        at = lists.entries[:, depth:end]
        shown[at, which], seen[at, which] = values[:, depth:end], True
        depth, reached = end, values[:, end - 1]
        read[going] = depth * dims
        fresh = going[first[going]]
        if len(fresh) and n >= best.k:
            # What a row has at least: what it has shown, and the far ends of the other lists.
            lower = (shown - seen * far) @ weights[:, fresh] + far @ weights[:, fresh]
            lower[lists.names[:, None] == own[fresh]] = -np.inf
            floors[fresh] = np.partition(lower, n - best.k, axis=0)[n - best.k]
        unmet = reached @ weights[:, going]  # what a row may have that no list has shown yet
        # Else rows not met can still qualify.
        asked = first[going] | (unmet < floors[going]) | (end == n)
        unmet, some = unmet[asked], going[asked]
        if not len(some):
            continue
        # The rows that can still qualify.
        able = (shown - seen * reached) @ weights[:, some] >= (floors[some] - unmet).astype(kind)
        done = np.ones(len(some), bool) if end == n else able.sum(axis=0) <= few * best.k
        row, of = np.nonzero(able[:, done])
        of = some[done][of]
        others = lists.names[row] != own[of]
        row, of = row[others], of[others]
        best.add(of, np.einsum("ij,ij->i", lists.rows[row], queries[of]), lists.names[row])
        going = np.setdiff1d(going, some[done], assume_unique=True)
        if not len(going):
            break
    return read


def read_lists(query: np.ndarray, own: int, lists: Lists, best: Best, few: int = FEW) -> int:
    """`read_together` of one query."""
    return int(read_together(np.asarray(query)[None, :], np.array([own]), lists, best, few)[0])


def query_blocks(rows: DataFrame, parts: int) -> DataFrame:
    """(n, qb, ids, width, data): queries in `parts` blocks by a hash of their id."""

    def gathered(key, table):
        table = table.sort_by("vec_id")
        width, data = encoded(np.array(table["v"].to_pylist(), np.int64))
        return pa.table({"n": pa.array([key[0].as_py()], pa.int32()), "qb": pa.array([key[1].as_py()], pa.int32()),
                         "ids": [table["vec_id"].to_numpy().astype("<i8").tobytes()], "width": pa.array([width], pa.int32()), "data": [data]})

    keyed = rows.select("vec_id", "v", F.size("v").alias("n"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("qb"))
    return keyed.groupBy("n", "qb").applyInArrow(gathered, "n int, qb int, ids binary, width int, data binary")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, block_rows: int = 1024, query_rows: int = 512,
          least_tile: int = LEAST_TILE) -> DataFrame:
    """(query_id, rank, vec_id, score) over tables of `vec_id` and whole-number arrays `v`."""
    usable = F.col("v").isNotNull() & F.col("vec_id").isNotNull()
    asked = queries.where(usable).select("vec_id", "v")
    rows = vectors.where(usable).select("vec_id", F.lit(0).cast("long").alias("label"), "v")
    held = written(blocks_of(rows, block_rows), "lists")
    total, many = held.agg(F.sum(F.octet_length("ids") / 8)).first()[0] or 0, asked.count()
    tiles = max(1, -(-int(total) // min(MOST_TILE, max(least_tile, int(total) // TILES))))
    parts = max(1, -(-many // query_rows))
    sides = max(1, -(-many // MOST_TILE))
    spread = held.withColumn("tile", F.pmod(F.xxhash64("ids"), F.lit(tiles)).cast("int")).withColumn(
        "side", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    asked = query_blocks(asked, parts).withColumn("side", F.col("qb") % sides).withColumn(
        "tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        blocks = [Lists(*decoded(r["ids"], r["width"], r["data"])) for r in right.to_pylist()]
        for r in left.to_pylist() if blocks else ():
            ids, matrix = decoded(r["ids"], r["width"], r["data"])
            for at in range(0, len(ids), query_rows):
                own, some = ids[at:at + query_rows], matrix[at:at + query_rows]
                best = Best(k, len(own))
                for block in blocks:
                    read_together(some, own, block, best)
                found["query_id"].append(own[best.of])
                found["vec_id"].append(best.names)
                found["score"].append(best.scores)
        return pa.table({n: pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for n, c in found.items()})

    keys = ["n", "tile", "side"]
    met = asked.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")

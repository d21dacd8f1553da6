"""Sharding by a k-d tree over the documents' metadata.

The tree starts with all documents and the wanted number of shards. A node that still
stands for several shards is split along its widest dimension - the one whose range
in the node is the largest part of its range in the table - at the weighted median:
the place where the bytes below match the shards below. Leaves stand for one shard
each, of about the target bytes.

Medians are found without moving a document. Documents are ordered by (dimension,
hash of the id), so a value that a third of all rows share has an inside to split.
Each round sums the bytes of at most `BINS` bins of every open node, one job for all
nodes, and narrows each node to the bin that holds its median; a few rounds reach a
single key. What reaches the driver is nodes times bins sums, whatever the input.

A dimension of texts is measured by the places of its values in their order: a table of the distinct values is
numbered in ranges and joined to the documents.

Text is read once, for its size and check sum; every later step reads the narrow
table written then. Slots are counted in chunks of a shard, so no shard is one task.

Law `bytes`: sizes near equal, a shard is off by less than one key's documents per
split. Equal texts are not held together here: a group of copies may be larger than
a shard.

Defined cases. A null text weighs 8 bytes and has the check sum of an empty text. A null in a
dimension counts as the dimension's least value. Equal (value, hash) keys, that is
rows repeated with their id and text, stay on one side of a split. A table with
fewer documents than shards leaves shards empty; an empty table gives an empty
table. Columns named like the added ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.llm.common import written
from meterline.operators.bounded import broadcast_if_small
from meterline.session import settled

#: Bins of one node in one round.
BINS = 1024
#: Documents that one task numbers.
CHUNK_ROWS = 200_000
#: Most values of a text dimension that are broadcast to be numbered.
MOST_VALUES = 50_000
#: The dimensions, in the order that breaks ties of width.
DIMENSIONS = ("lang", "source", "n_chars", "doc_id")


def _numbered(rows: DataFrame, column: str) -> DataFrame:
    """(_value, _rank) of the distinct values of a column of texts, in the order of their bytes.

    Ranges of the values are tasks that number their own; only the tasks' counts meet.
    """
    values = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("_value")).distinct()
    dealt = values.repartitionByRange("_value").sortWithinPartitions("_value")
    dealt = written(dealt.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "values")
    parts = dealt.groupBy("_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    shift = parts.select("_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return dealt.join(F.broadcast(shift), "_part").select("_value", (F.col("_row") + F.col("_shift")).alias("_rank"))


def _ranked(rows: DataFrame, column: str) -> DataFrame:
    """`rows` with the texts of `column` replaced by their numbers; a null stays null."""
    numbers = broadcast_if_small(_numbered(rows, column), MOST_VALUES)
    return rows.join(numbers, F.col(column) == F.col("_value"), "left").withColumn(column, F.col("_rank")).drop("_value", "_rank")


@dataclass
class Node:
    """A subtree: shards `first` to `first + shards - 1`; split at or below `cut` of `dim`."""

    first: int
    shards: int
    dim: int | None = None
    cut: tuple[int, int] | None = None
    low: Node | None = None
    high: Node | None = None

    def leaf(self) -> Column:
        """The first shard of the leaf that a row falls in."""
        if self.cut is None:
            return F.lit(self.first)
        value, tie = self.cut
        below = (F.col(f"_d{self.dim}") < value) | ((F.col(f"_d{self.dim}") == value) & (F.col("_tie") <= tie))
        return F.when(below, self.low.leaf()).otherwise(self.high.leaf())


def _widest(ranges: list[tuple[int, int]], whole: list[tuple[int, int]]) -> int:
    share = [(hi - lo) / max(1, top - bottom) for (lo, hi), (bottom, top) in zip(ranges, whole, strict=True)]
    return max(range(len(share)), key=lambda k: (share[k], -k))


def _medians(rows: DataFrame, wanted: dict[int, tuple[int, float]]) -> dict[int, tuple[int, int]]:
    """Per node (its leaf number): the last (value, tie) of the lower side, where `wanted` = (dimension, bytes below).

    `rows` has `_leaf`, `_size`, `_tie` and the dimensions.
    """
    done: dict[int, tuple[int, int]] = {}
    # Per node: the value range being searched, the tie range inside one value, the bytes before the range.
    search = {n: {"value": None, "tie": None, "before": 0} for n in wanted}
    while search:
        position, inside = F.lit(None).cast("long"), F.lit(False)
        width = F.lit(None).cast("decimal(20,0)")
        base = F.lit(None).cast("long")
        for n, s in search.items():
            dim = F.col(f"_d{wanted[n][0]}")
            at = F.col("_leaf") == n
            if s["tie"] is not None:
                v, (lo, hi) = s["value"], s["tie"]
                at, pos = at & (dim == v) & F.col("_tie").between(lo, hi), F.col("_tie")
            else:
                lo, hi = s["value"] or (None, None)
                pos = dim
                at = at & dim.between(lo, hi) if lo is not None else at
            if lo is not None:
                step = max(1, -(-(hi - lo + 1) // BINS))
                position, base = F.when(at, pos).otherwise(position), F.when(at, F.lit(lo)).otherwise(base)
                width = F.when(at, F.lit(str(step)).cast("decimal(20,0)")).otherwise(width)
            else:
                position, base = F.when(at, pos).otherwise(position), F.when(at, pos).otherwise(base)
                width = F.when(at, F.lit("1").cast("decimal(20,0)")).otherwise(width)
            inside = inside | at
        offset = position.cast("decimal(20,0)") - base.cast("decimal(20,0)")
        binned = rows.where(inside).select("_leaf", "_size", position.alias("_pos"),
                                           F.floor(offset / width).cast("int").alias("_bin"))
        sums = binned.groupBy("_leaf", "_bin").agg(
            F.sum("_size").alias("size"), F.min("_pos").alias("lo"), F.max("_pos").alias("hi")).collect()
        by_node: dict[int, list] = {}
        for r in sums:
            by_node.setdefault(r["_leaf"], []).append(r)
        for n, s in list(search.items()):
            bins = sorted(by_node.get(n, []), key=lambda r: r["lo"])
            if not bins:
                del search[n]
                continue
            target, before, found = wanted[n][1], s["before"], bins[-1]
            for r in bins:
                if before + r["size"] >= target:
                    found = r
                    break
                before += r["size"]
            else:
                before -= bins[-1]["size"]
            s["before"] = before
            single = found["lo"] == found["hi"]
            if s["tie"] is not None:
                if single:
                    # The key that holds the median goes to the side where it leaves the smaller error.
                    above = target - before < before + found["size"] - target and found["lo"] > -(1 << 63)
                    done[n] = (s["value"], found["lo"] - above)
                    del search[n]
                else:
                    s["tie"] = (found["lo"], found["hi"])
            elif single and s["value"] is not None:
                s["value"], s["tie"] = found["lo"], (-(1 << 63), (1 << 63) - 1)
            else:
                s["value"] = (found["lo"], found["hi"])
    return done


def grow(rows: DataFrame, shards: int, dims: int) -> Node:
    """The tree over `rows` (`_size`, `_tie`, `_d0` ...)."""
    root, whole = Node(0, shards), None
    open_nodes = [root] if shards > 1 else []
    while open_nodes:
        placed = rows.withColumn("_leaf", root.leaf())
        facts = placed.groupBy("_leaf").agg(F.sum("_size").alias("size"), *[
            f(f"_d{k}").alias(f"{side}{k}") for k in range(dims) for side, f in (("lo", F.min), ("hi", F.max))]).collect()
        ranges = {r["_leaf"]: (r["size"], [(r[f"lo{k}"], r[f"hi{k}"]) for k in range(dims)]) for r in facts}
        if whole is None and ranges:
            whole = next(iter(ranges.values()))[1]
        open_nodes = [n for n in open_nodes if n.first in ranges]
        wanted = {}
        for n in open_nodes:
            size, spans = ranges[n.first]
            n.dim = _widest(spans, whole)
            wanted[n.first] = (n.dim, size * (n.shards // 2) / n.shards)
        cuts = _medians(placed.where(F.col("_leaf").isin(list(wanted))), wanted) if wanted else {}
        following = []
        for n in open_nodes:
            n.cut = cuts[n.first]
            n.low = Node(n.first, n.shards // 2)
            n.high = Node(n.first + n.shards // 2, n.shards - n.shards // 2)
            following += [m for m in (n.low, n.high) if m.shards > 1]
        open_nodes = following
    return root


def shard(docs: DataFrame, shards: int = 24, target_bytes: int | None = None,
          dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every document in one leaf of the tree.

    With `target_bytes` the number of shards follows from the table's bytes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = dict(docs.dtypes)
    narrow = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("_size"),
                         F.crc32(text.cast("binary")).alias("_crc"), F.xxhash64("doc_id", "text").alias("_tie"),
                         *[F.col(d).cast("string" if kinds[d] == "string" else "long").alias(f"_d{k}")
                           for k, d in enumerate(dimensions)])
    narrow = settled(narrow)
    texts = [f"_d{k}" for k, d in enumerate(dimensions) if kinds[d] == "string"]
    for column in texts:
        narrow = _ranked(narrow, column)
    narrow = settled(narrow) if texts else narrow
    dims = len(dimensions)
    facts = narrow.agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("size"),
                       *[F.min(f"_d{k}").alias(f"lo{k}") for k in range(dims)]).first()
    filled = narrow.fillna({f"_d{k}": facts[f"lo{k}"] or 0 for k in range(dims)})
    if target_bytes:
        shards = max(1, round((facts["size"] or 0) / target_bytes))
    placed = filled.withColumn("shard", grow(filled, shards, dims).leaf())
    chunks = max(1, -(-facts["n"] // (shards * CHUNK_ROWS)))
    placed = placed.withColumn("_chunk", F.pmod(F.col("_tie"), F.lit(chunks)))
    numbered = placed.withColumn("_place", F.row_number().over(
        Window.partitionBy("shard", "_chunk").orderBy("_tie", "doc_id")).cast("long"))
    counts = placed.groupBy("shard", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(F.col("shard").alias("_shard"), F.col("_chunk").alias("_of"), (F.sum("_n").over(
        Window.partitionBy("shard").orderBy("_chunk")) - F.col("_n")).alias("_before"))
    met = numbered.join(before, (numbered["shard"] == before["_shard"]) & (numbered["_chunk"] == before["_of"]))
    return met.select("doc_id", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "shard",
                      (F.col("_before") + F.col("_place") - 1).alias("slot"))

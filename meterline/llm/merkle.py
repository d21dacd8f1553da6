"""Merkle manifest of a dataset: a leaf per row, a tree per group, a tree over the groups, a witness per row.

Leaves are appended in order to the tree of their group. An append keeps the open subtrees, one
per height. A new node that meets an open subtree of its own height completes it: the rows of the left half get
the right half's root into their witness, those of the right half the left one's. So a witness is
partial as long as its subtree is open, and every later completion of a sibling extends it.

The appends are distributed by aligned blocks: 2^`levels` consecutive leaves make one task's
appends, whatever the size of their group. The root of a block is a node like any other, and the roots
of a group's blocks are appended further, in blocks again, until one is left. A row's witness is
its block's part and then that of the block. The roots of the groups are appended in the same way.

A node is the SHA-256 of the concatenated hexadecimal digests of its two children; a last child without a
sibling rises alone, as the hash of its own digest. Order is by the columns named, then by the leaf.

Defined cases. A null group is a group and comes first; other groups go by the bytes of their text. Null order values come first;
equal rows are a leaf each. A null field is `-`. An empty table gives an empty table. A table of one row has
the leaf as its root. Extra columns take no part, and those named like added ones are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterline.llm.common import written
from meterline.session import folder_exists

#: Height of the blocks that one task appends.
LEVELS = 12
DIGEST = 32


def field(value: Column) -> Column:
    """A value told apart from its neighbours: `-`, or its length in bytes, a colon and itself."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def hashed(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class Appends:
    """The open subtrees of a run of nodes, and the witness of each node so far."""

    def __init__(self):
        self.open: list[tuple[int, str, int]] = []  # height, root, first node
        self.witnesses: list[list[str]] = []

    def append(self, digest: str) -> None:
        self.witnesses.append([])
        node = (0, digest, len(self.witnesses) - 1)
        while self.open and self.open[-1][0] == node[0]:
            node = self._joined(self.open.pop(), node)
        self.open.append(node)

    def _joined(self, left: tuple[int, str, int], right: tuple[int, str, int]) -> tuple[int, str, int]:
        for witness in self.witnesses[left[2]:right[2]]:
            witness.append(right[1])
        for witness in self.witnesses[right[2]:]:
            witness.append(left[1])
        return left[0] + 1, hashed(left[1], right[1]), left[2]

    def closed(self, height: int) -> str:
        """The root at `height`, after which nothing can be appended: last nodes rise without a sibling."""
        node = self.open.pop()
        while node[0] < height:
            if self.open and self.open[-1][0] == node[0]:
                node = self._joined(self.open.pop(), node)
            else:
                node = (node[0] + 1, hashed(node[1]), node[2])
        return node[1]


def climbed(digest: str, place: int, nodes: int, witness: Iterator[str]) -> str:
    """The root above node `place` of `nodes`, by the siblings in its witness."""
    while nodes > 1:
        if place ^ 1 < nodes:
            sibling = next(witness)
            digest = hashed(sibling, digest) if place & 1 else hashed(digest, sibling)
        else:
            digest = hashed(digest)
        place, nodes = place >> 1, (nodes + 1) >> 1
    return digest


def placed(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """`rows` with `place`, gapless from 0 within `key` in the given order, and `nodes`, the rows of the key.

    A range shuffle on key and order, so a key of any size is many tasks.
    """
    dealt = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    dealt = written(dealt.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "ordered")
    runs = dealt.groupBy(key, "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(key)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(key, "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
                       F.sum("_rows").over(whole).alias("nodes"))
    return dealt.join(runs, [key, "_part"]).withColumn("place", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")


_BLOCKED = "key string, place long, nodes long, root string, witness binary"


def blocked(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(key, place, nodes, root, witness) of (key, place, nodes, digest): the root of the node's block, its siblings there as bytes from below."""
    out = pa.schema([("key", pa.string()), ("place", pa.int64()), ("nodes", pa.int64()), ("root", pa.string()), ("witness", pa.binary())])

    def append_all(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        count = table["nodes"][0].as_py()
        block = Appends()
        for digest in table["digest"].to_pylist():
            block.append(digest)
        # The blocks of one key all end at the same height; a key within one block ends where one node is left.
        root = block.closed(levels if count > 1 << levels else (count - 1).bit_length())
        return pa.table([table["key"], table["place"], table["nodes"], pa.array([root] * len(table)),
                         pa.array([bytes.fromhex("".join(w)) for w in block.witnesses], pa.binary())], schema=out)

    dealt = nodes.select("key", "place", "nodes", "digest", F.shiftright("place", levels).alias("block"))
    return dealt.groupBy("key", "block").applyInArrow(append_all, _BLOCKED)


def raised(done: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(key, place, root, witness) of blocks that are done: their roots are appended further, their rows' witnesses extended."""
    most = done.agg(F.max("nodes")).first()[0] or 0
    if most <= 1 << levels:
        return done.select("key", "place", "root", "witness")
    block = F.shiftright("place", levels)
    heads = done.where(F.pmod("place", F.lit(1 << levels)) == 0).select(
        "key", block.alias("place"), F.shiftright(F.col("nodes") + ((1 << levels) - 1), levels).alias("nodes"), F.col("root").alias("digest"))
    above = tree(heads, levels).select(F.col("key").alias("_key"), F.col("place").alias("_block"), F.col("root").alias("_root"),
                                       F.col("witness").alias("_above"))
    return done.join(above, (F.col("key") == F.col("_key")) & (block == F.col("_block"))).select(
        "key", "place", F.col("_root").alias("root"), F.concat("witness", "_above").alias("witness"))


def tree(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(key, place, root, witness) of (key, place, nodes, digest): the root of the key, all siblings as bytes from below."""
    return raised(written(blocked(nodes, levels), "blocks"), levels)


def _key(group: Column) -> Column:
    return F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group.cast("string")))


def manifest(rows: DataFrame, group: str, order: str, leaf_of: Column, levels: int = LEVELS, **carried: Column) -> DataFrame:
    """A row per row of the table: its order value, leaf, place and witness in its group, those of its group, and the root.

    `witness` and `group_witness` hold the siblings' digests, 32 bytes each, from the leaf up.
    """
    leaves = written(rows.select(_key(F.col(group)).alias("key"), F.col(order).alias("order"), leaf_of.alias("digest"),
                                 *[c.alias(n) for n, c in carried.items()]), "leaves")
    ordered = written(placed(leaves, "key", "order", "digest"), "placed")
    return _listed(ordered, tree(ordered, levels), levels, order, *carried)


def _listed(ordered: DataFrame, own: DataFrame, levels: int, order: str, *carried: str) -> DataFrame:
    """The rows (key, place, nodes, order, digest) with their witnesses `own`, and those of the groups' roots."""
    groups = own.where("place = 0").select(F.lit("").alias("key"), F.col("key").alias("group"), F.col("root").alias("digest"))
    groups = placed(groups, "key", "group")
    top = tree(groups, levels).select("place", "root", "witness")
    above = groups.join(top, "place").select(
        F.col("group").alias("key"), F.col("digest").alias("subroot"), F.col("place").alias("group_place"),
        F.col("nodes").alias("groups"), F.col("witness").alias("group_witness"), "root")
    # One row per group meets blocks of a group first: a group of a third of all rows is not one task's join.
    block = F.shiftright("place", levels)
    blocks = ordered.select("key", block.alias("_block")).distinct().join(above, "key")
    return ordered.withColumn("_block", block).join(own.select("key", "place", "witness"), ["key", "place"]).join(
        blocks, ["key", "_block"]).select(
        F.col("order").alias(order), F.col("digest").alias("leaf"), *carried, "place", "nodes", "witness", "subroot",
        "group_place", "groups", "group_witness", "root")


class Ledger:
    """A manifest that grows by batches, below a folder. Rows of a batch come after all earlier rows of their group.

    A block that is full is written once with its rows' witnesses and never again. The last block of each group stays open: its leaves,
    fewer than 2^`levels` a group, are appended again with the next batch. What later batches add to the witnesses
    of earlier rows lies above their blocks' roots, and only those are appended further by `manifest`.

    Batches count from 1. One that is repeated replaces what it had written.
    """

    FULL = "order long, digest string, key string, place long, nodes long, root string, witness binary, batch int"
    OPEN = "key string, place long, order long, digest string, batch int"
    COUNTS = "key string, nodes long, batch int"

    def __init__(self, spark: SparkSession, path: str, levels: int = LEVELS):
        self.spark, self.path, self.levels = spark, path, levels

    def _read(self, name: str, schema: str) -> DataFrame:
        if not folder_exists(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def append(self, rows: DataFrame, group: str, order: str, leaf_of: Column, batch: int) -> None:
        leaves = written(rows.select(_key(F.col(group)).alias("key"), F.col(order).alias("order"), leaf_of.alias("digest")), "leaves")
        new = placed(leaves, "key", "order", "digest").drop("nodes")
        before = self._read("counts", self.COUNTS).where(F.col("batch") == batch - 1).select("key", F.col("nodes").alias("_before"))
        new = new.join(before, "key", "left").withColumn("place", F.col("place") + F.coalesce("_before", F.lit(0))).drop("_before")
        still = self._read("open", self.OPEN).where(F.col("batch") == batch - 1).select("key", "place", "order", "digest")
        nodes = written(new.select("key", "place", "order", "digest").unionByName(still), "nodes")
        counts = written(nodes.groupBy("key").agg((F.max("place") + 1).alias("nodes")).unionByName(
            before.join(nodes.select("key").distinct(), "key", "left_anti").select("key", F.col("_before").alias("nodes"))), "counts")
        known = nodes.join(counts, "key")
        complete = F.shiftright("nodes", self.levels) > F.shiftright("place", self.levels)
        full = known.where(complete)
        made = blocked(full, self.levels)
        self._write(full.select("key", "place", "order", "digest").join(made, ["key", "place"]).select(
            *[f.split()[0] for f in self.FULL.split(", ")[:-1]]), "full", batch)
        self._write(known.where(~complete).select("key", "place", "order", "digest"), "open", batch)
        self._write(counts, "counts", batch)

    def manifest(self, batch: int, order: str = "order") -> DataFrame:
        """The rows of `manifest` over all batches up to `batch`."""
        counts = self._read("counts", self.COUNTS).where(F.col("batch") == batch).select("key", "nodes")
        full = self._read("full", self.FULL).where(F.col("batch") <= batch)
        still = self._read("open", self.OPEN).where(F.col("batch") == batch).select("key", "place", "order", "digest").join(counts, "key")
        last = written(blocked(still, self.levels), "open")
        rows = full.select("key", "place", "order", "digest").join(counts, "key").unionByName(still.select("key", "place", "order", "digest", "nodes"))
        done = full.select("key", "place", "root", "witness").join(counts, "key").unionByName(last)
        return _listed(written(rows, "placed"), raised(written(done, "blocks"), self.levels), self.levels, order)


def checked(listed: DataFrame, order: str, claimed: str) -> DataFrame:
    """Climb from the leaves in column `claimed` by the stored witnesses.

    (order, leaf, subroot, root, proof_sha256, folded_root, verified)
    """
    out = pa.schema([(order, pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
                     ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = []
            for r in batch.to_pylist():
                proof = (r["witness"] + r["group_witness"]).hex()
                siblings = (proof[i:i + 2 * DIGEST] for i in range(0, len(proof), 2 * DIGEST))
                below = climbed(r[claimed], r["place"], r["nodes"], siblings)
                root = climbed(below, r["group_place"], r["groups"], siblings)
                answers.append((r[order], r["leaf"], r["subroot"], r["root"], hashed(proof), root, root == r["root"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*answers, strict=True), out, strict=True)]
                                             if answers else [pa.array([], f.type) for f in out], schema=out)

    return listed.mapInArrow(climb, f"{order} long, leaf string, subroot string, root string, proof_sha256 string, "
                             "folded_root string, verified boolean")

"""Connected components of an edge table, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.session import settled

SALTS = 8


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """(u, v, m): every edge with the least neighbour of u.

    A node with very many neighbours is one partial minimum per task; its edges meet it under a salt.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(least, ["u", "salt"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    met = _least_neighbour(both).where("v > u")
    return met.select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    met = _least_neighbour(edges)
    moved = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(met.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that each node of an edge (a, b) reaches.

    Large and small stars in turn, until every node hangs on its label. A round at least halves the
    depth, and each is written to the shared folder, so lineage stays short.
    """
    tidy = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v")
    now = settled(tidy.distinct())
    before = None
    while True:
        facts = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if facts == before or not facts[0]:
            break
        before = facts
        now = settled(_small_star(_large_star(now)).distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("label"))

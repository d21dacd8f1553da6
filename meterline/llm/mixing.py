"""Mixing sources to target weights by Poisson replication.

Every source gets a repetition rate: the share of the output it should fill, over
the share it has. A document's count is Poisson with that rate as its mean, by
inverting the distribution at a number hashed from seed and id, so a rerun of a
lost task draws the same count. The copies are then dealt out by a second hash.

Rates beyond `SPLIT` are drawn as a sum of independent parts, as e^-rate would
vanish; a source that must be repeated many thousand times needs no other path.

Defined cases. A null source is a source of its own. A null text has size 1, like
an empty one (sizes are UTF-8 bytes plus 1, so every source has a finite rate). A
null id draws as an empty one. Equal ids in one source draw equal counts; rows are
replicated one by one, so repeated rows stay repeated. An empty table gives an
empty table. Columns named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.llm.common import draw, unit
from meterline.operators.bounded import broadcast_if_small
from meterline.session import settled

#: Largest mean of one drawn part.
SPLIT = 32.0
#: Rates are rounded to so many decimals, so the order of a floating sum cannot show.
DECIMALS = 9


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5,
                 epochs: float = 1.0) -> DataFrame:
    """(source, rate): the mean number of copies of each document of a source.

    `weights` are the target shares by source, normalised over the sources that the
    table has; a source it does not name gets none. Without `weights` the share is
    size ^ temperature. The output is `epochs` times as large as the input.
    """
    sizes = settled(docs.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("size")))
    if weights is None:
        wanted = F.pow(F.col("size").cast("double"), F.lit(float(temperature)))
    else:
        pairs = [F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]
        wanted = F.coalesce(F.create_map(*pairs)[F.col("source")] if pairs else F.lit(0.0), F.lit(0.0))
    weighed = sizes.withColumn("wanted", wanted)
    total = weighed.agg(F.sum("size").alias("size"), F.sum("wanted").alias("wanted")).first()
    if not total["wanted"]:
        return weighed.select("source", F.lit(0.0).alias("rate"))
    scale = float(total["size"]) * epochs / total["wanted"]
    return weighed.select("source", F.round(F.col("wanted") * F.lit(scale) / F.col("size"), DECIMALS).alias("rate"))


def distribution(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson variable, as far as a double tells from 1."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["c"])


def replicate(docs: DataFrame, rates: DataFrame, seed: int = 0) -> DataFrame:
    """Each document as often as its draw says, with its `copy` number, dealt out by `mix_key`."""
    parts = F.greatest(F.ceil(F.col("rate") / SPLIT), F.lit(1)).cast("int")
    drawn = rates.select(F.col("source").alias("_source"), F.col("rate").alias("rate"), parts.alias("_parts"))
    drawn = settled(drawn.withColumn("_cdf", distribution(F.col("rate") / F.col("_parts"))))
    own = docs.drop("rate", "copy", "mix_key")
    met = own.join(broadcast_if_small(drawn, 10_000), own["source"].eqNullSafe(drawn["_source"]))
    draws = F.transform(F.sequence(F.lit(1), F.col("_parts")), lambda j: unit(str(seed), F.col("doc_id"), j))
    count = F.aggregate(draws, F.lit(0), lambda n, u: n + F.size(F.filter("_cdf", lambda c: c <= u)))
    counted = met.select(*own.columns, "rate", count.alias("_n")).where("_n > 0")
    copies = counted.select(*own.columns, "rate", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"))
    keyed = copies.withColumn("mix_key", draw(str(seed), F.lit("deal"), F.col("doc_id"), F.col("copy")))
    return keyed.repartition("mix_key").sortWithinPartitions("mix_key", "doc_id", "copy")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0,
        seed: int = 0) -> DataFrame:
    """The documents in the target proportions and in an order of their own."""
    return replicate(docs, source_rates(docs, weights, temperature, epochs), seed)

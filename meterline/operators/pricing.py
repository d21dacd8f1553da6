"""Price files, model resolution and costs (SRC16, J1-J3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.functions import money
from meterline.functions.price_list import bundled_prices, bundled_rows
from meterline.operators.bounded import broadcast_if_small
from meterline.session import settled

RATES = ("input_rate", "output_rate", "creation_rate", "read_rate")
MAX_LITERAL_KEYS = 2_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_RATE_FIELDS = {
    "input_rate": "input_cost_per_token",
    "output_rate": "output_cost_per_token",
    "creation_rate": "cache_creation_input_token_cost",
    "read_rate": "cache_read_input_token_cost",
}


def load_prices(spark: SparkSession, path: str) -> DataFrame:
    """A price file (model -> rates) as rows; absent rates are 0, unknown fields ignored."""
    fields = ", ".join(f"{f}: double" for f in [*_RATE_FIELDS.values()])
    schema = f"map<string, struct<{fields}, max_input_tokens: bigint>>"
    text = spark.read.text(path, wholetext=True)
    book = text.select(F.posexplode(F.from_json("value", schema)).alias("position", "price_key", "r"))
    return book.select(
        "position", "price_key",
        *[F.coalesce(F.col(f"r.{source}"), F.lit(0.0)).cast(money.RATE).alias(name)
          for name, source in _RATE_FIELDS.items()],
        F.col("r.max_input_tokens").alias("max_input_tokens"))


def _short_list(prices: DataFrame | None, max_literal_keys: int) -> list[str] | None:
    """Keys of a short price list, longest first and then in file order; None for a long one."""
    if prices is None:
        head = [(key, position) for position, key, *_ in bundled_rows()]
    else:
        head = [tuple(r) for r in prices.select("price_key", "position").limit(max_literal_keys + 1).collect()]
    if len(head) > max_literal_keys:
        return None
    return [k for k, _ in sorted(head, key=lambda kp: (-len(kp[0].encode()), kp[1]))]


def _key_of_model(ranked: list[str]) -> Column:
    """Price key of the column `model` against a short list: exact, after the last '/', lower case, longest inside."""
    if not ranked:
        return F.lit(None).cast("string")
    keys = ", ".join("'" + k.replace("\\", "\\\\").replace("'", "\\'") + "'" for k in ranked)
    base = "substring_index(model, '/', -1)"
    lowered = f"translate({base}, '{_UPPER}', '{_UPPER.lower()}')"

    def exact(candidate: str) -> str:
        return f"CASE WHEN {candidate} IN ({keys}) THEN {candidate} END"

    # The outer lambda binds the lower-cased name, so it is not derived again for every key.
    longest = (f"get(transform(array({lowered}), "
               f"h -> get(filter(array({keys}), k -> k <> '' AND contains(h, k)), 0)), 0)")
    return F.expr(f"coalesce({exact('model')}, {exact(base)}, {exact(lowered)}, {longest})")


def resolve_models(models: DataFrame, prices: DataFrame,
                   max_literal_keys: int = MAX_LITERAL_KEYS) -> DataFrame:
    """Distinct `model` names -> price key.

    The last step needs every key against a name. A short price list becomes a
    literal that each name tests in place; a long one is met by an equi-join on
    the substrings of the name, so neither is a product of two tables.
    """
    distinct = models.select("model").distinct()
    ranked = _short_list(prices, max_literal_keys)
    if ranked is not None:
        return distinct.select("model", _key_of_model(ranked).alias("price_key"))

    keys = prices.select("price_key", "position")
    base = F.substring_index("model", "/", -1)
    names = distinct.select("model", base.alias("base"), F.translate(base, _UPPER, _UPPER.lower()).alias("lowered"))
    exact_hits = names.select(
        "model", F.posexplode(F.array("model", "base", "lowered")).alias("stage", "candidate")
    ).join(keys.withColumnRenamed("price_key", "candidate"), "candidate").groupBy("model").agg(
        F.min_by("candidate", "stage").alias("exact_key"))
    # Only pieces as long as some key: there are few lengths, however many keys.
    lengths = keys.filter(F.col("price_key") != "").agg(F.collect_set(F.length("price_key"))).scalar()
    pieces = names.withColumn("lengths", lengths).select(
        "model", "lowered", F.explode("lengths").alias("n")).filter(F.length("lowered") >= F.col("n")).select(
        "model", F.explode(F.transform(
            F.sequence(F.lit(1), F.length("lowered") - F.col("n") + 1),
            lambda at: F.substring(F.col("lowered"), at, F.col("n")))).alias("candidate")).distinct()
    fuzzy = pieces.join(keys.withColumnRenamed("price_key", "candidate"), "candidate").groupBy("model").agg(
        F.max_by("candidate", F.struct(F.octet_length("candidate"), -F.col("position"))).alias("fuzzy_key"))
    return (names.select("model").join(exact_hits, "model", "left").join(fuzzy, "model", "left")
            .select("model", F.coalesce("exact_key", "fuzzy_key").alias("price_key")))


def model_rates(models: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Distinct models with their rates; null rates where nothing resolves."""
    prices = bundled_prices(models.sparkSession) if prices is None else prices
    return (resolve_models(models, prices)
            .join(prices.select("price_key", *RATES), "price_key", "left"))


def _with_cost(rated: DataFrame) -> DataFrame:
    return rated.withColumn("cost_usd", money.cost_of(*[F.col(r) for r in RATES])).drop(*RATES)


def price_rows(events: DataFrame, prices: DataFrame | None = None, rates: DataFrame | None = None) -> DataFrame:
    """Single events with `cost_usd`, null when unpriced.

    Names are resolved once per distinct model, written, and joined back: events are read for the names and
    for the join. `rates` is a stored `model_rates` table, or one the caller has sized.
    """
    rates = broadcast_if_small(settled(model_rates(events, prices))) if rates is None else rates
    return _with_cost(events.join(rates.select("model", *RATES), "model", "left"))


def price(cells: DataFrame, prices: DataFrame | None = None, rates: DataFrame | None = None) -> DataFrame:
    """Aggregated cells that keep `model` with `cost_usd`, null when unpriced.

    Cells are few, so a short price list is tested in place: no distinct, no
    second pass. A long list or stored `rates` take the way of single events.
    """
    ranked = _short_list(prices, MAX_LITERAL_KEYS) if rates is None else None
    prices = bundled_prices(cells.sparkSession) if prices is None else prices
    if ranked is None:
        return price_rows(cells, prices, rates)
    keyed = cells.withColumn("price_key", _key_of_model(ranked))
    # At most MAX_LITERAL_KEYS rows: counted just above.
    return _with_cost(keyed.join(F.broadcast(prices.select("price_key", *RATES)), "price_key", "left")).drop(
        "price_key")


def unpriced_models(models: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Distinct models no price resolves for."""
    prices = bundled_prices(models.sparkSession) if prices is None else prices
    return resolve_models(models, prices).filter(F.col("price_key").isNull()).select("model")

import re

from pyspark.sql import functions as F

from meterline.operators import keystore


def keyed(spark, names, agent="claude"):
    return spark.createDataFrame([(agent, n) for n in names], "agent string, dedup_key string")


def stored(spark, path, names, generation, agent="claude"):
    return {r["dedup_key"] for r in keystore.matching(spark, path, keyed(spark, names, agent), generation).filter(
        F.col("agent") == agent).collect()} & set(names)


def test_every_stored_key_is_found_and_nothing_else_is_claimed(spark, tmp_path):
    path = str(tmp_path / "keys")
    assert stored(spark, path, ["a"], 1) == set()
    first, second = [f"m{k}" for k in range(3000)], [f"n{k}" for k in range(500)]
    keystore.add(keyed(spark, [*first, None]), path, 1)
    keystore.add(keyed(spark, second), path, 2)
    asked = [*first[::7], *second[::3], *[f"x{k}" for k in range(200)], None]
    assert stored(spark, path, asked, 3) == {*first[::7], *second[::3]}
    assert stored(spark, path, first[:5], 3, agent="codex") == set()
    assert stored(spark, path, [None], 3) == set()
    # A generation that is repeated does not see its own keys, and replaces them.
    assert stored(spark, path, [*first[:9], *second[:9]], 2) == set(first[:9])
    keystore.add(keyed(spark, ["other"]), path, 2)
    assert stored(spark, path, [*second[:9], "other"], 3) == {"other"}


def test_a_few_keys_open_a_few_folders(spark, tmp_path):
    path = str(tmp_path / "keys")
    for generation in range(1, 4):
        keystore.add(keyed(spark, [f"g{generation}-{k}" for k in range(2000)]), path, generation)
    pairs = keystore.hits(spark, path, keyed(spark, ["g2-17", "never", "seen"]), 9)
    assert 1 <= len(pairs) <= 4 and 2 in {g for g, _ in pairs}
    found = keystore.matching(spark, path, keyed(spark, ["g2-17", "never", "seen"]), 9)
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan)[1]
    assert "generation" in filters and "bucket" in filters
    # The folders that the plan lets through hold few of the 6000 keys.
    files = {r["f"] for r in found.select(F.input_file_name().alias("f")).collect()}
    assert found.count() < 60 and len(files) == len(pairs)

"""Every query of the subpackage against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from meterline.llm.queries import ORACLES, QUERIES
from tests.compare import compare, oracle

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, name):
    verdict = compare(spark, oracle(SF_DIR), name, SF_DIR)
    assert verdict.startswith("ok"), verdict


def test_all_operators_are_registered():
    names = {n.split("_")[0] for n in QUERIES}
    assert {f"op{k}" for k in range(1, 11)} <= names
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())

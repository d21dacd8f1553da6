"""Every registered query against its SQL on the small tables."""

import pytest

import __spark_entry__ as entry
from meterline.catalog import QUERIES
from tests.compare import compare, oracle

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    verdict = compare(spark, con, name, SF_DIR)
    assert verdict.startswith("ok"), verdict


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() == 5
    assert "project" in df.columns

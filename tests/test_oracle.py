"""Every registered query against its DuckDB oracle statement on the smallest tables
(the driver repeats this at sf0.01); queries without an oracle must at least run."""
import pytest

import __spark_entry__ as E
from tonekit.plans import QUERIES, load_all
from check_oracle import compare, duck

SF = "/root/testdata/sf0.001"
load_all()
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    msg, ok = compare(spark, con, name, E.queries()[name], E.oracle_sql().get(name), SF)
    assert ok, msg


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "anger_dev" in df.columns


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(E.oracle_sql())

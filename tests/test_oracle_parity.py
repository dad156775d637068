"""Every registered query with an oracle equals DuckDB on the same parquet."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.oracle_check import check

SQL_NAMES = sorted(E.oracle_sql())
STREAM_NAMES = {"online_velocity", "stream_scores"}


@pytest.mark.parametrize("name", [n for n in SQL_NAMES if n not in STREAM_NAMES])
def test_query_matches_oracle(spark, name):
    res = check(spark, SF_SMALL, [name], verbose=False)[name]
    assert res[0] == "OK", res


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert set(["tx_frequency_1h", "tx_frequency_24h", "zscore_x_frequency"]) <= set(df.columns)


def test_every_query_has_a_builder():
    qs = E.queries()
    assert set(E.oracle_sql()) <= set(qs)
    assert len(qs) >= 70


def test_entry_schema_is_stable(spark):
    a = E.entry(spark).schema
    b = E.entry(spark).schema
    assert a == b

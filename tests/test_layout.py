"""Bucketed feature table: same features, no exchange, hot customers and NULL customers aside."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from txsentinel.operators.features import engineer_features
from txsentinel.operators.layout import _bucketed_features, engineer_features_bucketed, write_layout
from txsentinel.plans import flow as P
from txsentinel.session import materialize


@pytest.fixture(scope="module")
def tx(spark):
    return materialize(P.labelled(spark, SF_SMALL), "layout-in")


def rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in sorted(df.dtypes)])


def same(got, want):
    got, want = rounded(got), rounded(want)
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_one_scan_and_no_exchange_after_the_write(spark, tx):
    layout = write_layout(tx, buckets=4)
    assert not layout.hot and layout.rest is None
    out = _bucketed_features(layout)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 1 and "Join" not in plan
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    same(out, engineer_features(tx))
    files = [f for f in layout.spark.table(layout.table).inputFiles()]
    assert len(files) <= 4
    layout.drop()
    assert not spark.catalog.tableExists(layout.table)


def test_hot_customer_and_rows_without_one(spark, tx):
    skewed = tx.withColumn("customer_id", F.when(F.col("tx_id") % 3 == 0, F.lit(-9223372036854775808))
                           .when(F.col("tx_id") % 17 == 1, F.lit(None)).otherwise(F.col("customer_id")))
    skewed = skewed.withColumn("timestamp", F.when(F.col("tx_id") % 29 != 5, F.col("timestamp")))
    layout = write_layout(skewed, buckets=8)
    assert layout.hot == [-9223372036854775808]
    assert spark.table(layout.table).where("customer_id IS NULL OR customer_id < 0").count() == 0
    same(engineer_features_bucketed(layout), engineer_features(skewed))


def test_without_times_empty_and_one_bucket(spark, tx):
    bare = tx.drop("timestamp")
    same(engineer_features_bucketed(write_layout(bare, buckets=4)), engineer_features(bare))
    assert engineer_features_bucketed(write_layout(tx.where("tx_id < 0"), buckets=4)).count() == 0
    holes = tx.withColumn("customer_id", F.when(F.col("tx_id") % 7 > 0, F.col("customer_id")))
    same(engineer_features_bucketed(write_layout(holes, buckets=1)), engineer_features(holes))

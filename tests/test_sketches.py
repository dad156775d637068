"""Mergeable sketches against exact ranks and counts."""

import pytest
from pyspark.sql import functions as F

from txsentinel.operators import sketches as sk


def test_quantiles_of_merged_slices_keep_their_rank(spark):
    rows = spark.range(60_000).select((F.col("id") % 7).alias("slice"), F.when(F.col("id") < 40_000, "a").otherwise("b")
                                      .alias("model"), (F.xxhash64("id") % 1_000_003).cast("double").alias("score"))
    parts = sk.score_sketches(rows, ["model", "slice"])
    assert parts.count() == 14
    quantiles = {"p01": 0.01, "p50": 0.5, "p95": 0.95}
    got = {r["model"]: r for r in sk.sketch_quantiles(
        sk.merge_score_sketches(parts, ["model"]), ["model"], quantiles).collect()}
    assert got["a"]["n"] == 40_000 and got["b"]["n"] == 20_000
    for model in "ab":
        for name, q in quantiles.items():
            share = rows.where(F.col("model") == model).agg(
                F.avg((F.col("score") <= got[model][name]).cast("double"))).first()[0]
            assert share == pytest.approx(q, abs=2 * sk.kll_rank_error())


def test_nulls_nans_and_empty_groups(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("b", None)], "model string, score double")
    got = sk.sketch_quantiles(sk.merge_score_sketches(sk.score_sketches(rows, ["model"]), ["model"]),
                              ["model"], {"t": 0.95}).orderBy("model").collect()
    assert [tuple(r) for r in got] == [("a", 1, 1.0), ("b", 0, None)]
    assert sk.score_sketches(rows.limit(0), ["model"]).count() == 0


def test_distinct_of_any_union_of_days(spark):
    rows = spark.range(50_000).select((F.col("id") % 10).alias("day"), (F.col("id") % 9_000).alias("customer_id"))
    days = sk.distinct_sketches(rows, ["day"])
    for picked in ([3], [1, 2, 4], list(range(10))):
        want = rows.where(F.col("day").isin(picked)).select("customer_id").distinct().count()
        got = sk.distinct_from_sketches(days.where(F.col("day").isin(picked))).first()[0]
        assert got == pytest.approx(want, rel=3 * sk.hll_relative_error())
    nulls = spark.createDataFrame([(1, None), (1, 5)], "day int, customer_id long")
    assert sk.distinct_from_sketches(sk.distinct_sketches(nulls, ["day"])).first()[0] == 1
    assert sk.distinct_from_sketches(sk.distinct_sketches(nulls.where("day > 1"), ["day"])).first()[0] in (0, None)

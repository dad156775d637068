"""Versions of the score table are whole or absent."""

import pytest
from pyspark.sql import functions as F

from txsentinel.sources import scores as sc

SCHEMA = "tx_id long, model string, label int, score double, prediction int"


def table(spark, *models, shift=0.0):
    return spark.createDataFrame([(i, m, i % 2, i / 10 + shift, 0) for m in models for i in range(5)], SCHEMA)


def rows(df):
    return sorted(tuple(r) for r in df.select("tx_id", "model", "label", "score", "prediction").collect())


def test_round_trip_update_and_pruning(spark, tmp_path):
    path = str(tmp_path / "scores")
    with pytest.raises(FileNotFoundError):
        sc.read_scores(spark, path)
    first = table(spark, "a", "b c/d%")
    sc.write_scores(first, path)
    assert rows(sc.read_scores(spark, path)) == rows(first)
    sc.write_scores(table(spark, "a", "new", shift=1.0), path, mode="update")
    want = table(spark, "a", "new", shift=1.0).unionByName(first.where("model = 'b c/d%'"))
    assert rows(sc.read_scores(spark, path)) == rows(want)
    only = sc.read_scores(spark, path, ["new"])
    assert rows(only) == rows(want.where("model = 'new'"))
    assert len(only.inputFiles()) and sc.read_scores(spark, path, ["nobody"]).count() == 0
    assert sc.drop_unused(spark, path) == [] and rows(sc.read_scores(spark, path)) == rows(want)
    sc.write_scores(first, path)
    assert len(sc.drop_unused(spark, path)) == 2 and rows(sc.read_scores(spark, path)) == rows(first)


def test_a_write_that_dies_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "scores")
    old = table(spark, "a", "b")
    sc.write_scores(old, path)
    broken = table(spark, "a", "b", shift=9.0).withColumn(
        "score", F.when(F.expr("model = 'b' AND tx_id = 4"), F.raise_error(F.lit("lost")).cast("double"))
        .otherwise(F.col("score")))
    with pytest.raises(Exception, match="lost"):          # between models
        sc.write_scores(broken, path)
    assert rows(sc.read_scores(spark, path)) == rows(old)
    monkeypatch.setattr(sc, "_announce", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):                          # behind the data, before the manifest
        sc.write_scores(table(spark, "a", shift=5.0), path)
    monkeypatch.undo()
    assert rows(sc.read_scores(spark, path)) == rows(old)
    assert len(sc.drop_unused(spark, path)) == 2

"""Shared pieces of the detectors: feature preparation and the score schema."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txsentinel.operators.scaling import Scaler, clean_features, fit_scaler
from txsentinel.schema import FEATURES


def prepared(df: DataFrame, scaler: Scaler, clip_bound: float | None) -> DataFrame:
    """Clean (NULL/NaN/Inf -> 0), standardise with ``scaler``, clip if asked."""
    clean = clean_features(df, scaler.features)
    return scaler.transform(clean, clip_bound=clip_bound)


def feature_array(features: list[str] | None = None) -> Column:
    return F.array(*[F.col(c).cast("double") for c in (features or FEATURES)])


def score_frame(df: DataFrame, model: str, score: Column, prediction: Column,
                label: str = "is_fraud") -> DataFrame:
    """Long score rows: (tx_id, model, label, score, prediction)."""
    lab = F.col(label).cast("int") if label in df.columns else F.lit(None).cast("int")
    return df.select(F.col("tx_id"), F.lit(model).alias("model"), lab.alias("label"),
                     score.cast("double").alias("score"), prediction.cast("int").alias("prediction"))


def verdict(score: Column, prediction: Column) -> Column:
    """struct(score, prediction): what a detector says about a row."""
    return F.struct(score.cast("double").alias("score"), prediction.cast("int").alias("prediction"))


def long_scores(df: DataFrame, model: str, column: str, label: str = "is_fraud") -> DataFrame:
    """Long score rows from a frame with a verdict column."""
    return score_frame(df, model, F.col(f"{column}.score"), F.col(f"{column}.prediction"), label)


def fit_feature_scaler(train: DataFrame, features: list[str] | None = None) -> Scaler:
    return fit_scaler(clean_features(train, features or FEATURES), features or FEATURES)


def save_meta(path: str, meta: dict) -> None:
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode(
        "overwrite").text(os.path.join(path, "meta"))


def load_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(os.path.join(path, "meta")).first()[0])


def save_scaler(path: str, scaler: Scaler) -> None:
    spark = SparkSession.getActiveSession()
    scaler.to_df(spark).write.mode("overwrite").parquet(os.path.join(path, "scaler"))


def load_scaler(spark: SparkSession, path: str) -> Scaler:
    df = spark.read.parquet(os.path.join(path, "scaler"))
    rows = {r["feature"]: r for r in df.collect()}
    feats = [f for f in FEATURES if f in rows] + [f for f in rows if f not in FEATURES]
    return Scaler(feats, [rows[f]["mean"] for f in feats], [rows[f]["std"] for f in feats])

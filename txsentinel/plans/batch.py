"""The three batch entry points, as Spark jobs that write their outputs.

The input of preprocess is either a transaction file of the user (CSV or
parquet, with or without tx_id and timestamp) or a driver folder with events.

preprocess: events -> TX -> labelled (written once, kept if present: S6/S7)
            -> 18 features -> parquet (S6)
train:      features -> split -> detectors (saved, S13) -> long score table
            partitioned by model (S9) + importances (S12)
evaluate:   score table (S10) -> tournament CSV (S11) + optimal thresholds
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txsentinel.operators import evaluate as ev
from txsentinel.operators.features import engineer_features
from txsentinel.operators.inject import inject_anomalies
from txsentinel.operators.ordered import positional_split_by_cut
from txsentinel.plans.flow import SPLIT_ORDER
from txsentinel.plans.training import TrainingConfig, train_all
from txsentinel.sources.adapters import event_transactions
from txsentinel.sources.scores import read_scores, write_scores
from txsentinel.sources.transactions import load_transactions, write_small_csv, write_table


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def preprocess(spark: SparkSession, source: str, out_dir: str, ratio: float = 0.02) -> DataFrame:
    """``source``: a transaction table (CSV or parquet), or a folder that holds events.parquet,
    whose rows become transactions with injected anomalies.  The raw table is kept in time order."""
    raw_path = os.path.join(out_dir, "raw_transactions")
    if not _exists(spark, raw_path):  # generate only if absent (S7)
        if _exists(spark, os.path.join(source, "events.parquet")):
            raw = inject_anomalies(event_transactions(spark, source), ratio=ratio)
        else:
            raw = load_transactions(spark, source)
        order = [c for c in ("timestamp", "tx_id") if c in raw.columns]
        write_table(raw.orderBy(*[F.col(c).asc_nulls_last() for c in order]), raw_path, mode="ignore")
    raw = load_transactions(spark, raw_path, fmt="parquet")
    feats_path = os.path.join(out_dir, "features")
    write_table(engineer_features(raw), feats_path)
    return spark.read.parquet(feats_path)


def train(spark: SparkSession, out_dir: str, config: TrainingConfig | None = None) -> DataFrame:
    feats_path = os.path.join(out_dir, "features")
    if not _exists(spark, feats_path):
        raise FileNotFoundError(f"engineered table not found: {feats_path}; run preprocess first")
    feats = spark.read.parquet(feats_path)
    order = [c for c in SPLIT_ORDER if c in feats.columns]  # by tx_id alone without a timestamp
    split = positional_split_by_cut(feats, order)
    detectors, scores = train_all(split, config, save_dir=os.path.join(out_dir, "models"))
    scores_path = os.path.join(out_dir, "scores")
    write_scores(scores, scores_path)
    if "gbt" in detectors:
        write_small_csv(detectors["gbt"].importances(), os.path.join(out_dir, "importances"))
    return read_scores(spark, scores_path)


def evaluate(spark: SparkSession, out_dir: str, models: list[str] | None = None) -> DataFrame:
    scores = read_scores(spark, os.path.join(out_dir, "scores"), models)
    table = ev.tournament(scores)
    write_small_csv(table.orderBy("rank"), os.path.join(out_dir, "tournament"))
    thresholds = ev.compare_thresholds(ev.optimal_threshold(ev.cumulative_counts(scores)))
    write_small_csv(thresholds.orderBy(F.col("rank")), os.path.join(out_dir, "thresholds"))
    return table

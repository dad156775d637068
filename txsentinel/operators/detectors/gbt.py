"""Boosted trees (M2-M5; fitted by histogram rounds, scored by MLlib): weighted positives, purged-fold search,
feature importances."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txsentinel.operators.detectors.base import (
    feature_array, fit_feature_scaler, load_meta, load_scaler, long_scores, prepared, save_meta, save_scaler, verdict,
)
from txsentinel.operators.detectors.boosting import boosted_trees
from txsentinel.operators.evaluate import classification_metrics
from txsentinel.operators.ordered import fold_roles
from txsentinel.operators.profile import scale_pos_weight
from txsentinel.operators.scaling import Scaler, assemble
from txsentinel.schema import CLIP_BOUND, FEATURES
from txsentinel.session import materialize

# Default parameters and the 4-point search grid
# (trees, depth, learning rate, row subsample).
DEFAULT_PARAMS = {"n_estimators": 300, "max_depth": 5, "learning_rate": 0.03, "subsample": 0.8}
PARAM_GRID = [
    {"n_estimators": 200, "max_depth": 4, "learning_rate": 0.05, "subsample": 0.8},
    {"n_estimators": 300, "max_depth": 5, "learning_rate": 0.03, "subsample": 0.8},
    {"n_estimators": 200, "max_depth": 6, "learning_rate": 0.05, "subsample": 0.7},
    {"n_estimators": 400, "max_depth": 4, "learning_rate": 0.01, "subsample": 0.9},
]


#: Bins a feature is cut into at most.
BINS = 64


def _boosted(data: DataFrame, params: dict, positive_weight: float, seed: int) -> GBTClassificationModel:
    """The classifier of ``params`` on the columns features and _label, fraud rows weighted."""
    return boosted_trees(data, len(FEATURES), trees=int(params["n_estimators"]), depth=int(params["max_depth"]),
                         rate=float(params["learning_rate"]), subsample=float(params["subsample"]),
                         positive_weight=positive_weight, bins=BINS, seed=seed)


def _labelled(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    return df.withColumn("_label", F.col(label).cast("double"))


def positive_weight(train: DataFrame, label: str = "is_fraud") -> float:
    """A6 as a number: n_neg / max(n_pos, 1)."""
    return float(scale_pos_weight(train, label).first()["scale_pos_weight"])


@dataclass
class GBTDetector:
    name: str = "gbt"
    params: dict = field(default_factory=lambda: dict(DEFAULT_PARAMS))
    seed: int = 42
    scaler: Scaler | None = None
    model: GBTClassificationModel | None = None
    features: list[str] = field(default_factory=lambda: list(FEATURES))

    def fit(self, train: DataFrame, params: dict | None = None) -> "GBTDetector":
        """M2: scale + clip on train statistics, positive rows weighted by n_neg/n_pos."""
        if params:
            self.params = dict(params)
        self.scaler = fit_feature_scaler(train, self.features)
        spw = positive_weight(train)
        data = _labelled(prepared(train, self.scaler, CLIP_BOUND))
        data = data.select(feature_array(self.features).alias("features"), "_label")
        self.model = _boosted(data, self.params, spw, self.seed)
        return self

    def add_verdict(self, df: DataFrame, out: str) -> DataFrame:
        """M3: P(fraud) and flag p > 0.5 as struct ``out``; the features of ``df`` are used up."""
        if self.model is None:
            raise ValueError("model is not trained")
        scored = self.model.transform(assemble(prepared(df, self.scaler, CLIP_BOUND), self.features))
        p = vector_to_array(F.col("probability"))[1]
        return scored.withColumn(out, verdict(p, p > 0.5)).drop(
            "features", "rawPrediction", "probability", "prediction")

    def score(self, df: DataFrame) -> DataFrame:
        return long_scores(self.add_verdict(df, "_v"), self.name, "_v")

    def importances(self) -> DataFrame:
        """M5: (feature, importance), normalised to sum 1."""
        if self.model is None:
            raise ValueError("model is not trained")
        spark = SparkSession.getActiveSession()
        imp = self.model.featureImportances.toArray().tolist()
        return spark.createDataFrame(list(zip(self.features, [float(v) for v in imp])),
                                     "feature string, importance double")

    def save(self, path: str) -> None:
        if self.model is None:
            raise ValueError("model is not trained")
        self.model.write().overwrite().save(os.path.join(path, "model"))
        save_scaler(path, self.scaler)
        save_meta(path, {"name": self.name, "params": self.params, "seed": self.seed,
                         "features": self.features})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "GBTDetector":
        meta = load_meta(spark, path)
        return cls(name=meta["name"], params=meta["params"], seed=meta["seed"],
                   scaler=load_scaler(spark, path),
                   model=GBTClassificationModel.load(os.path.join(path, "model")),
                   features=meta["features"])


def top_importances(importances: DataFrame, k: int = 15) -> DataFrame:
    """The k most important features (top-k, not a global sort)."""
    return importances.orderBy(F.col("importance").desc(), F.col("feature")).limit(k)


def fold_mask(folds: list[tuple[int, Column]]) -> Column:
    """Roles of a row in all folds as one number: bit 2f trains fold f, bit 2f + 1 validates it."""
    mask = F.lit(0).cast("long")
    for f, role in folds:
        bits = F.when(role == "train", F.lit(1 << 2 * f)).when(role == "val", F.lit(2 << 2 * f)).otherwise(F.lit(0))
        mask = mask + bits.cast("long")
    return mask


def in_role(fold: int, role: str, mask: str = "_mask") -> Column:
    return F.col(mask).bitwiseAND(F.lit((1 if role == "train" else 2) << 2 * fold).cast("long")) != 0


def param_search(train: DataFrame, order: list[str], grid: list[dict] | None = None,
                 n_splits: int = 5, purge: int = 50, embargo: int = 10,
                 seed: int = 42, parallelism: int = 4) -> tuple[dict, DataFrame]:
    """M4 + A12: mean validation F1 per grid point over purged/embargoed folds.

    Folds follow ``order`` (key ranges from exact rank selection).  The rows are assembled and
    written once, with their roles in all folds as a bit mask: no fold has a copy of its own.  The
    fits are jobs that run ``parallelism`` at a time, so that one fit's driver steps overlap with
    others' tasks (with a fair scheduler configured, in a pool each).  The positive weight is
    computed once on all training rows; the first grid point with a strictly greater mean F1 wins.
    Returns (best, table).
    """
    grid = grid or PARAM_GRID
    spark = train.sparkSession
    spw = positive_weight(train)
    folds = fold_roles(train, order, n_splits, purge, embargo)
    unscaled = Scaler(FEATURES, [0.0] * len(FEATURES), [1.0] * len(FEATURES))
    rows = assemble(_labelled(prepared(train, unscaled, None))).select(
        "features", "_label", fold_mask(folds).alias("_mask"))
    rows = materialize(rows, "search-rows")

    def fold_f1(gi: int, f: int) -> tuple[int, int, float]:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"search-{gi}-{f}")
        data = rows.where(in_role(f, "train")).select("features", "_label").persist(
            StorageLevel.MEMORY_AND_DISK)
        try:
            model = _boosted(data, grid[gi], spw, seed)
        finally:
            data.unpersist()
        hit = vector_to_array(F.col("probability"))[1] > 0.5
        scored = model.transform(rows.where(in_role(f, "val"))).select(
            F.lit("m").alias("model"), F.col("_label").cast("int").alias("label"), hit.cast("int").alias("prediction"))
        return gi, f, float(classification_metrics(scored).first()["f1_score"])

    tasks = [(gi, f) for gi in range(len(grid)) for f, _ in folds]
    with ThreadPool(max(1, min(parallelism, len(tasks)))) as pool:
        found = pool.starmap(inheritable_thread_target(spark)(fold_f1), tasks, chunksize=1)
    table = spark.createDataFrame(found, "param_id int, fold int, f1 double")
    best_id, best_f1 = 0, -1.0
    for gi in range(len(grid)):
        scores = [f1 for g, _, f1 in found if g == gi]
        mean = sum(scores) / max(len(scores), 1)
        if mean > best_f1:
            best_id, best_f1 = gi, mean
    return grid[best_id], table.groupBy("param_id").agg(F.avg("f1").alias("mean_f1"))

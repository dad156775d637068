"""Training plan (M10): fit every detector on the training split and emit
one long score table for the test split, keyed by tx_id."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txsentinel.operators.detectors.discriminator import DiscriminatorDetector
from txsentinel.operators.detectors.gbt import GBTDetector, param_search
from txsentinel.operators.detectors.iforest import IsolationForestDetector
from txsentinel.operators.detectors.recon import (
    AutoencoderDetector, PCAReconstructionDetector, choose_components,
)
from txsentinel.operators.profile import normal_only
from txsentinel.plans.flow import SPLIT_ORDER
from txsentinel.schema import FEATURES


@dataclass
class TrainingConfig:
    """Sizes of every detector; defaults follow the reference's workload."""
    gbt_params: dict | None = None          # None -> purged-fold search over gbt_grid
    gbt_grid: list[dict] | None = None
    n_splits: int = 5
    purge: int = 50
    embargo: int = 10
    iforest_trees: int = 200
    iforest_contamination: float = 0.02
    pca_k: int | None = None                # None -> chosen on a validation fold (latest training rows)
    ae_hidden: tuple[int, ...] = (64, 32, 16, 32, 64)
    ae_epochs: int = 100
    ae_learning_rate: float = 1e-3
    disc_iter: int = 30
    seq_ae_epochs: int = 50
    models: tuple[str, ...] = ("gbt", "isolation_forest", "pca_p95", "pca_p99",
                               "autoencoder", "sequence_autoencoder", "discriminator")
    seed: int = 42


def train_all(split_df: DataFrame, config: TrainingConfig | None = None,
              save_dir: str | None = None) -> tuple[dict, DataFrame]:
    """Fit the configured detectors; return (detectors, test score table)."""
    cfg = config or TrainingConfig()
    train = split_df.where(F.col("is_train") == 1).persist(StorageLevel.MEMORY_AND_DISK)
    test = split_df.where(F.col("is_train") == 0)
    normals = normal_only(train).persist(StorageLevel.MEMORY_AND_DISK)
    fitted = {}
    try:
        if "gbt" in cfg.models:
            params = cfg.gbt_params
            if params is None:
                params, _ = param_search(train, list(SPLIT_ORDER), cfg.gbt_grid, cfg.n_splits,
                                         cfg.purge, cfg.embargo, cfg.seed)
            fitted["gbt"] = GBTDetector(params=params, seed=cfg.seed).fit(train)
        if "isolation_forest" in cfg.models:
            fitted["isolation_forest"] = IsolationForestDetector(
                n_trees=cfg.iforest_trees, contamination=cfg.iforest_contamination,
                seed=cfg.seed).fit(train)
        pca_k = cfg.pca_k
        if pca_k is None and {"pca_p95", "pca_p99"} & set(cfg.models):
            pca_k = choose_components(train, list(SPLIT_ORDER))
        if "pca_p95" in cfg.models:
            fitted["pca_p95"] = PCAReconstructionDetector(
                name="pca_p95", k=pca_k, quantile=0.95).fit(normals)
        if "pca_p99" in cfg.models:
            fitted["pca_p99"] = (
                fitted["pca_p95"].with_quantile("pca_p99", 0.99) if "pca_p95" in fitted
                else PCAReconstructionDetector(name="pca_p99", k=pca_k, quantile=0.99).fit(normals))
        if "autoencoder" in cfg.models:
            fitted["autoencoder"] = AutoencoderDetector(
                hidden=cfg.ae_hidden, epochs=cfg.ae_epochs,
                learning_rate=cfg.ae_learning_rate, seed=cfg.seed).fit(normals)
        if "sequence_autoencoder" in cfg.models:
            # length-1 sequences make the sequence model a per-row reconstruction scorer: the same
            # network with a P99 threshold; trained on its own (patience 5) where there is none
            fitted["sequence_autoencoder"] = (
                fitted["autoencoder"].with_quantile("sequence_autoencoder", 0.99)
                if "autoencoder" in fitted else AutoencoderDetector(
                    name="sequence_autoencoder", hidden=cfg.ae_hidden, epochs=cfg.seq_ae_epochs,
                    learning_rate=cfg.ae_learning_rate, patience=5, quantile=0.99, seed=cfg.seed).fit(normals))
        if "discriminator" in cfg.models:
            fitted["discriminator"] = DiscriminatorDetector(
                max_iter=cfg.disc_iter, seed=cfg.seed).fit(normals)
    finally:
        train.unpersist()
        normals.unpersist()
    if save_dir:
        for name, det in fitted.items():
            det.save(os.path.join(save_dir, name))
    return fitted, score_all(fitted, test)


def score_wide(detectors: dict, df: DataFrame, keep: tuple[str, ...] = ("tx_id",)) -> DataFrame:
    """``keep`` columns, ``label`` and one struct ``_v_<model>`` (score, prediction) per detector.

    One scan: every detector adds its column to the same rows; no union, no join, no shuffle."""
    label = F.col("is_fraud").cast("int") if "is_fraud" in df.columns else F.lit(None).cast("int")
    wide = df.select(*keep, label.alias("label"), F.struct(*FEATURES).alias("_features"))
    for name, det in detectors.items():
        wide = det.add_verdict(wide.select("*", "_features.*"), f"_v_{name}").drop(*FEATURES)
    return wide.drop("_features")


def score_all(detectors: dict, df: DataFrame) -> DataFrame:
    """Every detector's scores in long format, from one wide pass."""
    rows = F.array(*[F.struct(F.lit(name).alias("model"), F.col(f"_v_{name}.score").alias("score"),
                              F.col(f"_v_{name}.prediction").alias("prediction")) for name in detectors])
    return score_wide(detectors, df).select("tx_id", "label", F.inline(rows)).select(
        "tx_id", "model", "label", "score", "prediction")

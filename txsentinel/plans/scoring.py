"""Batch scoring of incoming transactions with saved detectors."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from txsentinel.operators.detectors.discriminator import DiscriminatorDetector
from txsentinel.operators.detectors.gbt import GBTDetector
from txsentinel.operators.detectors.iforest import IsolationForestDetector
from txsentinel.operators.detectors.recon import AutoencoderDetector, PCAReconstructionDetector
from txsentinel.operators.scaling import clean_features
from txsentinel.plans.training import score_wide
from txsentinel.sources.json_records import parse_tx_json, responses

LOADERS = {
    "gbt": GBTDetector,
    "isolation_forest": IsolationForestDetector,
    "pca_p95": PCAReconstructionDetector,
    "pca_p99": PCAReconstructionDetector,
    "autoencoder": AutoencoderDetector,
    "sequence_autoencoder": AutoencoderDetector,
    "discriminator": DiscriminatorDetector,
}


def load_detectors(spark: SparkSession, model_dir: str) -> dict:
    """Every detector that was saved under ``model_dir`` (any Hadoop file system).

    Models are optional: a missing folder is left out.  A folder that cannot be read raises."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = {}
    for name, cls in LOADERS.items():
        path = jvm.org.apache.hadoop.fs.Path(model_dir, name)
        if path.getFileSystem(conf).exists(path):
            out[name] = cls.load(spark, os.path.join(model_dir, name))
    return out


def score_json_records(records: DataFrame, detectors: dict, value: str = "value") -> DataFrame:
    """JSON feature records -> one JSON response per record.

    Rejected records get one too: ``status`` "rejected" and the reason.  A projection, for batches
    and streams alike."""
    parsed = parse_tx_json(records, value)
    filled = clean_features(parsed)  # rejected rows pass the models as zeros; their scores are not shown
    wide = score_wide(detectors, filled, ("tx_id", "is_valid", "reject_reason"))
    return responses(wide, list(detectors))

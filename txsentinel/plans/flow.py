"""Shared building blocks of the end-to-end plans.

events -> TX (adapter) -> labelled (I1) -> engineered (E7) -> split (W5)
-> scores (detectors) -> evaluation.  Each step is a function of
(spark, sf_dir) so that registered queries and the bench reuse them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txsentinel.operators.detectors.rule import all_rule_scores
from txsentinel.operators.features import engineer_features
from txsentinel.operators.inject import inject_anomalies
from txsentinel.operators.ordered import positional_split_by_cut
from txsentinel.session import materialize
from txsentinel.sources.adapters import event_transactions

SPLIT_ORDER = ("timestamp", "tx_id")
# what the rule detectors read
RULE_COLUMNS = ["is_fraud", "amount_zscore", "amount_to_median_ratio"]


def labelled(spark: SparkSession, sf_dir: str, ratio: float = 0.02,
             with_vector: bool = False, persist: bool = False) -> DataFrame:
    """Events as transactions with injected, labelled anomalies.

    persist=True writes the table once under the checkpoint folder (the
    reference saves its raw table too) so later steps do not re-run the
    injection for every branch of their plans.
    """
    df = inject_anomalies(event_transactions(spark, sf_dir), ratio=ratio,
                          with_vector=with_vector)
    return materialize(df, "labelled") if persist else df


def engineered(spark: SparkSession, sf_dir: str, persist: bool = False) -> DataFrame:
    return engineer_features(labelled(spark, sf_dir, persist=persist))


def split(spark: SparkSession, sf_dir: str, persist: bool = False,
          columns: list[str] | None = None) -> DataFrame:
    """W5 on the engineered table in true time order (timestamp, tx_id).

    The cut key is found by exact rank selection, so the split is a filter
    and the table is never globally sorted.  The engineered table is written
    once first: the selection reads it several times.
    """
    feats = engineered(spark, sf_dir, persist=persist)
    if columns is not None:  # what nobody reads is neither computed nor written
        feats = feats.select(*dict.fromkeys([*SPLIT_ORDER, *columns]))
    feats = materialize(feats, "engineered")
    return positional_split_by_cut(feats, list(SPLIT_ORDER))


def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M12 scores of the test split (is_train = 0), long format."""
    test = split(spark, sf_dir, columns=RULE_COLUMNS).where(F.col("is_train") == 0)
    return all_rule_scores(test)

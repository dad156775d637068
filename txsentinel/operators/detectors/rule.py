"""Rule detectors -- a feature's magnitude as the anomaly score.

No training; they give the evaluation operators an oracle-checkable input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed defaults: (model name, feature, threshold) of the built-in rules.
DEFAULT_RULES = [
    ("zscore_rule", "amount_zscore", 3.0),
    ("ratio_rule", "amount_to_median_ratio", 5.0),
]


def rule_scores(features: DataFrame, model: str = "zscore_rule",
                column: str = "amount_zscore", threshold: float = 3.0,
                label: str = "is_fraud") -> DataFrame:
    """score = |column| (NULL -> 0); prediction = score > threshold."""
    score = F.coalesce(F.abs(F.col(column)).cast("double"), F.lit(0.0))
    return features.select(
        F.col("tx_id"), F.lit(model).alias("model"), F.col(label).cast("int").alias("label"),
        score.alias("score"),
        F.when(score > F.lit(float(threshold)), 1).otherwise(0).alias("prediction"))


def all_rule_scores(features: DataFrame, rules=None) -> DataFrame:
    out = None
    for name, col, thr in (rules or DEFAULT_RULES):
        s = rule_scores(features, name, col, thr)
        out = s if out is None else out.unionByName(s)
    return out


class RuleDetector:
    """M12 as a detector object (same interface as the trained ones)."""

    def __init__(self, name: str = "zscore_rule", column: str = "amount_zscore",
                 threshold: float = 3.0):
        self.name, self.column, self.threshold = name, column, threshold

    def fit(self, _train: DataFrame) -> "RuleDetector":
        return self

    def add_verdict(self, df: DataFrame, out: str) -> DataFrame:
        score = F.coalesce(F.abs(F.col(self.column)).cast("double"), F.lit(0.0))
        flag = F.when(score > F.lit(float(self.threshold)), 1).otherwise(0)
        return df.withColumn(out, F.struct(score.alias("score"), flag.alias("prediction")))

    def score(self, df: DataFrame) -> DataFrame:
        label = "is_fraud" if "is_fraud" in df.columns else None
        if label is None:
            df = df.withColumn("is_fraud", F.lit(None).cast("int"))
        return rule_scores(df, self.name, self.column, self.threshold)

    def save(self, path: str) -> None:  # nothing to persist beyond parameters
        from txsentinel.operators.detectors.base import save_meta
        save_meta(path, {"name": self.name, "column": self.column, "threshold": self.threshold})

    @classmethod
    def load(cls, spark, path: str) -> "RuleDetector":
        from txsentinel.operators.detectors.base import load_meta
        m = load_meta(spark, path)
        return cls(m["name"], m["column"], m["threshold"])


def default_rule_detectors() -> dict:
    return {name: RuleDetector(name, col, thr) for name, col, thr in DEFAULT_RULES}

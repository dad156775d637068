"""Feature matrix preparation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txsentinel.functions.scalars import clean_value, clip
from txsentinel.schema import CLIP_BOUND, FEATURES


def feature_matrix(df: DataFrame, features: list[str] | None = None,
                   keep: tuple[str, ...] = ("tx_id", "is_fraud")) -> DataFrame:
    """The fixed ordered features that are present (+ key and label)."""
    features = [c for c in (features or FEATURES) if c in df.columns]
    return df.select(*[c for c in keep if c in df.columns], *features)


def clean_features(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """NULL / NaN / +-Inf -> 0.0 for every feature, in one projection."""
    features = [c for c in (features or FEATURES) if c in df.columns]
    fs = set(features)
    return df.select(*[clean_value(c).alias(c) if c in fs else F.col(c) for c in df.columns])


@dataclass
class Scaler:
    """A10 result: per-feature mean and population std (0 -> 1)."""
    features: list[str]
    mean: list[float]
    std: list[float]

    def transform(self, df: DataFrame, clip_bound: float | None = CLIP_BOUND,
                  suffix: str = "") -> DataFrame:
        """(x - mean) / std, then clip to [-bound, bound] if given."""
        out = []
        for f, m, s in zip(self.features, self.mean, self.std):
            z = (F.col(f) - F.lit(m)) / F.lit(s)
            if clip_bound is not None:
                z = clip(z, clip_bound)
            out.append(z.alias(f + suffix))
        keep = [c for c in df.columns if c not in self.features or suffix]
        return df.select(*keep, *out)

    def to_df(self, spark):
        rows = list(zip(self.features, self.mean, self.std))
        return spark.createDataFrame(rows, "feature string, mean double, std double")

    @classmethod
    def from_df(cls, df: DataFrame) -> "Scaler":
        rows = df.collect()  # one row per feature (18)
        return cls([r["feature"] for r in rows], [r["mean"] for r in rows],
                   [r["std"] for r in rows])


def scaler_stats(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """A10 as a table: (feature, mean, std_pop with 0 -> 1); one aggregation."""
    features = [c for c in (features or FEATURES) if c in df.columns]
    one = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in features],
                 *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in features])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"),
                              F.col(f"s_{c}").alias("std")) for c in features])
    return one.select(F.inline(rows)).select(
        "feature", "mean", F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std")).alias("std"))


def fit_scaler(df: DataFrame, features: list[str] | None = None) -> Scaler:
    """A10: fit on the driver-visible 18-row statistics table."""
    features = [c for c in (features or FEATURES) if c in df.columns]
    stats = {r["feature"]: r for r in scaler_stats(df, features).collect()}
    return Scaler(features, [float(stats[f]["mean"]) for f in features],
                  [float(stats[f]["std"]) for f in features])


def assemble(df: DataFrame, features: list[str] | None = None,
             output: str = "features") -> DataFrame:
    """VectorAssembler in training order; invalid values raise."""
    from pyspark.ml.feature import VectorAssembler
    features = features or FEATURES
    return VectorAssembler(inputCols=features, outputCol=output,
                           handleInvalid="error").transform(df)

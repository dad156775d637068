"""Profiling aggregates and explorer operators.

Every aggregate here is algebraic (partial aggregation before the shuffle);
``describe`` adds exact quartiles through ``ordered.exact_quantiles`` over
(column, value) counts.  Limits appear only where the row count is the
feature (sample of n rows, first 500 rows of a filtered view).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txsentinel.functions.scalars import round_money
from txsentinel.operators import ordered
from txsentinel.operators.evaluate import score_histogram


def hour_class_counts(tx: DataFrame) -> DataFrame:
    """A2: transactions per hour of day and class."""
    return tx.groupBy("hour_of_day", "is_fraud").agg(F.count(F.lit(1)).alias("count"))


def amount_histogram(tx: DataFrame, bins: int = 50) -> DataFrame:
    """A3: equal-width histogram of amounts per class over the overall range."""
    one = tx.select(F.lit("all").alias("_g"), "transaction_amount", "is_fraud")
    return score_histogram(one, bins=bins, value="transaction_amount", group="_g",
                           cls="is_fraud").drop("_g")


def numeric_columns(df: DataFrame) -> list[str]:
    numeric = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
               T.DoubleType, T.DecimalType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, numeric)]


def describe(df: DataFrame, columns: list[str] | None = None,
             num_partitions: int | None = None) -> DataFrame:
    """A5: count, mean, std, min, 25/50/75 %, max per numeric column, rounded
    to 2 decimals; long form, one row per column ("variable").

    Quartiles are exact (linear interpolation, like pandas), not the
    approximate ones of DataFrame.summary().
    """
    columns = columns or numeric_columns(df)
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], columns, "variable", "value")
    moments = long.groupBy("variable").agg(
        F.count("value").cast("double").alias("count"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    quart = ordered.exact_quantiles(long, "value", {"p25": 0.25, "p50": 0.50, "p75": 0.75},
                                    ["variable"], num_partitions=num_partitions)
    out = moments.join(quart, "variable", "left")
    stats = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    return out.select("variable", *[round_money(F.col(s)).alias(s) for s in stats])


def scale_pos_weight(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """n_neg, n_pos and n_neg / max(n_pos, 1)."""
    lab = F.col(label)
    g = df.agg(F.count_if(lab == 0).alias("n_neg"), F.count_if(lab == 1).alias("n_pos"))
    return g.withColumn("scale_pos_weight",
                        F.col("n_neg").cast("double") / F.greatest(F.col("n_pos"), F.lit(1)))


def score_range(scores: DataFrame, steps: int = 200) -> DataFrame:
    """Per model min, max and slider step (max - min) / steps."""
    return scores.groupBy("model").agg(F.min("score").alias("min_score"),
                                       F.max("score").alias("max_score")).withColumn(
        "step", (F.col("max_score") - F.col("min_score")) / F.lit(float(steps)))


def distinct_customers(df: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct customers (exact, or HyperLogLog++ with approx=True)."""
    agg = F.approx_count_distinct("customer_id") if approx else F.count_distinct("customer_id")
    return df.agg(agg.alias("n_customers"))


def normal_only(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """Legit rows only (the filter reaches the parquet scan)."""
    return df.where(F.col(label) == 0)


def _explore_predicate(fraud_filter: str, min_amount: float, max_amount: float | None) -> Column:
    amount = F.col("transaction_amount")
    pred = amount >= F.lit(float(min_amount))
    if max_amount is not None:
        pred = pred & (amount <= F.lit(float(max_amount)))
    if fraud_filter == "fraud":
        pred = pred & (F.col("is_fraud") == 1)
    elif fraud_filter == "legit":
        pred = pred & (F.col("is_fraud") == 0)
    elif fraud_filter != "all":
        raise ValueError("fraud_filter must be 'all', 'fraud' or 'legit'")
    return pred


def explore_filter(df: DataFrame, fraud_filter: str = "all", min_amount: float = 0.0,
                   max_amount: float | None = None) -> DataFrame:
    """P4 + P8: class filter and amount range; ``is_marked`` = 1 for fraud rows."""
    return (df.where(_explore_predicate(fraud_filter, min_amount, max_amount))
            .withColumn("is_marked", (F.col("is_fraud") == 1).cast("int")))


def explore_counts(df: DataFrame, fraud_filter: str = "all", min_amount: float = 0.0,
                   max_amount: float | None = None) -> DataFrame:
    """P5: "showing N of M" in one aggregation."""
    pred = _explore_predicate(fraud_filter, min_amount, max_amount)
    return df.agg(F.count_if(pred).alias("n_shown"), F.count(F.lit(1)).alias("n_total"))


def explore_head(df: DataFrame, n: int = 500, order: str = "tx_id", **filters) -> DataFrame:
    """First n rows of the filtered view (top-n, not a global sort)."""
    return explore_filter(df, **filters).orderBy(F.col(order)).limit(n)


def _keyed_order(seed: int, key: str = "tx_id") -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def sample_n(df: DataFrame, n: int = 5000, seed: int = 42, key: str = "tx_id") -> DataFrame:
    """Exactly min(n, rows) rows chosen by a keyed hash (top-n by hash)."""
    return (df.withColumn("_h", _keyed_order(seed, key))
            .orderBy(F.col("_h"), F.col(key)).limit(n).drop("_h"))


def hash_shuffle(df: DataFrame, seed: int = 42, key: str = "tx_id") -> DataFrame:
    """Deterministic shuffled order (global sort on a keyed hash; Spark
    range-partitions the sort, no single task)."""
    return (df.withColumn("shuffle_key", _keyed_order(seed, key))
            .orderBy("shuffle_key", key))


def union_labeled(legit: DataFrame, fraud: DataFrame) -> DataFrame:
    """Concatenate legit and fraud rows by column name."""
    return legit.unionByName(fraud)

"""Bucketed feature table: one exchange that statistics, join and windows share.

``write_layout`` deals the transactions into buckets by customer and sorts
them by (customer, time, id) once.  ``engineer_features_bucketed`` then builds
all 18 features of E7 with one scan of that table and no exchange: the
statistics are window aggregates over the customer, so there is no join, and
the row windows find their distribution in the buckets.

Rows that a bucket cannot hold do not go there.  A customer with more than
1 / buckets of all rows (fewer than ``buckets`` customers can have so many)
would be one oversized task, and rows without a customer would all meet in
one bucket: both go to a plain table next to it, whose features come from the
ranged plan of ``engineer_features``, which splits a customer over tasks.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txsentinel.operators import features as fe
from txsentinel.schema import VELOCITY_1H_ROWS, VELOCITY_24H_ROWS
from txsentinel.session import materialize, shuffle_partitions


@dataclass
class CustomerLayout:
    """``table``: the bucketed table; ``rest``: hot customers' rows and rows without one (or None)."""
    spark: SparkSession
    table: str
    rest: DataFrame | None
    buckets: int
    hot: list
    key: str = "customer_id"
    ts: str = "timestamp"
    tie: str = "tx_id"

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def write_layout(tx: DataFrame, table: str | None = None, buckets: int | None = None,
                 key: str = "customer_id", ts: str = "timestamp", tie: str = "tx_id") -> CustomerLayout:
    """Write the table (in the session's warehouse); one file per bucket.

    One aggregation counts rows per customer.  Works without a time column, too."""
    spark = tx.sparkSession
    n = buckets or shuffle_partitions(spark)
    table = table or f"layout_{uuid.uuid4().hex}"
    counts = tx.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "customer-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # fewer than n rows: each has more than total / n rows
    large = counts.where((F.col("n") * F.lit(n) > F.lit(total)) | F.col(key).isNull()).collect() if n > 1 else []
    hot = sorted(r[key] for r in large if r[key] is not None)
    aside = F.col(key).isNull() | F.col(key).isin(hot) if hot else F.col(key).isNull()
    order = [c for c in (key, ts, tie) if c in tx.columns]
    (tx.where(~aside).repartition(n, key).write.format("parquet")
     .bucketBy(n, key).sortBy(*order).saveAsTable(table))
    rest = materialize(tx.where(aside), "layout-rest") if large or n == 1 else None
    return CustomerLayout(spark, table, rest, n, hot, key, ts, tie)


def _bucketed_features(layout: CustomerLayout) -> DataFrame:
    key, ts, tie = layout.key, layout.ts, layout.tie
    df = layout.spark.table(layout.table)
    columns = df.columns
    if ts in columns:
        df = fe.add_velocity_features(df, key, ts, tie)
    else:
        r = F.row_number().over(Window.partitionBy(key).orderBy(tie)) - 1
        df = df.select("*", (r % VELOCITY_1H_ROWS).cast("long").alias("tx_frequency_1h"),
                       (r % VELOCITY_24H_ROWS).cast("long").alias("tx_frequency_24h"))
    # the rows arrive sorted by customer from the window above; the statistics need no more
    whole = Window.partitionBy(key)
    amount = F.col("transaction_amount")
    df = df.select("*", F.avg(amount).over(whole).alias("cust_mean"),
                   F.coalesce(F.stddev_samp(amount).over(whole), F.lit(1.0)).alias("cust_std"),
                   F.percentile(amount.cast("double"), 0.5).over(whole).alias("cust_median"))
    return fe.add_interaction_features(fe.add_cyclical_features(fe.add_amount_features(df)))


def engineer_features_bucketed(layout: CustomerLayout) -> DataFrame:
    """E7 over a written layout: the rows and columns of ``engineer_features`` on the same input."""
    out = _bucketed_features(layout)
    if layout.rest is None:
        return out
    return out.unionByName(fe.engineer_features(layout.rest, strategy="ranged"))

"""Adapters from the driver's tables to the canonical transaction schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txsentinel.functions.scalars import nan_to_null
from txsentinel.schema import EVENT_TYPES, TX_COLUMNS


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _category_index(col: str, values: list[str]):
    expr = None
    for i, v in enumerate(values):
        cond = F.col(col) == F.lit(v)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr.otherwise(F.lit(None)).cast("int")


def events_to_transactions(events: DataFrame) -> DataFrame:
    """events(event_id, ts, user_id, event_type, value, props) -> TX.

    tx_id=event_id, customer_id=user_id, amount=value, hour/weekday of ts
    (Monday=0), merchant_category=index of event_type, distance=props.k,
    is_international = k >= 90, is_fraud=0 (labels come from injection).
    """
    k = F.get_json_object(F.col("props"), "$.k").cast("double")
    return events.select(
        F.col("event_id").cast("long").alias("tx_id"),
        F.col("user_id").cast("long").alias("customer_id"),
        nan_to_null(F.col("value").cast("double")).alias("transaction_amount"),
        F.hour("ts").cast("int").alias("hour_of_day"),
        F.weekday("ts").cast("int").alias("day_of_week"),
        _category_index("event_type", EVENT_TYPES).alias("merchant_category"),
        k.alias("distance_from_home"),
        F.when(k >= 90, F.lit(1)).otherwise(F.lit(0)).alias("is_international"),
        F.lit(0).alias("is_fraud"),
        F.col("ts").cast("timestamp_ntz").alias("timestamp"),
    )


def orders_to_transactions(orders: DataFrame) -> DataFrame:
    """orders -> TX: one transaction per order (daily timestamps, many ties)."""
    status_index = _category_index("o_orderstatus", ["F", "O", "P"])
    return orders.select(
        F.col("o_orderkey").cast("long").alias("tx_id"),
        F.col("o_custkey").cast("long").alias("customer_id"),
        nan_to_null(F.col("o_totalprice").cast("double")).alias("transaction_amount"),
        F.hour("o_orderdate").cast("int").alias("hour_of_day"),
        F.weekday("o_orderdate").cast("int").alias("day_of_week"),
        status_index.alias("merchant_category"),
        F.lit(0.0).alias("distance_from_home"),
        F.lit(0).alias("is_international"),
        F.lit(0).alias("is_fraud"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("timestamp"),
    )


def event_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_to_transactions(read_table(spark, sf_dir, "events")).select(*TX_COLUMNS)


def order_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_to_transactions(read_table(spark, sf_dir, "orders")).select(*TX_COLUMNS)

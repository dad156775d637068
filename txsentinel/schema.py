"""Canonical schemas and fixed names."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for matching results)
# ---------------------------------------------------------------------------
# Columns a transaction table must carry.
REQUIRED_COLUMNS = [
    "customer_id", "transaction_amount", "hour_of_day", "day_of_week",
    "merchant_category", "distance_from_home", "is_international", "is_fraud",
]
# The 18 model features, in training order.
FEATURES = [
    "transaction_amount", "hour_of_day", "day_of_week",
    "merchant_category", "distance_from_home", "is_international",
    "amount_deviation", "amount_zscore", "amount_to_median_ratio",
    "tx_frequency_1h", "tx_frequency_24h",
    "hour_sin", "hour_cos", "day_sin", "day_cos",
    "amount_x_distance", "amount_x_international", "zscore_x_frequency",
]
# Velocity rule: gap threshold (seconds) and trailing row count per feature.
VELOCITY_1H_SECONDS = 3600
VELOCITY_1H_ROWS = 5
VELOCITY_24H_SECONDS = 86400
VELOCITY_24H_ROWS = 20
# Gap assigned to a customer's first transaction.
FIRST_GAP_SECONDS = 9999.0
# Cost model defaults (USD): missed fraud, investigated legit transaction.
COST_FALSE_NEGATIVE = 1000.0
COST_FALSE_POSITIVE = 50.0
# Clip bound after standardisation.
CLIP_BOUND = 10.0
# ---------------------------------------------------------------------------

# Event types of the driver's `events` table, index = merchant_category.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]

TX_SCHEMA = T.StructType([
    T.StructField("tx_id", T.LongType(), True),
    T.StructField("customer_id", T.LongType(), True),
    T.StructField("transaction_amount", T.DoubleType(), True),
    T.StructField("hour_of_day", T.IntegerType(), True),
    T.StructField("day_of_week", T.IntegerType(), True),
    T.StructField("merchant_category", T.IntegerType(), True),
    T.StructField("distance_from_home", T.DoubleType(), True),
    T.StructField("is_international", T.IntegerType(), True),
    T.StructField("is_fraud", T.IntegerType(), True),
    T.StructField("timestamp", T.TimestampNTZType(), True),
])

TX_COLUMNS = [f.name for f in TX_SCHEMA.fields]

# JSON request of the online scorer: the 18 features, all double.
FEATURE_RECORD_SCHEMA = T.StructType(
    [T.StructField(name, T.DoubleType(), True) for name in FEATURES])

"""JSON transaction records in and prediction records out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txsentinel.functions.scalars import clean_value
from txsentinel.schema import FEATURE_RECORD_SCHEMA, FEATURES

CORRUPT = "_corrupt_record"


def features_to_json(df: DataFrame, key: str = "tx_id", clean: bool = False) -> DataFrame:
    """(key, value) with value = JSON object of the 18 features.

    A NULL feature is left out of its record; ``clean`` sends 0 for missing values instead (P2),
    as an engine must that wants every record of its own scored."""
    value = clean_value if clean else (lambda c: F.col(c).cast("double"))
    return df.select(F.col(key), F.to_json(F.struct(*[value(c).alias(c) for c in FEATURES]))
                     .alias("value"))


def parse_tx_json(df: DataFrame, value: str = "value") -> DataFrame:
    """Parse JSON records with the fixed 18-double schema.

    A record that is not a JSON object, or misses a feature, gets
    ``is_valid = 0`` (it would be rejected by the online API); valid rows have
    every feature set.  ``reject_reason`` is NULL for them, else ``corrupt`` or the
    missing features.
    """
    schema = T.StructType(FEATURE_RECORD_SCHEMA.fields + [T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json(F.col(value), schema,
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    out = df.withColumn("_r", parsed)
    complete = F.lit(True)
    for c in FEATURES:
        complete = complete & F.col(f"_r.{c}").isNotNull()
    readable = F.col("_r").isNotNull() & F.col(f"_r.{CORRUPT}").isNull()
    valid = readable & complete
    absent = F.concat_ws(",", *[F.when(F.col(f"_r.{c}").isNull(), F.lit(c)) for c in FEATURES])
    reason = F.when(~readable, F.lit("corrupt")).when(~complete, F.concat(F.lit("missing "), absent))
    return out.select(*[c for c in df.columns if c != value],
                      *[F.col(f"_r.{c}").alias(c) for c in FEATURES],
                      F.when(valid, 1).otherwise(0).alias("is_valid"), reason.alias("reject_reason"))


def responses(wide: DataFrame, models: list[str], key: str = "tx_id") -> DataFrame:
    """One JSON document per row of a wide score table (see plans.training.score_wide).

    {"status": "analysed", "predictions": {model: {is_fraud, score}}} with the models in the given
    order, or {"status": "rejected", "reason": ...} where ``is_valid`` is 0.  A projection: no
    shuffle, usable on a stream."""
    valid = F.col("is_valid") == 1 if "is_valid" in wide.columns else F.lit(True)
    reason = F.col("reject_reason") if "reject_reason" in wide.columns else F.lit(None).cast("string")
    verdicts = F.struct(*[F.struct((F.col(f"_v_{m}.prediction") == 1).alias("is_fraud"),
                                   F.col(f"_v_{m}.score").alias("score")).alias(m) for m in models])
    return wide.select(F.col(key), F.to_json(F.struct(
        F.when(valid, F.lit("analysed")).otherwise(F.lit("rejected")).alias("status"),
        F.when(~valid, reason).alias("reason"),
        F.when(valid, verdicts).alias("predictions"))).alias("response"))


def predictions_json(scores: DataFrame, key: str = "tx_id") -> DataFrame:
    """One JSON document per transaction: {model: {is_fraud, score}}.

    Input is the long score table; grouping by transaction yields at most
    one entry per model (bounded by the number of models).
    """
    entry = F.struct((F.col("prediction") == 1).alias("is_fraud"), F.col("score").alias("score"))
    nested = scores.groupBy(key).agg(F.map_from_entries(
        F.sort_array(F.collect_list(F.struct(F.col("model"), entry)))).alias("predictions"))
    return nested.select(key, F.to_json(F.struct(F.lit("analysed").alias("status"),
                                                 F.col("predictions"))).alias("response"))

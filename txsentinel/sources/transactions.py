"""Transaction readers, validators and sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txsentinel.functions.scalars import nan_to_null
from txsentinel.schema import REQUIRED_COLUMNS, TX_SCHEMA
from txsentinel.session import materialize


def validate_columns(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Schema-only check (no job): raise listing the missing required columns."""
    required = REQUIRED_COLUMNS if required is None else required
    present = set(df.columns)
    missing = [c for c in required if c not in present]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def normalize_nulls(df: DataFrame) -> DataFrame:
    """NaN -> NULL in every double column (one projection)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(nan_to_null(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def parse_timestamp(df: DataFrame, col: str = "timestamp", strict: bool = True) -> DataFrame:
    """Parse a string timestamp column to timestamp_ntz.

    strict=True raises on a malformed value (ANSI cast); strict=False turns it
    into NULL so the caller can route it to a reject table.
    """
    if col not in df.columns:
        return df
    if isinstance(df.schema[col].dataType, (T.TimestampNTZType, T.TimestampType)):
        return df.withColumn(col, F.col(col).cast("timestamp_ntz"))
    parsed = (F.to_timestamp_ntz(F.col(col)) if strict
              else F.try_to_timestamp(F.col(col)).cast("timestamp_ntz"))
    return df.withColumn(col, parsed)


CORRUPT_COLUMNS = "_bad_columns"


def typed_columns(df: DataFrame, strict: bool = True) -> DataFrame:
    """Text columns of a CSV as the canonical types; other columns keep their text.

    An empty cell is NULL.  strict=True raises on a value that its type cannot hold (ANSI casts;
    ISO and space-separated timestamps are both read).  strict=False makes such values NULL and
    names their columns in ``_bad_columns``, so that the rows can be sent to a reject table.
    """
    by_name = {f.name: f.dataType for f in TX_SCHEMA.fields}
    cols, bad = [], []
    for c in df.columns:
        if c not in by_name:
            cols.append(F.col(f"`{c}`"))
            continue
        text = F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
        kind = by_name[c].simpleString()
        if strict:
            cols.append(text.cast(kind).alias(c))
        else:
            value = text.try_cast(kind)
            cols.append(value.alias(c))
            bad.append(F.when(text.isNotNull() & value.isNull(), F.lit(c)))
    if not strict:
        cols.append(F.array_compact(F.array(*bad)).alias(CORRUPT_COLUMNS))
    return df.select(*cols)


def with_tx_id(df: DataFrame) -> DataFrame:
    """Give a table without ``tx_id`` one: a number per row, assigned once and written, so that
    every later step sees the same numbers.  A table that has one is returned as it is."""
    if "tx_id" in df.columns:
        return df
    return materialize(df.withColumn("tx_id", F.monotonically_increasing_id()), "tx-with-id")


def load_transactions(spark: SparkSession, path: str, fmt: str | None = None,
                      validate: bool = True, strict: bool = True) -> DataFrame:
    """Read a transaction table (CSV with header, or parquet).

    Missing input raises FileNotFoundError; missing required columns raise
    ValueError; `timestamp` is parsed when present; NaN becomes NULL; ``tx_id``
    is assigned when absent.  A CSV value that does not fit its type raises
    (strict) or is listed in ``_bad_columns`` (see ``typed_columns``).
    """
    fmt = fmt or ("csv" if path.lower().endswith(".csv") else "parquet")
    try:
        if fmt == "csv":
            df = typed_columns(spark.read.option("header", True).csv(path), strict)
        else:
            df = spark.read.format(fmt).load(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            raise FileNotFoundError(f"transaction file not found: {path}") from exc
        raise
    if validate:
        validate_columns(df)
    df = parse_timestamp(df, strict=strict)
    return normalize_nulls(with_tx_id(df))


def write_table(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet",
                partition_by: list[str] | None = None) -> None:
    """Write a table; mode='ignore' writes only if the output is absent."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = (w.option("header", True)  # no digit of a timestamp is lost
             .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_small_csv(df: DataFrame, path: str) -> None:
    """Single-file CSV for bounded result tables (tournament, importances)."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def dataset_summary(df: DataFrame) -> DataFrame:
    """Totals, class counts, fraud %, distinct customers, time range, null cells.

    One aggregation job; every term is algebraic (partial aggregation).
    """
    null_cells = None
    for c in df.columns:
        term = F.sum(F.col(c).isNull().cast("long"))
        null_cells = term if null_cells is None else null_cells + term
    has_ts = "timestamp" in df.columns
    n = F.count(F.lit(1))
    fraud = F.sum(F.col("is_fraud").cast("long"))
    aggs = [
        n.alias("n_total"),
        (n - fraud).alias("n_legit"),
        fraud.alias("n_fraud"),
        (fraud.cast("double") * 100.0 / n).alias("fraud_pct"),
        F.count_distinct("customer_id").alias("n_customers"),
        (F.min("timestamp") if has_ts else F.lit(None).cast("timestamp_ntz")).alias("min_ts"),
        (F.max("timestamp") if has_ts else F.lit(None).cast("timestamp_ntz")).alias("max_ts"),
        null_cells.alias("null_cells"),
    ]
    return df.agg(*aggs)

"""Labelled-anomaly injection into an existing transaction table.

Rows are chosen and rewritten by keyed hashes of ``tx_id`` (see
functions.hashing), so the result is the same on every run, executor and SQL
engine.  Three attack vectors, rewritten from the customer's profile:

* amount:   amount = avg * U(5, 20), any hour, distance U(0, 5), domestic
* geo:      amount = max(0.01, N(1.5 * avg, std)), any hour, distance U(50, 500),
            international with probability 1/2
* velocity: amount = max(0.01, N(2 * avg, std)), hours 0-5, distance U(10, 50), domestic

All vectors: weekday U{0..6}, merchant U{0..14}, amounts and distances
rounded to cents, is_fraud = 1.  ``timestamp`` is left unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txsentinel.functions.hashing import keyed_normal, keyed_uniform
from txsentinel.functions.scalars import round_money
from txsentinel.schema import TX_COLUMNS

# Default mix of the three attack vectors (amount, geo, velocity).
DEFAULT_MIX = (0.40, 0.35, 0.25)


def customer_profile(tx: DataFrame) -> DataFrame:
    """Per customer average amount, std (NULL -> 0), active hour range."""
    return tx.groupBy("customer_id").agg(
        F.avg("transaction_amount").alias("avg_amount"),
        F.coalesce(F.stddev_samp("transaction_amount"), F.lit(0.0)).alias("std_amount"),
        F.min("hour_of_day").alias("active_hour_start"),
        F.max("hour_of_day").alias("active_hour_end"),
    )


def inject_anomalies(tx: DataFrame, ratio: float = 0.02,
                     mix: tuple[float, float, float] = DEFAULT_MIX,
                     profile: DataFrame | None = None,
                     with_vector: bool = False) -> DataFrame:
    """Label about ``ratio`` of the rows as fraud and rewrite them.

    The selected side is filtered before the profile join, so only ~ratio of
    the rows are shuffled/joined; the untouched rows pass straight to the
    union.  The profile has one row per customer (AQE broadcasts it when its
    runtime size allows, sort-merge with skew splitting otherwise).
    """
    profile = profile if profile is not None else customer_profile(tx)
    tid = F.col("tx_id")
    selected = keyed_uniform(tid, "sel") < F.lit(float(ratio))
    keep = tx.where(~selected | tid.isNull())
    if with_vector:
        keep = keep.withColumn("attack_vector", F.lit(None).cast("string"))
    chosen = tx.where(selected).join(
        profile.select("customer_id", "avg_amount", "std_amount"), "customer_id", "left")

    u_type = keyed_uniform(tid, "type")
    vector = (F.when(u_type < F.lit(mix[0]), F.lit("amount"))
              .when(u_type < F.lit(mix[0] + mix[1]), F.lit("geo"))
              .otherwise(F.lit("velocity")))
    avg = F.col("avg_amount")
    std = F.col("std_amount")
    z = keyed_normal(tid, "n1", "n2")
    amt_amount = avg * (F.lit(5.0) + F.lit(15.0) * keyed_uniform(tid, "amt"))
    amt_geo = F.greatest(F.lit(0.01), F.lit(1.5) * avg + std * z)
    amt_vel = F.greatest(F.lit(0.01), F.lit(2.0) * avg + std * z)
    u_hour = keyed_uniform(tid, "hour")
    u_dist = keyed_uniform(tid, "dist")
    v = F.col("attack_vector")
    extra = [c for c in tx.columns if c not in TX_COLUMNS]  # carried through unchanged
    rewritten = chosen.withColumn("attack_vector", vector).select(
        "tx_id", "customer_id",
        round_money(F.when(v == "amount", amt_amount)
                    .when(v == "geo", amt_geo).otherwise(amt_vel)).alias("transaction_amount"),
        F.when(v == "velocity", F.floor(F.lit(6.0) * u_hour))
        .otherwise(F.floor(F.lit(24.0) * u_hour)).cast("int").alias("hour_of_day"),
        F.floor(F.lit(7.0) * keyed_uniform(tid, "day")).cast("int").alias("day_of_week"),
        F.floor(F.lit(15.0) * keyed_uniform(tid, "mc")).cast("int").alias("merchant_category"),
        round_money(F.when(v == "amount", F.lit(5.0) * u_dist)
                    .when(v == "geo", F.lit(50.0) + F.lit(450.0) * u_dist)
                    .otherwise(F.lit(10.0) + F.lit(40.0) * u_dist)).alias("distance_from_home"),
        F.when((v == "geo") & (keyed_uniform(tid, "intl") > F.lit(0.5)), F.lit(1))
        .otherwise(F.lit(0)).alias("is_international"),
        F.lit(1).alias("is_fraud"),
        *[c for c in ("timestamp",) if c in tx.columns],
        "attack_vector",
        *extra,
    )
    cols = [c for c in TX_COLUMNS if c in tx.columns] + extra
    out_cols = cols + (["attack_vector"] if with_vector else [])
    return keep.select(*out_cols).unionByName(rewritten.select(*out_cols))


def injection_report(labelled: DataFrame) -> DataFrame:
    """Rows per class and attack vector (needs ``with_vector=True``)."""
    return (labelled.groupBy("is_fraud", F.coalesce(F.col("attack_vector"), F.lit("none"))
                             .alias("attack_vector"))
            .agg(F.count(F.lit(1)).alias("n")))

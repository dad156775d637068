"""Registered queries: name -> (spark builder, oracle SQL or None).

Each builder takes (spark, sf_dir) and returns a DataFrame over the driver's
tables (whole tables, no row caps).  Double outputs are rounded to 6
decimals so that the DuckDB oracle can be compared by value.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txsentinel.functions.hashing import keyed_uniform
from txsentinel.functions.scalars import (
    clock_hour, planar_distance_km, round_money, timestamp_from_hours, vector_mse,
)
from txsentinel.operators import evaluate as ev
from txsentinel.operators import features as fe
from txsentinel.operators import inject as inj
from txsentinel.operators import layout as lay
from txsentinel.operators import ordered
from txsentinel.operators import profile as pr
from txsentinel.operators import scaling as sc
from txsentinel.operators import sketches as sk
from txsentinel.operators.detectors.rule import DEFAULT_RULES, all_rule_scores
from txsentinel.plans import oracle_sql as Q
from txsentinel.plans import flow as P
from txsentinel.schema import FEATURES, TX_COLUMNS
from txsentinel.session import checkpoint_dir, materialize
from txsentinel.sources import json_records as js
from txsentinel.sources import scores as scs
from txsentinel.sources import transactions as st
from txsentinel.sources.adapters import event_transactions, order_transactions, read_table

Builder = Callable[[SparkSession, str], DataFrame]


def round6(x):
    """Round to 6 decimals the same way in Spark and in the SQL oracle: snap
    ulp noise at 1e-9 first, then floor(x*1e6 + 0.5)/1e6 (plus 0.0 so that
    -0.0 prints as 0.0).  Values beyond 1e9 use plain round()."""
    snapped = F.floor(x * F.lit(1e9) + F.lit(0.5)) / F.lit(1e9)
    six = F.floor(snapped * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)
    return F.when(F.abs(x) < F.lit(1e9), six).otherwise(F.round(x, 6)) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round6(F.col(f.name).cast("double")).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


QUERIES: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        QUERIES[name] = (lambda spark, sf_dir: rounded(fn(spark, sf_dir)),
                         Q.fix_rounding(sql) if sql else None)
        return fn
    return deco


TXD = ["transaction_amount", "distance_from_home"]
TXO = ["tx_id", "customer_id", "hour_of_day", "day_of_week", "merchant_category",
       "is_international", "is_fraud", '"timestamp"']
FEAT_ALL_DOUBLES = Q.FEATURE_DOUBLES
FEAT_ALL_OTHERS = Q.FEATURE_OTHERS


# --------------------------------------------------------------- sources ---
@register("load_transactions", Q.chain(Q.TX) + Q.select(TXO, TXD, "tx"))
def q_load(spark, sf):
    return event_transactions(spark, sf)


def _written(spark, sf, fmt: str) -> str:
    """The adapted table without tx_id as a file of the given format, as a user would bring it."""
    path = checkpoint_dir(spark).rstrip("/") + f"/user-{uuid.uuid4().hex}.{fmt}"
    st.write_table(event_transactions(spark, sf).drop("tx_id"), path, fmt=fmt)
    return path


_LOADED = Q.chain(Q.TX) + Q.select([c for c in TXO if c != "tx_id"], TXD, "tx")


@register("load_transactions_csv", _LOADED)
def q_load_csv(spark, sf):
    """S1-S4 on a CSV without tx_id: header, typed columns, timestamps, an assigned key."""
    return st.load_transactions(spark, _written(spark, sf, "csv")).drop("tx_id")


@register("load_transactions_parquet", _LOADED)
def q_load_parquet(spark, sf):
    return st.load_transactions(spark, _written(spark, sf, "parquet")).drop("tx_id")


@register("parse_timestamp", "SELECT event_id, CAST(ts AS TIMESTAMP) AS \"timestamp\" FROM events")
def q_parse_ts(spark, sf):
    ev_ = read_table(spark, sf, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"))
    return st.parse_timestamp(ev_, "timestamp")


@register("dataset_summary", Q.chain(*Q.BASE) + """
SELECT CAST(count(*) AS BIGINT) AS n_total,
       CAST(count(*) - sum(is_fraud) AS BIGINT) AS n_legit,
       CAST(sum(is_fraud) AS BIGINT) AS n_fraud,
       round(CAST(sum(is_fraud) AS DOUBLE) * 100.0 / count(*), 6) + 0.0 AS fraud_pct,
       CAST(count(DISTINCT customer_id) AS BIGINT) AS n_customers,
       min("timestamp") AS min_ts, max("timestamp") AS max_ts,
       CAST(count(*) * 10 - count(tx_id) - count(customer_id) - count(transaction_amount)
            - count(hour_of_day) - count(day_of_week) - count(merchant_category)
            - count(distance_from_home) - count(is_international) - count(is_fraud)
            - count("timestamp") AS BIGINT) AS null_cells
FROM labelled""")
def q_summary(spark, sf):
    return st.dataset_summary(P.labelled(spark, sf))


# ------------------------------------------------------------ features ---
@register("engineer_features", Q.chain(*Q.FEAT_CHAIN) + Q.select(FEAT_ALL_OTHERS, FEAT_ALL_DOUBLES, "feat"))
def q_engineer(spark, sf):
    return P.engineered(spark, sf)


@register("engineer_features_bucketed", Q.chain(*Q.FEAT_CHAIN) + Q.select(FEAT_ALL_OTHERS, FEAT_ALL_DOUBLES, "feat"))
def q_engineer_bucketed(spark, sf):
    return lay.engineer_features_bucketed(lay.write_layout(P.labelled(spark, sf)))


@register("customer_stats", Q.chain(*Q.FEAT_CHAIN) + Q.select(
    ["customer_id"], ["cust_mean", "cust_std", "cust_median"], "stats"))
def q_stats(spark, sf):
    """A1 through the skew-safe ranged plan (the flagship picks its plan)."""
    return fe.customer_stats(P.labelled(spark, sf), method="ranged")


@register("join_customer_stats", Q.chain(*Q.FEAT_CHAIN) + Q.select(
    TXO, TXD + ["cust_mean", "cust_std", "cust_median"], "joined"))
def q_join_stats(spark, sf):
    lab = P.labelled(spark, sf)
    return fe.join_customer_stats(lab, fe.customer_stats(lab))


@register("customer_deviation", Q.chain(*Q.FEAT_CHAIN) + Q.select(
    ["tx_id"], ["amount_deviation", "amount_zscore", "amount_to_median_ratio"], "feat"))
def q_deviation(spark, sf):
    lab = P.labelled(spark, sf)
    j = fe.add_amount_features(fe.join_customer_stats(lab, fe.customer_stats(lab)))
    return j.select("tx_id", "amount_deviation", "amount_zscore", "amount_to_median_ratio")


@register("tx_gap_seconds", Q.chain(*Q.FEAT_CHAIN) + Q.select(
    ["tx_id", "customer_id"], ["gap_seconds"], "gapped"))
def q_gap(spark, sf):
    return fe.tx_gap_seconds(P.labelled(spark, sf)).select("tx_id", "customer_id", "gap_seconds")


@register("velocity_features", Q.chain(*Q.FEAT_CHAIN) + Q.select(
    ["tx_id", "customer_id", "tx_frequency_1h", "tx_frequency_24h"], [], "feat"))
def q_velocity(spark, sf):
    """W2 through the skew-safe ranged plan (the flagship picks its plan)."""
    return fe.add_velocity_features(P.labelled(spark, sf), strategy="ranged").select(
        "tx_id", "customer_id", "tx_frequency_1h", "tx_frequency_24h")


@register("velocity_fallback", Q.chain(*Q.BASE) + """
SELECT tx_id, customer_id,
  CAST((row_number() OVER (PARTITION BY customer_id ORDER BY tx_id) - 1) % 5 AS BIGINT) AS tx_frequency_1h,
  CAST((row_number() OVER (PARTITION BY customer_id ORDER BY tx_id) - 1) % 20 AS BIGINT) AS tx_frequency_24h
FROM labelled""")
def q_fallback(spark, sf):
    lab = P.labelled(spark, sf).drop("timestamp")
    return fe.add_velocity_features(lab).select(
        "tx_id", "customer_id", "tx_frequency_1h", "tx_frequency_24h")


@register("engineer_features_no_timestamp", Q.chain(*Q.FEAT_CHAIN) + """,
fb AS (SELECT tx_id, (row_number() OVER (PARTITION BY customer_id ORDER BY tx_id) - 1) % 5 AS f1,
              (row_number() OVER (PARTITION BY customer_id ORDER BY tx_id) - 1) % 20 AS f24 FROM labelled)
SELECT f.tx_id, CAST(f1 AS BIGINT) AS tx_frequency_1h, CAST(f24 AS BIGINT) AS tx_frequency_24h,
       round(amount_zscore, 6) + 0.0 AS amount_zscore, round(hour_sin, 6) + 0.0 AS hour_sin,
       round(amount_x_distance, 6) + 0.0 AS amount_x_distance,
       round(amount_zscore * f1, 6) + 0.0 AS zscore_x_frequency
FROM feat f JOIN fb ON f.tx_id = fb.tx_id""")
def q_engineer_no_ts(spark, sf):
    """E7 on a table without a timestamp: velocity through W3."""
    return fe.engineer_features(P.labelled(spark, sf).drop("timestamp")).select(
        "tx_id", "tx_frequency_1h", "tx_frequency_24h", "amount_zscore", "hour_sin",
        "amount_x_distance", "zscore_x_frequency")


@register("cyclical_encoding", Q.chain(*Q.FEAT_CHAIN) + Q.select(
    ["tx_id"], ["hour_sin", "hour_cos", "day_sin", "day_cos"], "feat"))
def q_cyclical(spark, sf):
    return fe.add_cyclical_features(P.labelled(spark, sf)).select(
        "tx_id", "hour_sin", "hour_cos", "day_sin", "day_cos")


@register("interaction_features", Q.chain(*Q.FEAT_CHAIN) + Q.select(
    ["tx_id"], ["amount_x_distance", "amount_x_international", "zscore_x_frequency"], "feat"))
def q_interaction(spark, sf):
    return P.engineered(spark, sf).select(
        "tx_id", "amount_x_distance", "amount_x_international", "zscore_x_frequency")


_SEQUENCE = ["transaction_amount", "hour_sin", "tx_frequency_24h"]


@register("sequence_features", Q.chain(*Q.FEAT_CHAIN) + ",\nlong AS (" + " UNION ALL ".join(
    f"SELECT tx_id, {step} AS step, '{c}' AS feature, CASE WHEN lag(tx_id, {2 - step}) OVER w IS NULL "
    f"THEN 0.0 ELSE coalesce(lag(CAST({c} AS DOUBLE), {2 - step}) OVER w, 0.0) END AS value "
    "FROM feat WINDOW w AS (PARTITION BY customer_id ORDER BY \"timestamp\", tx_id)"
    for step in range(3) for c in _SEQUENCE) + ")\nSELECT tx_id, step, feature, round(value, 6) + 0.0 AS value FROM long")
def q_sequence(spark, sf):
    """W4 with length 3, one row per step and feature."""
    seq = fe.sequence_features(P.engineered(spark, sf), length=3, features=_SEQUENCE)
    names = F.array(*[F.lit(c) for c in _SEQUENCE])
    steps = seq.select("tx_id", F.posexplode("sequence").alias("step", "vector"))
    return steps.select("tx_id", "step", F.inline(F.arrays_zip(names.alias("feature"), F.col("vector").alias("value"))))


# ----------------------------------------------------- projections/filters ---
def _clean_expr(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL OR isnan(CAST({c} AS DOUBLE)) OR isinf(CAST({c} AS DOUBLE)) "
            f"THEN 0.0 ELSE CAST({c} AS DOUBLE) END")


_CLEAN = ", ".join(f"(round({_clean_expr(c)}, 6) + 0.0) AS {c}" for c in FEATURES)


@register("feature_matrix", Q.chain(*Q.FEAT_CHAIN) + Q.select(
    ["tx_id", "is_fraud"] + [c for c in FEATURES if c not in FEAT_ALL_DOUBLES],
    [c for c in FEATURES if c in FEAT_ALL_DOUBLES], "feat"))
def q_feature_matrix(spark, sf):
    return sc.feature_matrix(P.engineered(spark, sf))


@register("clean_features", Q.chain(*Q.FEAT_CHAIN) + f"SELECT tx_id, is_fraud, {_CLEAN} FROM feat")
def q_clean(spark, sf):
    return sc.clean_features(sc.feature_matrix(P.engineered(spark, sf)))


@register("normal_only", Q.chain(*Q.BASE) + Q.select(TXO, TXD, "labelled", "is_fraud = 0"))
def q_normal(spark, sf):
    return pr.normal_only(P.labelled(spark, sf))


_EXPLORE = "transaction_amount >= 10.0 AND transaction_amount <= 500.0 AND is_fraud = 1"


@register("explore_filter", Q.chain(*Q.BASE) + Q.select(
    TXO + ["CASE WHEN is_fraud = 1 THEN 1 ELSE 0 END AS is_marked"], TXD, "labelled", _EXPLORE))
def q_explore(spark, sf):
    return pr.explore_filter(P.labelled(spark, sf), "fraud", 10.0, 500.0)


@register("explore_counts", Q.chain(*Q.BASE) + f"""
SELECT CAST(count(*) FILTER (WHERE {_EXPLORE}) AS BIGINT) AS n_shown,
       CAST(count(*) AS BIGINT) AS n_total FROM labelled""")
def q_explore_counts(spark, sf):
    return pr.explore_counts(P.labelled(spark, sf), "fraud", 10.0, 500.0)


@register("explore_head", Q.chain(*Q.BASE) + Q.select(
    TXO + ["CASE WHEN is_fraud = 1 THEN 1 ELSE 0 END AS is_marked"], TXD, "labelled",
    "transaction_amount >= 0.0") + " ORDER BY tx_id LIMIT 500")
def q_explore_head(spark, sf):
    return pr.explore_head(P.labelled(spark, sf), 500, fraud_filter="all", min_amount=0.0)


# ---------------------------------------------------------------- joins ---
@register("join_profile", Q.chain(*Q.BASE) + """
SELECT l.tx_id, l.customer_id, l.hour_of_day, l.day_of_week, l.merchant_category,
       l.is_international, l.is_fraud, l."timestamp",
       round(l.transaction_amount, 6) + 0.0 AS transaction_amount,
       round(l.distance_from_home, 6) + 0.0 AS distance_from_home,
       round(p.avg_amount, 6) + 0.0 AS avg_amount, round(p.std_amount, 6) + 0.0 AS std_amount,
       p.active_hour_start, p.active_hour_end
FROM labelled l JOIN prof p ON l.customer_id = p.customer_id""")
def q_join_profile(spark, sf):
    tx = event_transactions(spark, sf)
    lab = P.labelled(spark, sf)
    return lab.join(inj.customer_profile(tx), "customer_id", "inner")


@register("align_scores", Q.chain(*Q.SCORE_CHAIN) + Q.select(
    ["tx_id", "model", "label", "prediction"], ["score"], "scores"))
def q_align(spark, sf):
    test = P.split(spark, sf, columns=P.RULE_COLUMNS).where(F.col("is_train") == 0)
    preds = all_rule_scores(test).drop("label")
    labels = test.select("tx_id", F.col("is_fraud").alias("label"))
    return scs.align_scores(preds, labels)


# ---------------------------------------------------------- aggregations ---
@register("hour_class_counts", Q.chain(*Q.BASE) + """
SELECT hour_of_day, is_fraud, CAST(count(*) AS BIGINT) AS count FROM labelled
GROUP BY hour_of_day, is_fraud""")
def q_hour_class(spark, sf):
    return pr.hour_class_counts(P.labelled(spark, sf))


def _hist_sql(source: str, value: str, cls: str, group: str | None, bins: int) -> str:
    b = (f"CAST(CASE WHEN r.hi = r.lo THEN 0 ELSE least(floor((s.{value} - r.lo) / "
         f"((r.hi - r.lo) / {float(bins)})), {bins - 1}) END AS INTEGER)")
    if group:
        rng = (f"rng AS (SELECT {group}, min({value}) AS lo, max({value}) AS hi "
               f"FROM {source} GROUP BY {group})")
        binned = (f"binned AS (SELECT s.{group} AS {group}, s.{cls} AS {cls}, {b} AS bin, r.lo, r.hi "
                  f"FROM {source} s JOIN rng r ON s.{group} = r.{group} WHERE s.{value} IS NOT NULL)")
        g = f"{group}, "
    else:
        rng = f"rng AS (SELECT min({value}) AS lo, max({value}) AS hi FROM {source})"
        binned = (f"binned AS (SELECT s.{cls} AS {cls}, {b} AS bin, r.lo, r.hi "
                  f"FROM {source} s CROSS JOIN rng r WHERE s.{value} IS NOT NULL)")
        g = ""
    return f"""{rng},
{binned}
SELECT {g}{cls}, bin,
       round(min(lo) + bin * (min(hi) - min(lo)) / {float(bins)}, 6) + 0.0 AS bin_start,
       CAST(count(*) AS BIGINT) AS n
FROM binned GROUP BY {g}{cls}, bin"""


@register("amount_histogram", Q.chain(*Q.BASE) + ", " + _hist_sql(
    "labelled", "transaction_amount", "is_fraud", None, 50))
def q_amount_hist(spark, sf):
    return pr.amount_histogram(P.labelled(spark, sf), 50)


@register("score_histogram", Q.chain(*Q.SCORE_CHAIN) + ", " + _hist_sql(
    "scores", "score", "label", "model", 80))
def q_score_hist(spark, sf):
    return ev.score_histogram(P.rule_scores(spark, sf), 80)


_DESCRIBE_COLS = ["tx_id", "customer_id", "transaction_amount", "hour_of_day", "day_of_week",
                  "merchant_category", "distance_from_home", "is_international", "is_fraud"]


def _describe_sql() -> str:
    parts = []
    for c in _DESCRIBE_COLS:
        parts.append(f"""SELECT '{c}' AS variable,
  {Q.MONEY(f'CAST(count({c}) AS DOUBLE)')} AS count, {Q.MONEY(f'avg({c})')} AS mean,
  {Q.MONEY(f'stddev_samp({c})')} AS std, {Q.MONEY(f'CAST(min({c}) AS DOUBLE)')} AS min,
  {Q.MONEY(f'quantile_cont(CAST({c} AS DOUBLE), 0.25)')} AS p25,
  {Q.MONEY(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)')} AS p50,
  {Q.MONEY(f'quantile_cont(CAST({c} AS DOUBLE), 0.75)')} AS p75,
  {Q.MONEY(f'CAST(max({c}) AS DOUBLE)')} AS max FROM labelled""")
    inner = "\nUNION ALL\n".join(parts)
    cols = ", ".join(f"round({s}, 6) + 0.0 AS {s}" for s in
                     ["count", "mean", "std", "min", "p25", "p50", "p75", "max"])
    return f"SELECT variable, {cols} FROM (\n{inner})"


@register("describe", Q.chain(*Q.BASE) + _describe_sql())
def q_describe(spark, sf):
    return pr.describe(P.labelled(spark, sf), _DESCRIBE_COLS)


@register("scale_pos_weight", Q.chain(*Q.SPLIT_CHAIN) + """
SELECT CAST(count(*) FILTER (WHERE is_fraud = 0) AS BIGINT) AS n_neg,
       CAST(count(*) FILTER (WHERE is_fraud = 1) AS BIGINT) AS n_pos,
       round(CAST(count(*) FILTER (WHERE is_fraud = 0) AS DOUBLE)
             / greatest(count(*) FILTER (WHERE is_fraud = 1), 1), 6) + 0.0 AS scale_pos_weight
FROM split WHERE is_train = 1""")
def q_spw(spark, sf):
    return pr.scale_pos_weight(P.split(spark, sf, columns=["is_fraud"]).where(F.col("is_train") == 1))


@register("confusion_matrix", Q.chain(*Q.SCORE_CHAIN, Q.CONF) + """
SELECT model, tn AS true_negatives, fp AS false_positives, fn AS false_negatives,
       tp AS true_positives FROM conf""")
def q_confusion(spark, sf):
    return ev.confusion_counts(P.rule_scores(spark, sf))


@register("score_threshold", Q.chain(*Q.SCORE_CHAIN) + """
SELECT model, round(quantile_cont(score, 0.95), 6) + 0.0 AS threshold FROM scores GROUP BY model""")
def q_score_threshold(spark, sf):
    return ev.score_quantile(P.rule_scores(spark, sf), 0.95)


@register("score_threshold_sketch", Q.chain(*Q.SCORE_CHAIN) + """
SELECT model, CAST(count(score) AS BIGINT) AS n_scores, TRUE AS within_rank_error FROM scores GROUP BY model""")
def q_score_threshold_sketch(spark, sf):
    """A8 from sketches written per (model, class) and merged per model, and whether the exact rank
    of the threshold is within the sketch's stated error."""
    scores = materialize(P.rule_scores(spark, sf), "scores")
    parts = materialize(sk.score_sketches(scores, ["model", "label"]), "score-sketches")
    found = sk.sketch_quantiles(sk.merge_score_sketches(parts, ["model"]), ["model"], {"threshold": 0.95})
    ranks = scores.join(found, "model").groupBy("model").agg(
        F.first("n").alias("n_scores"),
        F.avg((F.col("score") < F.col("threshold")).cast("double")).alias("below"),
        F.avg((F.col("score") <= F.col("threshold")).cast("double")).alias("up_to"))
    error = F.lit(sk.kll_rank_error())
    return ranks.select("model", "n_scores", (
        (F.col("below") <= F.lit(0.95) + error) & (F.col("up_to") >= F.lit(0.95) - error)).alias("within_rank_error"))


@register("score_range", Q.chain(*Q.SCORE_CHAIN) + """
SELECT model, round(min(score), 6) + 0.0 AS min_score, round(max(score), 6) + 0.0 AS max_score,
       round((max(score) - min(score)) / 200.0, 6) + 0.0 AS step FROM scores GROUP BY model""")
def q_score_range(spark, sf):
    return pr.score_range(P.rule_scores(spark, sf))


_SCALER_CTE = "scal AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg(CAST({c} AS DOUBLE)) AS mean, "
    f"CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) = 0 THEN 1.0 ELSE stddev_pop(CAST({c} AS DOUBLE)) END AS std "
    f"FROM clean WHERE is_train = 1" for c in FEATURES) + ")"
_CLEAN_CTE = ("clean AS (SELECT tx_id, is_train, "
              + ", ".join(f"{_clean_expr(c)} AS {c}" for c in FEATURES) + " FROM split)")


@register("scaler_fit", Q.chain(*Q.SPLIT_CHAIN, _CLEAN_CTE, _SCALER_CTE)
          + "SELECT feature, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std FROM scal")
def q_scaler(spark, sf):
    train = sc.clean_features(P.split(spark, sf).where(F.col("is_train") == 1))
    return sc.scaler_stats(train)


def _scale_clip_sql() -> str:
    cols = []
    for c in FEATURES:
        z = (f"(c.{c} - (SELECT mean FROM scal WHERE feature = '{c}')) / "
             f"(SELECT std FROM scal WHERE feature = '{c}')")
        cols.append(f"round(least(greatest({z}, -10.0), 10.0), 6) + 0.0 AS {c}")
    return f"SELECT c.tx_id, {', '.join(cols)} FROM clean c WHERE c.is_train = 0"


@register("scale_clip", Q.chain(*Q.SPLIT_CHAIN, _CLEAN_CTE, _SCALER_CTE) + _scale_clip_sql())
def q_scale_clip(spark, sf):
    sp = sc.clean_features(P.split(spark, sf))
    scaler = sc.fit_scaler(sp.where(F.col("is_train") == 1))
    return scaler.transform(sp.where(F.col("is_train") == 0)).select("tx_id", *FEATURES)


@register("customer_profile", Q.chain(Q.TX, Q.PROFILE) + Q.select(
    ["customer_id", "active_hour_start", "active_hour_end"], ["avg_amount", "std_amount"], "prof"))
def q_profile(spark, sf):
    return inj.customer_profile(event_transactions(spark, sf))


@register("distinct_customers", Q.chain(*Q.BASE)
          + "SELECT CAST(count(DISTINCT customer_id) AS BIGINT) AS n_customers FROM labelled")
def q_distinct(spark, sf):
    return pr.distinct_customers(P.labelled(spark, sf))


@register("distinct_customers_sketch", Q.chain(*Q.BASE) + """
SELECT CAST(count(DISTINCT CAST("timestamp" AS DATE)) AS BIGINT) AS n_days,
       CAST(count(DISTINCT customer_id) AS BIGINT) AS n_customers, TRUE AS within_relative_error FROM labelled""")
def q_distinct_sketch(spark, sf):
    """A13 from one sketch per day, merged over all days, against the exact number (three standard errors)."""
    tx = P.labelled(spark, sf, persist=True)
    days = materialize(sk.distinct_sketches(tx, [F.to_date("timestamp").alias("day")]), "day-sketches")
    facts = (sk.distinct_from_sketches(days, name="estimate")
             .unionByName(days.agg(F.count("day").alias("n_days")), allowMissingColumns=True)
             .unionByName(pr.distinct_customers(tx), allowMissingColumns=True)
             .agg(*[F.max(c).alias(c) for c in ("estimate", "n_days", "n_customers")]))
    off = F.abs(F.col("estimate") - F.col("n_customers"))
    return facts.select("n_days", "n_customers", (
        off <= F.col("n_customers") * F.lit(3 * sk.hll_relative_error())).alias("within_relative_error"))


# ------------------------------------------------------ ordered operators ---
@register("temporal_split", Q.chain(*Q.SPLIT_CHAIN)
          + "SELECT tx_id, CAST(pos AS BIGINT) AS pos, is_train, CAST(n_rows AS BIGINT) AS n_rows FROM split")
def q_split(spark, sf):
    """W5 with explicit positions (G1: range-partitioned running count)."""
    return ordered.positional_split(P.engineered(spark, sf), list(P.SPLIT_ORDER)).select(
        "tx_id", "pos", "is_train", "n_rows")


@register("temporal_split_cut", Q.chain(*Q.SPLIT_CHAIN)
          + "SELECT tx_id, is_train, CAST(n_rows AS BIGINT) AS n_rows FROM split")
def q_split_cut(spark, sf):
    """W5 by exact rank selection of the cut key (the pipeline's split)."""
    return P.split(spark, sf, columns=[]).select("tx_id", "is_train", "n_rows")


@register("temporal_split_null_ts", Q.chain(*Q.BASE) + """,
sp AS (SELECT tx_id, row_number() OVER (ORDER BY CASE WHEN tx_id % 10 = 3 THEN NULL ELSE "timestamp" END
                                        NULLS LAST, tx_id) - 1 AS pos, count(*) OVER () AS n_rows FROM labelled)
SELECT tx_id, CASE WHEN pos < floor(n_rows * 0.8) THEN 1 ELSE 0 END AS is_train,
       CAST(n_rows AS BIGINT) AS n_rows FROM sp""")
def q_split_null_ts(spark, sf):
    """W5 where a tenth of the timestamps is missing: they come last, and every row has a side."""
    from txsentinel.session import materialize
    time = F.when(F.expr("tx_id % 10 = 3"), F.lit(None)).otherwise(F.col("timestamp"))
    lab = materialize(P.labelled(spark, sf).withColumn("timestamp", time).select("tx_id", "timestamp"), "null-ts")
    return ordered.positional_split_by_cut(lab, list(P.SPLIT_ORDER)).select("tx_id", "is_train", "n_rows")


@register("split_no_timestamp", Q.chain(*Q.BASE) + """,
sp AS (SELECT tx_id, row_number() OVER (ORDER BY tx_id) - 1 AS pos, count(*) OVER () AS n_rows FROM labelled)
SELECT tx_id, CASE WHEN pos < floor(n_rows * 0.8) THEN 1 ELSE 0 END AS is_train,
       CAST(n_rows AS BIGINT) AS n_rows FROM sp""")
def q_split_no_ts(spark, sf):
    """W5 of a table without a timestamp: by tx_id."""
    return ordered.positional_split_by_cut(P.labelled(spark, sf).select("tx_id"), ["tx_id"])


_ORDER_TX = """otx AS (SELECT CAST(o_orderkey AS BIGINT) AS tx_id, CAST(o_custkey AS BIGINT) AS customer_id,
  CAST(o_totalprice AS DOUBLE) AS transaction_amount, CAST(o_orderdate AS TIMESTAMP) AS ts FROM orders)"""


@register("orders_velocity", f"WITH {_ORDER_TX}," + """
g AS (SELECT *, coalesce(date_diff('microsecond', lag(ts) OVER w, ts) / 1e6, 9999.0) AS gap FROM otx
      WINDOW w AS (PARTITION BY customer_id ORDER BY ts, tx_id))
SELECT tx_id, customer_id,
  CAST(sum(CASE WHEN gap < 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY customer_id ORDER BY ts, tx_id
       ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS BIGINT) AS tx_frequency_1h,
  CAST(sum(CASE WHEN gap < 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY customer_id ORDER BY ts, tx_id
       ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS BIGINT) AS tx_frequency_24h FROM g""")
def q_orders_velocity(spark, sf):
    """W1/W2 on orders: whole days, so many equal times; tx_id decides."""
    return fe.add_velocity_features(order_transactions(spark, sf), strategy="ranged").select(
        "tx_id", "customer_id", "tx_frequency_1h", "tx_frequency_24h")


@register("orders_split", f"WITH {_ORDER_TX}," + """
sp AS (SELECT tx_id, row_number() OVER (ORDER BY ts, tx_id) - 1 AS pos, count(*) OVER () AS n_rows FROM otx)
SELECT tx_id, CASE WHEN pos < floor(n_rows * 0.8) THEN 1 ELSE 0 END AS is_train,
       CAST(n_rows AS BIGINT) AS n_rows FROM sp""")
def q_orders_split(spark, sf):
    tx = order_transactions(spark, sf).select("tx_id", "timestamp")
    return ordered.positional_split_by_cut(tx, list(P.SPLIT_ORDER)).select("tx_id", "is_train", "n_rows")


@register("orders_customer_stats", f"WITH {_ORDER_TX}" + f"""
SELECT customer_id, {Q.MONEY('avg(transaction_amount)')} AS cust_mean,
       {Q.MONEY('coalesce(stddev_samp(transaction_amount), 1.0)')} AS cust_std,
       {Q.MONEY('quantile_cont(transaction_amount, 0.5)')} AS cust_median FROM otx GROUP BY customer_id""")
def q_orders_stats(spark, sf):
    stats = fe.customer_stats(order_transactions(spark, sf), method="ranged")
    return stats.select("customer_id", *[round_money(c).alias(c) for c in ("cust_mean", "cust_std", "cust_median")])


@register("purged_folds", Q.chain(*Q.SPLIT_CHAIN) + """,
tr AS (SELECT tx_id, pos, count(*) OVER () AS n FROM split WHERE is_train = 1),
folds AS (SELECT CAST(i AS INTEGER) AS fold FROM range(5) t(i)),
bounds AS (SELECT f.fold, t.tx_id, t.pos, (t.n // 5) * f.fold AS vs,
                  CASE WHEN f.fold < 4 THEN (t.n // 5) * f.fold + t.n // 5 ELSE t.n END AS ve, t.n
           FROM tr t, folds f)
SELECT tx_id, fold, CASE WHEN pos >= vs AND pos < ve THEN 'val' ELSE 'train' END AS role
FROM bounds
WHERE (pos >= vs AND pos < ve) OR pos < vs - 50 OR pos >= ve + 10""")
def q_folds(spark, sf):
    """W6 on key ranges (exact rank selection), the folds the search uses."""
    train = P.split(spark, sf, columns=[]).where(F.col("is_train") == 1)
    return ordered.purged_kfold_by_keys(train, ["timestamp", "tx_id"], None, 5, 50, 10).select(
        "tx_id", "fold", "role")


@register("cumulative_counts", Q.chain(*Q.SCORE_CHAIN, Q.CURVE) + """
SELECT model, round(score, 6) + 0.0 AS score, pos, neg, tp, fp, n_pos, n_neg FROM curve""")
def q_cumulative(spark, sf):
    """W7 through the range-partitioned plan (the evaluation picks its plan)."""
    return ev.cumulative_counts(P.rule_scores(spark, sf), method="ranged").select(
        "model", "score", "pos", "neg", "tp", "fp", "n_pos", "n_neg")


@register("optimal_threshold", Q.chain(*Q.SCORE_CHAIN, Q.CURVE, Q.OPTIMAL) + Q.select(
    ["model"], ["optimal_threshold", "f1_at_optimal", "precision_at_optimal", "recall_at_optimal"],
    "optimal"))
def q_optimal(spark, sf):
    return ev.optimal_threshold(ev.cumulative_counts(P.rule_scores(spark, sf)))


@register("compare_thresholds", Q.chain(*Q.SCORE_CHAIN, Q.CURVE, Q.OPTIMAL) + Q.select(
    ["model", "row_number() OVER (ORDER BY f1_at_optimal DESC, model) AS rank"],
    ["optimal_threshold", "f1_at_optimal", "precision_at_optimal", "recall_at_optimal"],
    "optimal"))
def q_compare(spark, sf):
    return ev.compare_thresholds(ev.optimal_threshold(ev.cumulative_counts(P.rule_scores(spark, sf))))


# ---------------------------------------------------------- sorts/sample ---
def _md5_key(seed: int) -> str:
    return f"md5(CAST(tx_id AS VARCHAR) || ':{seed}')"


@register("sample_n", Q.chain(*Q.BASE) + Q.select(TXO, TXD, "labelled")
          + f" ORDER BY {_md5_key(42)}, tx_id LIMIT 5000")
def q_sample(spark, sf):
    return pr.sample_n(P.labelled(spark, sf), 5000, 42)


@register("hash_shuffle", Q.chain(*Q.BASE) + Q.select(
    TXO + [f"{_md5_key(42)} AS shuffle_key"], TXD, "labelled"))
def q_shuffle(spark, sf):
    return pr.hash_shuffle(P.labelled(spark, sf), 42)


@register("union_labeled", Q.chain(*Q.BASE) + Q.select(TXO, TXD, "labelled"))
def q_union(spark, sf):
    lab = P.labelled(spark, sf)
    return pr.union_labeled(lab.where(F.col("is_fraud") == 0), lab.where(F.col("is_fraud") == 1))


# ---------------------------------------------------------- scalar funcs ---
@register("planar_distance_km", Q.chain(*Q.BASE) + f"""
SELECT tx_id, round(sqrt((lat - home_lat) * (lat - home_lat) + (lon - home_lon) * (lon - home_lon)) * 111.0, 6) + 0.0
  AS distance_km
FROM (SELECT tx_id, distance_from_home / 111.0 * cos(2 * pi() * {Q.U('tx_id', 'angle')}) AS lat,
             distance_from_home / 111.0 * sin(2 * pi() * {Q.U('tx_id', 'angle')}) AS lon,
             {Q.U('customer_id', 'lat')} AS home_lat, {Q.U('customer_id', 'lon')} AS home_lon
      FROM labelled)""")
def q_planar(spark, sf):
    lab = P.labelled(spark, sf)
    ang = F.lit(2.0 * math.pi) * keyed_uniform("tx_id", "angle")
    pts = lab.select("tx_id",
                     (F.col("distance_from_home") / F.lit(111.0) * F.cos(ang)).alias("lat"),
                     (F.col("distance_from_home") / F.lit(111.0) * F.sin(ang)).alias("lon"),
                     keyed_uniform("customer_id", "lat").alias("home_lat"),
                     keyed_uniform("customer_id", "lon").alias("home_lon"))
    return pts.select("tx_id", planar_distance_km("lat", "lon", "home_lat", "home_lon").alias("distance_km"))


@register("timestamp_from_hours", """
SELECT event_id AS tx_id,
       CAST(TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(floor(value) AS BIGINT)) AS TIMESTAMP) AS "timestamp"
FROM events""")
def q_ts_hours(spark, sf):
    e = read_table(spark, sf, "events")
    return e.select(F.col("event_id").alias("tx_id"),
                    timestamp_from_hours("value", "2024-01-01 00:00:00").alias("timestamp"))


@register("clock_hour", """
SELECT event_id AS tx_id, CAST((CAST(floor(value) AS BIGINT) % 24 + 24) % 24 AS INTEGER) AS hour FROM events
WHERE value IS NOT NULL AND NOT isnan(value)""")
def q_clock_hour(spark, sf):
    e = read_table(spark, sf, "events").where("value IS NOT NULL AND NOT isnan(value)")
    return e.select(F.col("event_id").alias("tx_id"), clock_hour("value").cast("int").alias("hour"))


@register("flag_scores", Q.chain(*Q.SCORE_CHAIN) + """
SELECT tx_id, model, label, round(score, 6) + 0.0 AS score,
       CASE WHEN score >= 2.0 THEN 1 ELSE 0 END AS prediction FROM scores""")
def q_flag(spark, sf):
    return ev.flag_scores(P.rule_scores(spark, sf), 2.0, strict=False)


_MSE = (["transaction_amount", "distance_from_home", "amount_zscore"],
        ["amount_deviation", "amount_x_international", "amount_to_median_ratio"])


@register("vector_mse", Q.chain(*Q.FEAT_CHAIN) + "SELECT tx_id, round((" + " + ".join(
    f"pow(coalesce(CAST({x} AS DOUBLE), 0.0) - coalesce(CAST({y} AS DOUBLE), 0.0), 2)" for x, y in zip(*_MSE))
    + ") / 3.0, 6) + 0.0 AS mse FROM feat")
def q_mse(spark, sf):
    """E14 of two vectors of each row."""
    a, b = (F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]) for cols in _MSE)
    return P.engineered(spark, sf).select("tx_id", vector_mse(a, b).alias("mse"))


@register("param_fold_rows", Q.chain(*Q.SPLIT_CHAIN) + """,
tr AS (SELECT tx_id, pos, count(*) OVER () AS n FROM split WHERE is_train = 1),
bounds AS (SELECT f.fold, t.tx_id, t.pos, (t.n // 5) * f.fold AS vs,
                  CASE WHEN f.fold < 4 THEN (t.n // 5) * f.fold + t.n // 5 ELSE t.n END AS ve
           FROM tr t, (SELECT CAST(i AS INTEGER) AS fold FROM range(5) r(i)) f)
SELECT tx_id, fold, CASE WHEN pos >= vs AND pos < ve THEN 'val' ELSE 'train' END AS role
FROM bounds WHERE (pos >= vs AND pos < ve) OR pos < vs - 50 OR pos >= ve + 10""")
def q_param_fold_rows(spark, sf):
    """M4: the rows that each fold of the parameter search trains and validates on, read from the mask."""
    from txsentinel.operators.detectors.gbt import fold_mask, in_role
    train = P.split(spark, sf, columns=[]).where("is_train = 1")
    folds = ordered.fold_roles(train, ["timestamp", "tx_id"], 5, 50, 10)
    masked = train.select("tx_id", fold_mask(folds).alias("_mask"))
    roles = F.array(*[F.struct(F.lit(f).alias("fold"), F.when(in_role(f, "train"), "train")
                               .when(in_role(f, "val"), "val").alias("role")) for f, _ in folds])
    return masked.select("tx_id", F.inline(roles)).where("role IS NOT NULL")


# ------------------------------------------------------------ injection ---
@register("inject_anomalies", Q.chain(*Q.BASE) + Q.select(TXO, TXD, "labelled"))
def q_inject(spark, sf):
    return P.labelled(spark, sf)


@register("injection_report", Q.chain(*Q.BASE) + """
SELECT is_fraud, coalesce(attack_vector, 'none') AS attack_vector, CAST(count(*) AS BIGINT) AS n
FROM labelled GROUP BY is_fraud, coalesce(attack_vector, 'none')""")
def q_inj_report(spark, sf):
    return inj.injection_report(P.labelled(spark, sf, with_vector=True))


# ----------------------------------------------------------- evaluation ---
@register("classification_metrics", Q.chain(*Q.SCORE_CHAIN, Q.CONF) + Q.select(
    ["model", "true_positives", "false_positives", "true_negatives", "false_negatives"],
    ["accuracy", "precision", "recall", "f1_score", "total_cost"], "metrics"))
def q_metrics(spark, sf):
    return ev.classification_metrics(P.rule_scores(spark, sf))


@register("financial_cost", Q.chain(*Q.SCORE_CHAIN, Q.CONF) + Q.select(
    ["model", "false_negatives", "false_positives"], ["total_cost"], "metrics"))
def q_cost(spark, sf):
    return ev.financial_cost(P.rule_scores(spark, sf))


@register("auc_roc", Q.chain(*Q.SCORE_CHAIN, Q.CURVE, Q.AUC) + Q.select(["model"], ["auc_roc"], "auc"))
def q_auc(spark, sf):
    return ev.auc_scores(ev.cumulative_counts(P.rule_scores(spark, sf))).select("model", "auc_roc")


@register("average_precision", Q.chain(*Q.SCORE_CHAIN, Q.CURVE, Q.AUC) + Q.select(
    ["model"], ["auc_pr"], "auc"))
def q_ap(spark, sf):
    return ev.auc_scores(ev.cumulative_counts(P.rule_scores(spark, sf))).select("model", "auc_pr")


def _sweep_sql() -> str:
    return """,
rng AS (SELECT model, min(score) AS lo, max(score) AS hi, sum(label) AS n_pos FROM scores GROUP BY model),
grid AS (SELECT model, CAST(j AS INTEGER) AS j,
                CASE WHEN j >= 200 THEN hi ELSE lo + j * ((hi - lo) / 200.0) END AS t, n_pos
         FROM rng, range(201) r(j)),
cnt AS (SELECT g.model, g.j, g.t, g.n_pos,
               count(*) FILTER (WHERE s.score >= g.t AND s.label = 1) AS tp,
               count(*) FILTER (WHERE s.score >= g.t AND s.label = 0) AS fp
        FROM grid g JOIN scores s ON g.model = s.model GROUP BY g.model, g.j, g.t, g.n_pos)
SELECT model, j, round(t, 6) + 0.0 AS threshold,
  round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0), 6) + 0.0 AS precision,
  round(coalesce(CAST(tp AS DOUBLE) / nullif(n_pos, 0), 0.0), 6) + 0.0 AS recall,
  round(coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + (n_pos - tp), 0), 0.0), 6) + 0.0 AS f1
FROM cnt"""


@register("threshold_sweep", Q.chain(*Q.SCORE_CHAIN) + _sweep_sql())
def q_sweep(spark, sf):
    return ev.threshold_sweep(P.rule_scores(spark, sf), 200)


@register("pr_curve", Q.chain(*Q.SCORE_CHAIN, Q.CURVE) + """
SELECT model, round(score, 6) + 0.0 AS threshold,
       round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0), 6) + 0.0 AS precision,
       round(CASE WHEN n_pos = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / n_pos END, 6) + 0.0 AS recall
FROM curve
UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), 1.0, 0.0 FROM curve""")
def q_pr(spark, sf):
    return ev.pr_curve(ev.cumulative_counts(P.rule_scores(spark, sf)))


@register("roc_curve", Q.chain(*Q.SCORE_CHAIN, Q.CURVE) + """
SELECT model, round(score, 6) + 0.0 AS threshold,
       round(coalesce(CAST(fp AS DOUBLE) / nullif(n_neg, 0), 0.0), 6) + 0.0 AS fpr,
       round(coalesce(CAST(tp AS DOUBLE) / nullif(n_pos, 0), 0.0), 6) + 0.0 AS tpr
FROM curve
UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), 0.0, 0.0 FROM curve""")
def q_roc(spark, sf):
    return ev.roc_curve(ev.cumulative_counts(P.rule_scores(spark, sf)))


@register("confusion_long", Q.chain(*Q.SCORE_CHAIN, Q.CONF) + """
SELECT model, 0 AS actual, 0 AS predicted, tn AS n FROM conf
UNION ALL SELECT model, 0, 1, fp FROM conf
UNION ALL SELECT model, 1, 0, fn FROM conf
UNION ALL SELECT model, 1, 1, tp FROM conf""")
def q_conf_long(spark, sf):
    return ev.confusion_long(P.rule_scores(spark, sf))


_TOUR_SEL = Q.select(["model", "rank"], ["accuracy", "precision", "recall", "f1_score",
                                          "auc_roc", "auc_pr", "total_cost"], "tour")


@register("tournament", Q.chain(*Q.SCORE_CHAIN, Q.CONF, Q.CURVE, Q.AUC, Q.TOURNAMENT) + _TOUR_SEL)
def q_tournament(spark, sf):
    return ev.tournament(P.rule_scores(spark, sf))


@register("winner", Q.chain(*Q.SCORE_CHAIN, Q.CONF, Q.CURVE, Q.AUC, Q.TOURNAMENT)
          + _TOUR_SEL + " WHERE rank = 1")
def q_winner(spark, sf):
    return ev.winner(ev.tournament(P.rule_scores(spark, sf)))


@register("metrics_long", Q.chain(*Q.SCORE_CHAIN, Q.CONF, Q.CURVE, Q.AUC, Q.TOURNAMENT) + """
SELECT model, metric, round(value, 6) + 0.0 AS value FROM (
  UNPIVOT (SELECT model, accuracy, precision, recall, f1_score FROM tour)
  ON accuracy, precision, recall, f1_score INTO NAME metric VALUE value)""")
def q_metrics_long(spark, sf):
    return ev.metrics_long(ev.tournament(P.rule_scores(spark, sf)))


@register("best_per_metric", Q.chain(*Q.SCORE_CHAIN, Q.CONF, Q.CURVE, Q.AUC, Q.TOURNAMENT) + """,
long AS (UNPIVOT (SELECT model, CAST(accuracy AS DOUBLE) AS accuracy, CAST(precision AS DOUBLE) AS precision,
                         CAST(recall AS DOUBLE) AS recall, CAST(f1_score AS DOUBLE) AS f1_score,
                         CAST(auc_roc AS DOUBLE) AS auc_roc, CAST(total_cost AS DOUBLE) AS total_cost FROM tour)
         ON accuracy, precision, recall, f1_score, auc_roc, total_cost INTO NAME metric VALUE value)
SELECT model, metric, round(value, 6) + 0.0 AS value,
       CAST(value = CASE WHEN metric = 'total_cost' THEN min(value) OVER (PARTITION BY metric)
                         ELSE max(value) OVER (PARTITION BY metric) END AS INTEGER) AS is_best
FROM long""")
def q_best(spark, sf):
    return ev.best_per_metric(ev.tournament(P.rule_scores(spark, sf)))


# ------------------------------------------------------------- sinks/json ---
@register("scores_long", Q.chain(*Q.SCORE_CHAIN) + Q.select(
    ["tx_id", "label", "prediction", "model"], ["score"], "scores", "model = 'zscore_rule'"))
def q_scores_long(spark, sf):
    path = checkpoint_dir(spark).rstrip("/") + f"/scores_long-{uuid.uuid4().hex}"
    scs.write_scores(P.rule_scores(spark, sf), path)
    return scs.read_scores(spark, path, ["zscore_rule"]).select(
        "tx_id", "label", "prediction", "score", "model")


@register("parse_tx_json", Q.chain(*Q.FEAT_CHAIN) + "SELECT tx_id, " + ", ".join(
    f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in FEATURES)
    + ", CASE WHEN " + " AND ".join(f"{c} IS NOT NULL" for c in FEATURES)
    + " THEN 1 ELSE 0 END AS is_valid FROM feat")
def q_parse_json(spark, sf):
    return js.parse_tx_json(js.features_to_json(P.engineered(spark, sf))).drop("reject_reason")


# Two features go missing in some rows, so that there is something to reject.
_GAPS = {"amount_zscore": (17, 5), "hour_sin": (23, 7)}
_GAPPY = ",\ngappy AS (SELECT * REPLACE (" + ", ".join(
    f"CASE WHEN tx_id % {m} = {r} THEN NULL ELSE {c} END AS {c}" for c, (m, r) in _GAPS.items()) + ") FROM feat)\n"


def _gappy(spark, sf):
    out = P.engineered(spark, sf)
    for c, (m, r) in _GAPS.items():
        out = out.withColumn(c, F.when(F.col("tx_id") % m == r, F.lit(None)).otherwise(F.col(c)))
    return out


@register("parse_tx_json_rejects", Q.chain(*Q.FEAT_CHAIN) + _GAPPY + "SELECT tx_id, 'missing ' || concat_ws(',', "
          + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in FEATURES)
          + ") AS reject_reason FROM gappy WHERE NOT (" + " AND ".join(f"{c} IS NOT NULL" for c in FEATURES) + ")")
def q_parse_rejects(spark, sf):
    """What the parser rejects, and why."""
    parsed = js.parse_tx_json(js.features_to_json(_gappy(spark, sf)))
    return parsed.where("is_valid = 0").select("tx_id", "reject_reason")


_RULE_JSON = ", ".join(
    f"CASE WHEN ok THEN round(coalesce(abs({c}), 0.0), 6) + 0.0 END AS {m}_score, "
    f"CASE WHEN ok THEN CASE WHEN coalesce(abs({c}), 0.0) > {t} THEN 1 ELSE 0 END END AS {m}_fraud"
    for m, c, t in DEFAULT_RULES)


@register("predictions_json", Q.chain(*Q.FEAT_CHAIN) + _GAPPY + ",\nchecked AS (SELECT *, "
          + " AND ".join(f"{c} IS NOT NULL" for c in FEATURES) + " AS ok FROM gappy)\n"
          + f"SELECT tx_id, CASE WHEN ok THEN 'analysed' ELSE 'rejected' END AS status, {_RULE_JSON} FROM checked")
def q_pred_json(spark, sf):
    """The JSON response of every record, accepted or not, read back into columns."""
    from txsentinel.operators.detectors.rule import default_rule_detectors
    from txsentinel.plans.scoring import score_json_records
    answers = score_json_records(js.features_to_json(_gappy(spark, sf)), default_rule_detectors())
    verdict = "struct<is_fraud:boolean,score:double>"
    names = [m for m, _, _ in DEFAULT_RULES]
    shape = "struct<status:string,predictions:struct<" + ",".join(f"{m}:{verdict}" for m in names) + ">>"
    read = answers.select("tx_id", F.from_json("response", shape).alias("r"))
    return read.select("tx_id", "r.status", *[
        c for m in names for c in (F.col(f"r.predictions.{m}.score").alias(f"{m}_score"),
                                   F.col(f"r.predictions.{m}.is_fraud").cast("int").alias(f"{m}_fraud"))])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["engineer_features"][0](spark, sf_dir)


__all__ = ["QUERIES", "flagship", "rounded", "TX_COLUMNS"]


# ------------------------------------------------------ detectors (rows) ---
def _models():
    from txsentinel.plans import models as M
    return M


@register("gbt_scores")
def q_gbt(spark, sf):
    M = _models()
    return M.fitted(spark, sf, "gbt").score(M.test_rows(spark, sf))


@register("feature_importances")
def q_importances(spark, sf):
    return _models().fitted(spark, sf, "gbt").importances()


@register("top_importances")
def q_top_importances(spark, sf):
    from txsentinel.operators.detectors.gbt import top_importances
    return top_importances(_models().fitted(spark, sf, "gbt").importances(), 15)


@register("iforest_scores")
def q_iforest(spark, sf):
    M = _models()
    return M.fitted(spark, sf, "isolation_forest").score(M.test_rows(spark, sf))


_IF = "if42"
_IF_TREES, _IF_PSI = 200, 256


def _iforest_sample_sql() -> str:
    strides = [s for s in range(1, _IF_TREES + 1) if math.gcd(s, _IF_TREES) == 1]
    return f""",
nn AS (SELECT count(*) AS n, least({_IF_PSI}, count(*)) AS psi FROM labelled),
pp AS (SELECT psi, 1.5 * psi / greatest(n, 1) AS p FROM nn),
pmf AS (SELECT CAST(k AS INTEGER) AS k, CASE WHEN p >= 1 THEN 0.0 ELSE
          exp(lgamma({_IF_TREES} + 1.0) - lgamma(k + 1.0) - lgamma({_IF_TREES} - k + 1.0)
              + k * ln(p) + ({_IF_TREES} - k) * ln(1 - least(p, 0.999999999))) END AS f
        FROM pp, range({_IF_TREES}) r(k)),
cdf AS (SELECT k, sum(f) OVER (ORDER BY k) AS c FROM pmf),
u AS (SELECT tx_id, {Q.U('tx_id', _IF + 'count')} AS u, {Q.U('tx_id', _IF + 'start')} AS us,
             {Q.U('tx_id', _IF + 'stride')} AS ut FROM labelled),
k AS (SELECT u.tx_id, any_value(us) AS us, any_value(ut) AS ut, count(*) FILTER (WHERE c <= u) AS k
      FROM u, cdf GROUP BY u.tx_id),
dealt AS (SELECT tx_id, CAST((CAST(floor(us * {_IF_TREES}) AS BIGINT) + j * {strides}[CAST(floor(ut * {len(strides)}) AS BIGINT) + 1])
                             % {_IF_TREES} AS INTEGER) AS tree_id
          FROM k, range({_IF_TREES}) r(j) WHERE j < k),
ranked AS (SELECT tree_id, tx_id, row_number() OVER (PARTITION BY tree_id ORDER BY
             {Q.U("(CAST(tx_id AS VARCHAR) || ':' || CAST(tree_id AS VARCHAR))", _IF + 'rank')}, tx_id) AS r FROM dealt)
SELECT tree_id, tx_id FROM ranked, pp WHERE r <= psi"""


@register("iforest_sample", Q.chain(*Q.BASE) + _iforest_sample_sql())
def q_iforest_sample(spark, sf):
    """M6: the rows that every isolation tree grows from."""
    from txsentinel.operators.detectors.iforest import tree_samples
    lab = P.labelled(spark, sf).select("tx_id")
    n = lab.count()
    return tree_samples(lab, n, _IF_TREES, min(_IF_PSI, n), 42).select("tree_id", "tx_id")


@register("autoencoder_validation", Q.chain(*Q.SPLIT_CHAIN) + f"""
SELECT tx_id, CAST({Q.U('tx_id', 'val42')} < 0.15 AS INTEGER) AS is_val FROM split
WHERE is_train = 1 AND is_fraud = 0""")
def q_ae_validation(spark, sf):
    """M8: the keyed validation rows of the autoencoder."""
    train = P.split(spark, sf, columns=["is_fraud"]).where("is_train = 1")
    return pr.normal_only(train).select("tx_id", (keyed_uniform("tx_id", "val42") < 0.15).cast("int").alias("is_val"))


@register("pca_recon_scores")
def q_pca(spark, sf):
    M = _models()
    test = M.test_rows(spark, sf)
    return (M.fitted(spark, sf, "pca_p95").score(test)
            .unionByName(M.fitted(spark, sf, "pca_p99").score(test)))


@register("autoencoder_scores")
def q_ae(spark, sf):
    M = _models()
    return M.fitted(spark, sf, "autoencoder").score(M.test_rows(spark, sf))


@register("latent_representation")
def q_latent(spark, sf):
    M = _models()
    return M.fitted(spark, sf, "autoencoder").latent(M.test_rows(spark, sf))


@register("discriminator_scores")
def q_disc(spark, sf):
    M = _models()
    return M.fitted(spark, sf, "discriminator").score(M.test_rows(spark, sf))


def _all_scores(spark, sf):
    from txsentinel.plans.training import score_all
    M = _models()
    return score_all(M.fitted_all(spark, sf), M.test_rows(spark, sf))


@register("model_scores")
def q_model_scores(spark, sf):
    return _all_scores(spark, sf)


_MODELS = ["gbt", "isolation_forest", "pca_p95", "pca_p99", "autoencoder", "discriminator"]


@register("scored_rows", Q.chain(*Q.SPLIT_CHAIN) + f""",
m AS (SELECT unnest({_MODELS}) AS model)
SELECT tx_id, model, CAST(is_fraud AS INTEGER) AS label, 1 AS n FROM split, m WHERE is_train = 0""")
def q_scored_rows(spark, sf):
    """M10 accounting: one score per test row and model, with the row's label."""
    return _all_scores(spark, sf).where("score IS NOT NULL").groupBy("tx_id", "model", "label").agg(
        F.count(F.lit(1)).cast("int").alias("n"))


@register("model_tournament")
def q_model_tournament(spark, sf):
    return ev.tournament(_all_scores(spark, sf))


@register("model_thresholds")
def q_model_thresholds(spark, sf):
    return ev.compare_thresholds(ev.optimal_threshold(ev.cumulative_counts(_all_scores(spark, sf))))


@register("batch_predictions")
def q_batch_predictions(spark, sf):
    """M11 + S13: save every detector, load them back, score JSON records."""
    from txsentinel.plans.scoring import load_detectors, score_json_records
    M = _models()
    base = checkpoint_dir(spark).rstrip("/") + f"/models-{uuid.uuid4().hex}"
    for n, det in M.fitted_all(spark, sf).items():
        det.save(f"{base}/{n}")
    dets = load_detectors(spark, base)
    return score_json_records(js.features_to_json(M.test_rows(spark, sf), clean=True), dets)


# ------------------------------------------------------------ streaming ---
def _replayed(spark, rows: DataFrame, name: str, initial: DataFrame | None = None) -> DataFrame:
    """T2 over a file stream that replays ``rows`` in (timestamp, tx_id) order."""
    from txsentinel.streaming.scoring_stream import files_per_trigger, run_to_table, write_stream_input
    from txsentinel.streaming.velocity_state import online_velocity
    path = write_stream_input(rows, name, ("timestamp", "tx_id"))
    stream = (spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_per_trigger(spark, path))
              .parquet(path))
    out = run_to_table(online_velocity(stream, initial=initial), name)
    return out.select("tx_id", "customer_id", "tx_frequency_1h", "tx_frequency_24h", "is_late")


@register("online_velocity", Q.chain(*Q.FEAT_CHAIN) + Q.select(
    ["tx_id", "customer_id", "tx_frequency_1h", "tx_frequency_24h", "0 AS is_late"], [], "feat"))
def q_online_velocity(spark, sf):
    """The velocity features from a file stream replayed in time order."""
    return _replayed(spark, P.labelled(spark, sf), "tx")


_HOLES_SQL = """holes AS (SELECT tx_id, CASE WHEN tx_id % 7 = 2 THEN NULL ELSE customer_id END AS customer_id,
  CASE WHEN tx_id % 10 = 3 THEN NULL ELSE "timestamp" END AS ts FROM labelled),
holes_gap AS (SELECT *, CASE WHEN customer_id IS NOT NULL THEN
    coalesce(CAST(date_diff('microsecond', lag(ts) OVER h, ts) AS DOUBLE) / 1000000.0, 9999.0) END AS gap
  FROM holes WINDOW h AS (PARTITION BY customer_id ORDER BY ts NULLS LAST, tx_id)),
holes_out AS (SELECT tx_id, customer_id, CASE WHEN customer_id IS NOT NULL THEN
    CAST(sum(CASE WHEN gap < 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY customer_id ORDER BY ts NULLS LAST, tx_id
         ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS BIGINT) END AS tx_frequency_1h,
  CASE WHEN customer_id IS NOT NULL THEN
    CAST(sum(CASE WHEN gap < 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY customer_id ORDER BY ts NULLS LAST, tx_id
         ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS BIGINT) END AS tx_frequency_24h FROM holes_gap)
"""


def _holes(spark, sf) -> DataFrame:
    """Labelled rows where a seventh of the customers and a tenth of the times are missing."""
    lab = P.labelled(spark, sf).select("tx_id", "customer_id", "timestamp")
    return lab.select("tx_id", F.when(F.expr("tx_id % 7 <> 2"), F.col("customer_id")).alias("customer_id"),
                      F.when(F.expr("tx_id % 10 <> 3"), F.col("timestamp")).alias("timestamp"))


@register("velocity_null_keys", Q.chain(*Q.BASE) + ",\n" + _HOLES_SQL
          + "SELECT tx_id, customer_id, tx_frequency_1h, tx_frequency_24h FROM holes_out")
def q_velocity_null_keys(spark, sf):
    """W1/W2 with missing customers (no features) and missing times (last), customers split over tasks."""
    return fe.add_velocity_features(_holes(spark, sf), strategy="ranged").select(
        "tx_id", "customer_id", "tx_frequency_1h", "tx_frequency_24h")


@register("online_velocity_null_ts", Q.chain(*Q.BASE) + ",\n" + _HOLES_SQL
          + "SELECT tx_id, customer_id, tx_frequency_1h, tx_frequency_24h, 0 AS is_late FROM holes_out")
def q_online_velocity_null_ts(spark, sf):
    """T2 with missing customers and times: the stream equals the batch there too."""
    return _replayed(spark, _holes(spark, sf), "holes")


@register("online_velocity_from_batch", Q.chain(*Q.SPLIT_CHAIN) + Q.select(
    ["tx_id", "customer_id", "tx_frequency_1h", "tx_frequency_24h", "0 AS is_late"], [], "split", "is_train = 0"))
def q_online_velocity_from_batch(spark, sf):
    """T2 that starts from the states of the training period and streams the test period."""
    from txsentinel.streaming.velocity_state import initial_states
    rows = P.split(spark, sf, columns=["customer_id"]).select("tx_id", "customer_id", "timestamp", "is_train")
    history, new = rows.where("is_train = 1").drop("is_train"), rows.where("is_train = 0").drop("is_train")
    return _replayed(spark, new, "resumed", initial_states(history))


@register("stream_scores", Q.chain(*Q.SCORE_CHAIN) + Q.select(
    ["tx_id", "model", "label", "prediction"], ["score"], "scores"))
def q_stream_scores(spark, sf):
    """JSON feature records of the test split streamed through parsing
    and the rule detectors; equals the batch rule scores."""
    from txsentinel.operators.detectors.rule import default_rule_detectors
    from txsentinel.streaming.scoring_stream import (
        files_per_trigger, json_record_stream, run_to_table, score_stream, write_stream_input,
    )
    test = P.split(spark, sf).where(F.col("is_train") == 0)
    path = write_stream_input(js.features_to_json(test, clean=True), "records", "tx_id")
    scored = score_stream(json_record_stream(spark, path, files_per_trigger(spark, path)), default_rule_detectors())
    out = run_to_table(scored.drop("label"), "stream_scores")
    labels = test.select("tx_id", F.col("is_fraud").alias("label"))
    return scs.align_scores(out, labels)


@register("stream_responses", Q.chain(*Q.FEAT_CHAIN) + _GAPPY + ",\nchecked AS (SELECT *, "
          + " AND ".join(f"{c} IS NOT NULL" for c in FEATURES) + " AS ok FROM gappy)\n"
          + "SELECT tx_id, CASE WHEN ok THEN 'analysed' ELSE 'rejected' END AS status, "
          + "CASE WHEN NOT ok THEN 'missing ' || concat_ws(',', "
          + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in FEATURES)
          + f") END AS reason, {_RULE_JSON} FROM checked")
def q_stream_responses(spark, sf):
    """An answer for every streamed record, through the sink for scores and the one for rejects."""
    from txsentinel.operators.detectors.rule import default_rule_detectors
    from txsentinel.streaming.scoring_stream import (
        ResponseSink, files_per_trigger, json_record_stream, write_stream_input,
    )
    path = write_stream_input(js.features_to_json(_gappy(spark, sf)), "requests", "tx_id")
    base = checkpoint_dir(spark).rstrip("/") + f"/responses-{uuid.uuid4().hex}"
    sink = ResponseSink(spark, base, default_rule_detectors())
    query = sink.start(json_record_stream(spark, path, files_per_trigger(spark, path)))
    query.awaitTermination()
    return sink.responses().select("tx_id", "status", "reason", *[
        c for m, _, _ in DEFAULT_RULES for c in (
            F.col(f"{m}.score").alias(f"{m}_score"), F.col(f"{m}.is_fraud").cast("int").alias(f"{m}_fraud"))])


# ------------------------------------------------ reference-compatible options ---
@register("temporal_split_customer_order", Q.chain(*Q.FEAT_CHAIN) + """,
sp AS (SELECT tx_id, row_number() OVER (ORDER BY customer_id, "timestamp", tx_id) - 1 AS pos,
              count(*) OVER () AS n_rows FROM feat)
SELECT tx_id, CASE WHEN pos < floor(n_rows * 0.8) THEN 1 ELSE 0 END AS is_train,
       CAST(n_rows AS BIGINT) AS n_rows FROM sp""")
def q_split_customer_order(spark, sf):
    """W5 with order_by=(customer, timestamp): the positional cut of a table
    sorted by customer first, i.e. a split by customer (reproduces the
    original pipeline's behaviour)."""
    from txsentinel.session import materialize
    feats = materialize(P.engineered(spark, sf), "engineered")
    return ordered.positional_split_by_cut(
        feats, ["customer_id", "timestamp", "tx_id"]).select("tx_id", "is_train", "n_rows")


_FEAT_FIT_ON_TRAIN = Q.FEAT.replace(
    "FROM labelled WHERE customer_id IS NOT NULL GROUP BY customer_id",
    "FROM lab_train WHERE customer_id IS NOT NULL GROUP BY customer_id")
_LAB_TRAIN = """lab_train AS (
  SELECT * FROM (SELECT *, row_number() OVER (ORDER BY "timestamp", tx_id) - 1 AS pos,
                        count(*) OVER () AS n_rows FROM labelled)
  WHERE pos < floor(n_rows * 0.8))"""


@register("engineer_features_fit_on_train", Q.chain(*Q.BASE, _LAB_TRAIN, _FEAT_FIT_ON_TRAIN)
          + Q.select(FEAT_ALL_OTHERS, FEAT_ALL_DOUBLES, "feat"))
def q_engineer_fit_on_train(spark, sf):
    """E7 with customer statistics fitted on the training period only (the
    leak-free variant): stats from the first 80 % of rows in time order,
    joined to every row."""
    from txsentinel.session import materialize
    lab = materialize(P.labelled(spark, sf), "labelled")
    train = ordered.positional_split_by_cut(lab, list(P.SPLIT_ORDER)).where(F.col("is_train") == 1)
    return fe.engineer_features(lab, stats=fe.customer_stats(train))

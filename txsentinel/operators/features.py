"""Per-customer behavioural features.

Plan shape of ``engineer_features`` on a parquet source: one scan for the
statistics and one for the rows they are joined to; the customer statistics are one partial aggregation plus the exact median from
``exact_quantiles``; the statistics join is left to AQE (broadcast when the
runtime size is under the threshold, sort-merge with skew splitting
otherwise); the two velocity features share one Exchange + Sort on the
customer (three Window nodes); everything else is a projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txsentinel.functions.scalars import (
    amount_deviation, amount_to_median_ratio, amount_zscore, cyclical,
)
from txsentinel.operators import ordered
from txsentinel.schema import (
    FEATURES, FIRST_GAP_SECONDS, VELOCITY_1H_ROWS, VELOCITY_1H_SECONDS,
    VELOCITY_24H_ROWS, VELOCITY_24H_SECONDS,
)


def customer_stats(tx: DataFrame, amount: str = "transaction_amount",
                   key: str = "customer_id", median: str = "exact",
                   num_partitions: int | None = None, method: str = "builtin") -> DataFrame:
    """A1: per customer mean, sample std (single row -> 1.0) and median.

    median='exact' (default) is exact; ``method`` picks the plan (see
    ordered.exact_quantiles): 'ranged' ranks (customer, amount) counts over
    range partitions so a customer with a third of all rows is split across
    tasks.
    'builtin' (default) is Spark's one-aggregation percentile, whose state per customer is a
    count per distinct amount.
    median='approx' uses percentile_approx (a mergeable sketch) instead.
    Rows with a NULL key are left out (as pandas groupby does).
    """
    keyed = tx.where(F.col(key).isNotNull())
    moments = [F.avg(amount).alias("cust_mean"),
               F.coalesce(F.stddev_samp(amount), F.lit(1.0)).alias("cust_std")]
    if median == "approx":
        return keyed.groupBy(key).agg(*moments, F.percentile_approx(
            amount, 0.5, 10000).cast("double").alias("cust_median"))
    if method == "builtin":  # one aggregation, one shuffle
        return keyed.groupBy(key).agg(*moments, F.percentile(
            F.col(amount).cast("double"), 0.5).alias("cust_median"))
    med = ordered.exact_quantiles(keyed, amount, {"cust_median": 0.5}, [key],
                                  num_partitions=num_partitions, method="ranged")
    return keyed.groupBy(key).agg(*moments).join(med, key, "left")


def join_customer_stats(tx: DataFrame, stats: DataFrame, key: str = "customer_id") -> DataFrame:
    """Left equi-join; a NULL key finds no match (pandas merge semantics)."""
    return tx.join(stats, key, "left")


def add_amount_features(df: DataFrame, drop_stats: bool = True) -> DataFrame:
    """E1-E3 from the joined statistics."""
    out = df.select(
        "*",
        amount_deviation().alias("amount_deviation"),
        amount_zscore().alias("amount_zscore"),
        amount_to_median_ratio().alias("amount_to_median_ratio"),
    )
    return out.drop("cust_mean", "cust_std", "cust_median") if drop_stats else out


def _row_order(ts: str, tie: str, descending: bool = False) -> list:
    """(time, tx_id); a missing time comes last, as in a sorted pandas frame."""
    if descending:
        return [F.col(ts).desc_nulls_first(), F.col(tie).desc()]
    return [F.col(ts).asc_nulls_last(), F.col(tie).asc()]


def _customer_groups(key: str, tie: str) -> list:
    """Window groups: a customer's rows together, a row without a customer on its own.

    Such rows have no history (see ``only_customers``), so they need not meet in one task."""
    return [F.col(key), F.when(F.col(key).isNull(), F.col(tie))]


def velocity_window(key: str = "customer_id", ts: str = "timestamp", tie: str = "tx_id"):
    return Window.partitionBy(*_customer_groups(key, tie)).orderBy(*_row_order(ts, tie))


def only_customers(value, key: str = "customer_id"):
    """``value`` where the row has a customer, else NULL (pandas groups leave missing keys out)."""
    return F.when(F.col(key).isNotNull(), value)


def tx_gap_seconds(df: DataFrame, key: str = "customer_id", ts: str = "timestamp",
                   tie: str = "tx_id", strategy: str = "window") -> DataFrame:
    """Seconds since the customer's previous transaction; first -> 9999, no customer -> NULL."""
    out = add_velocity_features(df, key, ts, tie, keep_gap=True, strategy=strategy)
    return out.drop("tx_frequency_1h", "tx_frequency_24h")


def _velocity_columns(df: DataFrame, w, key: str, ts: str) -> DataFrame:
    """gap, 1h and 24h row-window sums over window spec ``w`` (ordered).

    A gap is 9999 where one of its two times is missing."""
    prev = F.lag(F.col(ts)).over(w)
    gap = F.timestamp_diff("MICROSECOND", prev, F.col(ts)).cast("double") / F.lit(1e6)
    with_gap = df.withColumn("gap_seconds", only_customers(F.coalesce(gap, F.lit(FIRST_GAP_SECONDS)), key))
    g = F.col("gap_seconds")
    f1 = only_customers(F.when(g < VELOCITY_1H_SECONDS, F.lit(1)).otherwise(F.lit(0)), key)
    f24 = only_customers(F.when(g < VELOCITY_24H_SECONDS, F.lit(1)).otherwise(F.lit(0)), key)
    return with_gap.select(
        "*",
        F.sum(f1).over(w.rowsBetween(-(VELOCITY_1H_ROWS - 1), 0)).alias("tx_frequency_1h"),
        F.sum(f24).over(w.rowsBetween(-(VELOCITY_24H_ROWS - 1), 0)).alias("tx_frequency_24h"),
    )


def add_velocity_features(df: DataFrame, key: str = "customer_id", ts: str = "timestamp",
                          tie: str = "tx_id", keep_gap: bool = False,
                          strategy: str = "window", num_partitions: int | None = None) -> DataFrame:
    """W2 (and W3 fallback when there is no timestamp column).

    tx_frequency_1h  = number of gaps < 3600 s among the last 5 rows,
    tx_frequency_24h = number of gaps < 86400 s among the last 20 rows
    (row windows, not time ranges), ordered by (timestamp, tx_id); rows without a time come last
    and have a gap of 9999, rows without a customer have NULL frequencies.

    strategy='window' (default): one Window partitioned by customer (one Exchange +
    Sort; a customer's rows all go to one task).
    strategy='ranged': skew-safe, see ``velocity_ranged``.
    """
    if ts not in df.columns:
        return velocity_fallback(df, key, tie, num_partitions=num_partitions)
    if strategy == "ranged":
        out = velocity_ranged(df, key, ts, tie, num_partitions)
    else:
        out = _velocity_columns(df, velocity_window(key, ts, tie), key, ts)
    return out if keep_gap else out.drop("gap_seconds")


def velocity_ranged(df: DataFrame, key: str = "customer_id", ts: str = "timestamp",
                    tie: str = "tx_id", num_partitions: int | None = None) -> DataFrame:
    """Velocity features without putting any customer into a single task
    (see ``ranged_rows_window``; the windows look back 20 rows)."""
    lookback = max(VELOCITY_1H_ROWS, VELOCITY_24H_ROWS)
    return ranged_rows_window(df, lambda d, w: _velocity_columns(d, w, key, ts), lookback,
                              ["gap_seconds", "tx_frequency_1h", "tx_frequency_24h"],
                              key, ts, tie, num_partitions)


def ranged_rows_window(df: DataFrame, compute, lookback: int, out_cols: list[str],
                       key: str = "customer_id", ts: str = "timestamp", tie: str = "tx_id",
                       num_partitions: int | None = None) -> DataFrame:
    """Per-customer row-window features whose frames look back at most
    ``lookback`` rows, computed without putting any customer into one task.

    ``compute(frame, window_spec)`` adds ``out_cols`` using the given ordered
    window spec (partitioned by customer, ordered by (ts, tie)).

    1. range-partition on (customer, ts, tie): a customer with a third of all
       rows is spread over many partitions; compute per (partition, customer)
       and materialize (fixes the partition ids);
    2. only a customer continuing across a partition boundary can be wrong,
       and only in its first ``lookback`` rows after the boundary;
       per-partition first/last customers and boundary segment sizes
       (O(partitions) rows) locate them.  Rows without a customer sort behind
       all others and stand alone;
    3. recompute just those rows with the ``lookback`` rows before the
       boundary and patch them in through a broadcast join bounded by
       lookback * partitions rows.
    """
    from txsentinel.operators.ordered import PID
    from txsentinel.session import materialize, shuffle_partitions

    spark = df.sparkSession
    n = num_partitions or shuffle_partitions(spark)
    L = max(1, int(lookback))
    gk = "_gkey"
    kind = df.schema[key].dataType.simpleString()
    base = df.withColumn(gk, F.col(key))
    ranged = base.repartitionByRange(n, F.col(gk).asc_nulls_last(), *_row_order(ts, tie)).withColumn(
        PID, F.spark_partition_id())
    groups = [F.col(PID), *_customer_groups(gk, tie)]
    w = Window.partitionBy(*groups).orderBy(*_row_order(ts, tie))
    wd = Window.partitionBy(*groups).orderBy(*_row_order(ts, tie, descending=True))
    pass1 = compute(ranged, w).select(
        "*", F.row_number().over(w).alias("_rn"), F.row_number().over(wd).alias("_rnd"))
    pass1 = materialize(pass1, "rows_window")

    # Per partition: first/last customer (one row per partition).
    info = {r[PID]: r for r in pass1.groupBy(PID).agg(
        F.min(gk).alias("first"), F.max(gk).alias("last")).collect()}
    pids = sorted(info)
    edge_pairs = {(p, info[p][end]) for p in pids for end in ("first", "last") if info[p][end] is not None}
    edges_df = spark.createDataFrame(sorted(edge_pairs), f"{PID} int, {gk} {kind}")
    seg = {(r[PID], r[gk]): r["cnt"] for r in pass1.join(F.broadcast(edges_df), [PID, gk])
           .groupBy(PID, gk).agg(F.count(F.lit(1)).alias("cnt")).collect()}

    heads, tails = [], []  # (pid, customer, rn_limit) / (src pid, customer, rnd_limit, target)
    for i, p in enumerate(pids):
        c = info[p]["first"]
        if i == 0 or c is None or info[pids[i - 1]]["last"] != c:
            continue  # customer starts in p: its windows are complete
        heads.append((p, c, L))
        need = L
        for q in reversed(pids[:i]):
            if need <= 0 or info[q]["last"] != c:
                break
            take = min(need, seg[(q, c)])
            tails.append((q, c, take, p))
            need -= take
            if info[q]["first"] != c:
                break
    if not heads:
        return pass1.select(*df.columns, *out_cols)

    heads_df = spark.createDataFrame(heads, f"{PID} int, {gk} {kind}, _lim long")
    tails_df = spark.createDataFrame(tails, f"{PID} int, {gk} {kind}, _lim long, _target int")
    raw_cols = list(df.columns) + [gk]
    head_rows = (pass1.join(F.broadcast(heads_df), [PID, gk])
                 .where(F.col("_rn") <= F.col("_lim"))
                 .select(*raw_cols, PID, "_rn", F.lit(0).alias("_halo")))
    tail_rows = (pass1.join(F.broadcast(tails_df), [PID, gk])
                 .where(F.col("_rnd") <= F.col("_lim"))
                 .select(*raw_cols, F.col("_target").alias(PID),
                         F.lit(None).cast("int").alias("_rn"), F.lit(1).alias("_halo")))
    fixed = (compute(head_rows.unionByName(tail_rows), w)
             .where(F.col("_halo") == 0)
             .select(PID, gk, "_rn", *[F.col(c).alias(f"_fix_{c}") for c in out_cols]))
    # bounded: at most `lookback` rows per partition boundary
    out = pass1.join(F.broadcast(fixed), [PID, gk, "_rn"], "left")
    return out.select(*[F.col(c) for c in df.columns],
                      *[F.coalesce(F.col(f"_fix_{c}"), F.col(c)).alias(c) for c in out_cols])


def velocity_fallback(df: DataFrame, key: str = "customer_id", order: str = "tx_id",
                      num_partitions: int | None = None) -> DataFrame:
    """(row_number - 1) % 5 and % 20 per customer in input (tx_id) order.

    The per-customer row number is a grouped running count over range
    partitions (ordered.running_totals), so a hot customer is split.  Rows
    without a customer have NULL, as in pandas.
    """
    rn = ordered.running_totals(df, [order], {"_rn": F.lit(1).cast("long")}, [key],
                                num_partitions=num_partitions)
    r = F.col("_rn") - 1
    return rn.select(*df.columns, *[only_customers((r % rows).cast("long"), key).alias(name) for rows, name in (
        (VELOCITY_1H_ROWS, "tx_frequency_1h"), (VELOCITY_24H_ROWS, "tx_frequency_24h"))])


def add_cyclical_features(df: DataFrame) -> DataFrame:
    """sin/cos of hour (period 24) and weekday (period 7)."""
    hs, hc = cyclical("hour_of_day", 24)
    ds, dc = cyclical("day_of_week", 7)
    return df.select("*", hs.alias("hour_sin"), hc.alias("hour_cos"),
                     ds.alias("day_sin"), dc.alias("day_cos"))


def add_interaction_features(df: DataFrame) -> DataFrame:
    """Amount x distance, amount x international, zscore x 1h frequency."""
    return df.select(
        "*",
        (F.col("transaction_amount") * F.col("distance_from_home")).alias("amount_x_distance"),
        (F.col("transaction_amount") * F.col("is_international")).alias("amount_x_international"),
        (F.col("amount_zscore") * F.col("tx_frequency_1h")).alias("zscore_x_frequency"),
    )


def engineer_features(tx: DataFrame, stats: DataFrame | None = None,
                      median: str = "exact", num_partitions: int | None = None,
                      strategy: str = "window") -> DataFrame:
    """All 18 features in one lazy plan.

    ``stats`` defaults to statistics over the whole input (the reference's
    behaviour); pass ``customer_stats(train_rows)`` for a leak-free variant.
    """
    if stats is None:
        stats = customer_stats(tx, median=median, num_partitions=num_partitions,
                               method="ranged" if strategy == "ranged" else "builtin")
    df = join_customer_stats(tx, stats)
    df = add_amount_features(df)
    df = add_velocity_features(df, strategy=strategy, num_partitions=num_partitions)
    df = add_cyclical_features(df)
    return add_interaction_features(df)


def sequence_features(df: DataFrame, length: int = 1, key: str = "customer_id",
                      ts: str = "timestamp", tie: str = "tx_id",
                      features: list[str] | None = None, strategy: str = "window",
                      num_partitions: int | None = None) -> DataFrame:
    """Array of the customer's last ``length`` feature vectors, left-padded with 0.

    Output column ``sequence`` is array<array<double>> ordered oldest first;
    length=1 reproduces the per-row sequences of the reference.  A row without
    a customer has no history.  The lag
    window looks back length-1 rows, so a hot customer goes through
    ``ranged_rows_window`` with strategy='ranged'.
    """
    features = features or FEATURES

    def compute(frame: DataFrame, w) -> DataFrame:
        vec = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
        zero = F.array(*[F.lit(0.0) for _ in features])
        steps = [F.coalesce(F.lag(vec, lag).over(w), zero) for lag in range(length - 1, 0, -1)]
        return frame.withColumn("sequence", F.array(*steps, vec))

    if strategy == "ranged" and length > 1:
        return ranged_rows_window(df, compute, length - 1, ["sequence"], key, ts, tie,
                                  num_partitions)
    return compute(df, velocity_window(key, ts, tie))

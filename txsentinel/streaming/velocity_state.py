"""Online velocity features with per-customer state.

``groupBy(group).transformWithStateInPandas`` keeps, per customer, one typed map
value of fixed size: the last transaction's time and tx_id, the number of rows
without a time, and the last 19 gaps in seconds.  It is read and written once per
customer and micro-batch, and a hot customer costs the same state as any other.
A group holds the customers of one hash value, as a call of the processor (frames
in and out) costs far more than a customer's own work; with expiry, which needs
timers of its own, every customer is a group.

* Rows of a micro-batch are taken in (timestamp, tx_id) order, so on in-order
  input the stream reproduces the batch features exactly.
* A row without a time belongs behind all rows with one (as in the batch).  It
  never becomes the customer's last transaction, so rows with a time that come
  later are unaffected.
* A row older than the state's last transaction cannot be placed in the row
  windows any more; it is emitted with ``is_late = 1`` and features computed
  against the current state (the batch job remains the reference for it).
* A row without a customer has NULL features and no state; such rows are dealt
  over many groups.
* The state may start from a batch table (``initial_states``), and an event-time
  timer may drop the state of customers that stay away.

A micro-batch of one group is read chunk by chunk into three numeric arrays (24
bytes a row) and written in chunks; pandas frames of the whole are never built.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from txsentinel.operators.features import _velocity_columns, velocity_window
from txsentinel.schema import (
    FIRST_GAP_SECONDS, VELOCITY_1H_ROWS, VELOCITY_1H_SECONDS, VELOCITY_24H_ROWS,
    VELOCITY_24H_SECONDS,
)

# Spark also loads the processor in a Python process beside the driver that knows no shipped packages,
# so this module's functions and classes travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HISTORY = VELOCITY_24H_ROWS - 1
WINDOWS = ((VELOCITY_1H_ROWS, VELOCITY_1H_SECONDS), (VELOCITY_24H_ROWS, VELOCITY_24H_SECONDS))
#: Rows of one output frame.
CHUNK = 10_000
#: Groups over which the customers are dealt.
CUSTOMER_GROUPS = 256
#: Groups over which rows without a customer are dealt.
NOBODY_GROUPS = 1024
#: Micros of a missing time (numpy's NaT); sorts behind every time after ``_ordered``.
MISSING = np.iinfo(np.int64).min

OUTPUT_SCHEMA = T.StructType([
    T.StructField("tx_id", T.LongType()),
    T.StructField("customer_id", T.LongType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("tx_frequency_1h", T.LongType()),
    T.StructField("tx_frequency_24h", T.LongType()),
    T.StructField("is_late", T.IntegerType()),
])

CUSTOMER_SCHEMA = T.StructType([T.StructField("customer", T.LongType())])
STATE_SCHEMA = T.StructType([
    T.StructField("last_ts_us", T.LongType()),
    T.StructField("last_tx_id", T.LongType()),
    T.StructField("undated", T.LongType()),
    T.StructField("gaps", T.ArrayType(T.DoubleType())),
])
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ordered(chunks: Iterator[pd.DataFrame]) -> list[np.ndarray]:
    """(customer, micros, tx_id) of all rows by customer, time, then tx_id; rows without a time last."""
    parts = [[np.zeros(0, np.int64)] for _ in range(3)]
    for pdf in chunks:
        for part, c in zip(parts, ("member", "ts_us", "tx_id")):
            part.append(pdf[c].to_numpy(dtype=np.int64))
    who, ts, tx = (np.concatenate(part) for part in parts)
    order = np.lexsort((tx, ts, ts == MISSING, who))
    return [who[order], ts[order], tx[order]]


def _window_sums(gaps: np.ndarray, known: int) -> list[np.ndarray]:
    """Per window: sums of small gaps over its rows, for the rows behind the first ``known`` gaps."""
    ends = np.arange(known + 1, len(gaps) + 1)
    out = []
    for rows, limit in WINDOWS:
        sums = np.concatenate([[0], np.cumsum(gaps < limit)])
        out.append(sums[ends] - sums[np.maximum(ends - rows, 0)])
    return out


def advance(last: tuple | None, gaps: list[float], ts: np.ndarray, ids: np.ndarray
            ) -> tuple[tuple, list[float], np.ndarray, np.ndarray, np.ndarray]:
    """(last, gaps) after the ordered rows, and their 1h sums, 24h sums and late flags."""
    last_us, last_id, undated = last if last is not None else (None, None, 0)
    dated = ts != MISSING
    late = np.zeros(len(ts), bool)
    if last_us is not None:
        late = dated & ((ts < last_us) | ((ts == last_us) & (ids < last_id)))
    sums = [np.zeros(len(ts), np.int64), np.zeros(len(ts), np.int64)]
    known = np.asarray(gaps, float)
    # late rows: each against the state as it is
    away = (ts[late] - (last_us or 0)) / 1e6
    for out, (rows, limit) in zip(sums, WINDOWS):
        out[late] = (known[max(0, len(known) - (rows - 1)):] < limit).sum() + (away < limit)
    # rows in order: stored gaps and new ones in one sequence
    now = ts[dated & ~late]
    if len(now):
        before = np.concatenate([[last_us if last_us is not None else now[0]], now[:-1]])
        new = (now - before) / 1e6
        if last_us is None:
            new[0] = FIRST_GAP_SECONDS
        sequence = np.concatenate([known, new])
        for out, values in zip(sums, _window_sums(sequence, len(known))):
            out[dated & ~late] = values
        known = sequence[-HISTORY:]
        last_us, last_id = int(now[-1]), int(ids[dated & ~late][-1])
    # rows without a time follow everything known, earlier ones of their kind between
    missing = int((~dated).sum())
    if missing:
        waiting = min(int(undated), HISTORY)
        sequence = np.concatenate([known, np.full(waiting + missing, FIRST_GAP_SECONDS)])
        for out, values in zip(sums, _window_sums(sequence, len(known) + waiting)):
            out[~dated] = values
    return (last_us, last_id, int(undated) + missing), known.tolist(), sums[0], sums[1], late


class VelocityProcessor(StatefulProcessor):
    """``expire_ms``: event time after a customer's last transaction at which its state goes (0: never)."""

    def __init__(self, expire_ms: int = 0):
        self.expire_ms = expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = handle.getMapState("states", CUSTOMER_SCHEMA, STATE_SCHEMA)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState["members"].iloc[0]:
            last_us, last_id = row["last_ts_us"], row["last_tx_id"]
            last = (None if pd.isna(last_us) else int(last_us), None if pd.isna(last_id) else int(last_id),
                    int(row["undated"]))
            self.states.updateValue((int(row["member"]),), (*last, [float(g) for g in row["gaps"]]))
            self._watch(None, last[0])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        who, ts, ids = _ordered(rows)
        f1h, f24h, late = np.zeros(len(ts), np.int64), np.zeros(len(ts), np.int64), np.zeros(len(ts), bool)
        if int(key[1]):
            yield from _frames(None, ts, ids, f1h, f24h, late)
            return
        first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
        for a, b in zip(first.tolist(), np.append(first[1:], len(who)).tolist()):
            customer = (int(who[a]),)
            known = self.states.getValue(customer)
            last, gaps = (tuple(known[:3]), list(known[3])) if known is not None else (None, [])
            now, gaps, f1h[a:b], f24h[a:b], late[a:b] = advance(last, gaps, ts[a:b], ids[a:b])
            self.states.updateValue(customer, (*now, gaps))
            self._watch(last[0] if last is not None else None, now[0])
        yield from _frames(who, ts, ids, f1h, f24h, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.states.clear()      # timers are set where a group is one customer
        return iter([])

    def close(self) -> None:
        pass

    def _watch(self, before: int | None, now: int | None) -> None:
        """Move the customer's timer behind its last transaction."""
        if not self.expire_ms or now is None or now == before:
            return
        if before is not None:
            self.handle.deleteTimer(before // 1000 + self.expire_ms)
        self.handle.registerTimer(int(now) // 1000 + self.expire_ms)


def _frames(who, ts, ids, f1h, f24h, late) -> Iterator[pd.DataFrame]:
    for a in range(0, len(ts), CHUNK):
        b = min(a + CHUNK, len(ts))
        nobody = [None] * (b - a)
        yield pd.DataFrame({
            "tx_id": ids[a:b],
            "customer_id": pd.array(nobody if who is None else who[a:b], dtype="Int64"),
            "timestamp": ts[a:b].astype("datetime64[us]"),
            "tx_frequency_1h": pd.array(nobody if who is None else f1h[a:b], dtype="Int64"),
            "tx_frequency_24h": pd.array(nobody if who is None else f24h[a:b], dtype="Int64"),
            "is_late": late[a:b].astype(np.int32),
        })


def initial_states(history: DataFrame) -> DataFrame:
    """Per customer of a batch table: the state a stream would hold after those rows."""
    w = velocity_window()
    gaps = _velocity_columns(history.select("tx_id", "customer_id", "timestamp")
                             .where("customer_id IS NOT NULL"), w, "customer_id", "timestamp")
    dated = gaps.where("timestamp IS NOT NULL")
    back = Window.partitionBy("customer_id").orderBy(F.col("timestamp").desc(), F.col("tx_id").desc())
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    recent = dated.withColumn("back", F.row_number().over(back)).where(F.col("back") <= HISTORY)
    lasts = recent.groupBy("customer_id").agg(
        F.max(F.when(F.col("back") == 1, F.timestamp_diff("MICROSECOND", epoch, F.col("timestamp")))).alias("last_ts_us"),
        F.max(F.when(F.col("back") == 1, F.col("tx_id"))).alias("last_tx_id"),
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), "gap_seconds"))),
                    lambda g: g["gap_seconds"]).alias("gaps"))
    undated = (history.where("customer_id IS NOT NULL AND timestamp IS NULL").groupBy("customer_id")
               .agg(F.count(F.lit(1)).alias("undated")))
    return lasts.join(undated, "customer_id", "full").select(
        "customer_id", "last_ts_us", "last_tx_id",
        F.coalesce("undated", F.lit(0)).cast("long").alias("undated"),
        F.coalesce("gaps", F.array().cast("array<double>")).alias("gaps"))


def _keys(nobody, alone: bool) -> list:
    """Group keys that are never NULL: a group of customers (``alone``: the customer), and slot 0 for
    rows with a customer.  Rows without one take a slot from 1 on, by the number ``nobody``."""
    missing = F.col("customer_id").isNull()
    customer = F.coalesce("customer_id", F.lit(0)).cast("long")
    group = customer if alone else F.when(missing, 0).otherwise(
        F.pmod(F.xxhash64("customer_id"), F.lit(CUSTOMER_GROUPS))).cast("long")
    slot = F.when(missing, F.pmod(nobody, F.lit(NOBODY_GROUPS)) + 1).otherwise(F.lit(0))
    return [group.alias("customers"), slot.cast("long").alias("slot"), customer.alias("member")]


def online_velocity(stream: DataFrame, expire: str | None = None, watermark: str = "1 day",
                    initial: DataFrame | None = None) -> DataFrame:
    """Streaming TX rows -> (tx_id, customer_id, timestamp, 1h/24h features, is_late).

    ``expire`` (e.g. "90 days") drops the state of customers that have had no transaction for that
    much event time; a customer that comes back later starts anew, as with its first transaction.
    Without it the state of every customer is kept, as exact equality with the batch needs.
    ``initial`` (see ``initial_states``) is what the customers' states start from.
    State lives in RocksDB, so it may outgrow memory; the session is set to that provider.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    keys = _keys(F.xxhash64("tx_id"), expire is not None)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    micros = F.coalesce(F.timestamp_diff("MICROSECOND", epoch, F.col("timestamp")), F.lit(int(MISSING)))
    rows = stream.select("tx_id", micros.alias("ts_us"), "timestamp", *keys)
    start = None
    if initial is not None:     # one row per group
        member = F.struct("member", "last_ts_us", "last_tx_id", "undated", "gaps")
        start = (initial.select("*", *_keys(F.lit(0), expire is not None)).groupBy("customers", "slot")
                 .agg(F.collect_list(member).alias("members")).groupBy("customers", "slot"))
    if expire is None:
        return rows.drop("timestamp").groupBy("customers", "slot").transformWithStateInPandas(
            VelocityProcessor(), OUTPUT_SCHEMA, "append", "none", start)
    # watermarks need a zoned timestamp; the values themselves stay zone-free
    timed = rows.withColumn("event", rows["timestamp"].cast("timestamp")).withWatermark("event", watermark)
    expire_ms = int(pd.Timedelta(expire).total_seconds() * 1000)
    return timed.groupBy("customers", "slot").transformWithStateInPandas(
        VelocityProcessor(expire_ms), OUTPUT_SCHEMA, "append", "eventTime", start)

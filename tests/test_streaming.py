"""Stream = batch."""

from tests.conftest import SF_SMALL
from txsentinel.operators.detectors.rule import default_rule_detectors
from txsentinel.operators.features import add_velocity_features
from txsentinel.plans import flow as P
from txsentinel.schema import TX_SCHEMA
from txsentinel.sources import json_records as js
from txsentinel.streaming.scoring_stream import (
    json_record_stream, run_to_table, score_stream, write_stream_input,
)
from txsentinel.streaming.velocity_state import online_velocity


def test_online_velocity_equals_batch(spark):
    lab = P.labelled(spark, SF_SMALL)
    path = write_stream_input(lab, "t", "timestamp", 3)
    stream = spark.readStream.schema(TX_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    out = run_to_table(online_velocity(stream), "t")
    cols = ["tx_id", "tx_frequency_1h", "tx_frequency_24h"]
    batch = add_velocity_features(lab).select(*cols)
    assert out.where("is_late = 1").count() == 0
    assert out.select(*cols).exceptAll(batch).count() == 0
    assert batch.exceptAll(out.select(*cols)).count() == 0


def test_late_row_is_flagged(spark):
    import datetime as dt
    rows = [(2, 1, dt.datetime(2026, 3, 1, 10), 0), (1, 1, dt.datetime(2026, 3, 1, 9), 1)]
    schema = "tx_id long, customer_id long, timestamp timestamp_ntz, arrival int"
    df = spark.createDataFrame(rows, schema)
    base = write_stream_input(df, "late", "arrival", 2)  # tx 1 (older) arrives second
    stream = spark.readStream.schema(schema) \
        .option("maxFilesPerTrigger", 1).parquet(base)
    out = {r.tx_id: r for r in run_to_table(online_velocity(stream), "late").collect()}
    assert out[2].is_late == 0 and out[1].is_late == 1


def test_stream_scores_equal_batch(spark):
    feats = P.engineered(spark, SF_SMALL)
    dets = default_rule_detectors()
    path = write_stream_input(js.features_to_json(feats), "rec", "tx_id", 3)
    streamed = run_to_table(score_stream(json_record_stream(spark, path), dets).drop("label"), "s")
    batch = None
    for d in dets.values():
        s = d.score(feats).drop("label")
        batch = s if batch is None else batch.unionByName(s)
    cols = ["tx_id", "model", "score", "prediction"]
    assert streamed.select(*cols).exceptAll(batch.select(*cols)).count() == 0
    assert batch.select(*cols).exceptAll(streamed.select(*cols)).count() == 0


def test_stream_scores_with_trained_detectors(spark):
    """T1 with fitted models (pandas UDF and column-expression scorers)."""
    from txsentinel.operators.detectors.iforest import IsolationForestDetector
    from txsentinel.operators.detectors.recon import PCAReconstructionDetector
    feats = P.engineered(spark, SF_SMALL)
    dets = {"isolation_forest": IsolationForestDetector(n_trees=10).fit(feats),
            "pca_p95": PCAReconstructionDetector(name="pca_p95", k=4).fit(feats)}
    path = write_stream_input(js.features_to_json(feats), "rec2", "tx_id", 2)
    streamed = run_to_table(score_stream(json_record_stream(spark, path), dets), "s2")
    cols = ["tx_id", "model", "prediction"]
    batch = None
    for d in dets.values():
        s = d.score(feats)
        batch = s if batch is None else batch.unionByName(s)
    assert streamed.count() == batch.count()
    assert streamed.select(*cols).exceptAll(batch.select(*cols)).count() == 0


def test_online_velocity_null_customer(spark):
    import datetime as dt
    t0 = dt.datetime(2026, 3, 1)
    rows = [(i, None if i < 3 else 9, t0 + dt.timedelta(minutes=10 * i)) for i in range(6)]
    schema = "tx_id long, customer_id long, timestamp timestamp_ntz"
    df = spark.createDataFrame(rows, schema)
    path = write_stream_input(df, "nullkey", "tx_id", 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = {r.tx_id: r for r in run_to_table(online_velocity(stream), "nullkey").collect()}
    batch = {r.tx_id: r for r in add_velocity_features(df).collect()}
    assert out[0].customer_id is None and out[0].tx_frequency_24h is None
    for i in range(6):
        assert out[i].tx_frequency_1h == batch[i].tx_frequency_1h
        assert out[i].tx_frequency_24h == batch[i].tx_frequency_24h


SCHEMA = "tx_id long, customer_id long, timestamp timestamp_ntz"


def holey(spark, n=400):
    """Missing customers and times, the smallest long as a customer, ties, one hot customer."""
    import datetime as dt
    t0 = dt.datetime(2026, 3, 1)
    ids = [None, -2 ** 63, 5, 5, 5, 5, 6]
    rows = [(i, ids[i * i % 7], None if i % 9 == 4 else t0 + dt.timedelta(minutes=7 * (i // 2)))
            for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def velocities(df):
    return sorted(df.select("tx_id", "customer_id", "tx_frequency_1h", "tx_frequency_24h").collect())


def test_window_ranged_and_stream_agree_on_missing_values(spark):
    df = holey(spark)
    window = velocities(add_velocity_features(df))
    assert velocities(add_velocity_features(df, strategy="ranged", num_partitions=16)) == window
    path = write_stream_input(df, "holey", ("timestamp", "tx_id"), 6)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    out = run_to_table(online_velocity(stream), "holey")
    assert velocities(out) == window and out.where("is_late = 1").count() == 0
    none = [r for r in window if r["customer_id"] is None]
    assert none and all(r["tx_frequency_1h"] is None and r["tx_frequency_24h"] is None for r in none)


def test_rows_without_a_time_do_not_touch_the_state():
    import numpy as np
    from txsentinel.streaming import velocity_state as vs
    hour = 3_600_000_000
    last, gaps, *_ = vs.advance(None, [], np.array([0, hour // 2]), np.array([1, 2]))
    after, same, f1h, f24h, late = vs.advance(last, gaps, np.array([vs.MISSING] * 2), np.array([3, 4]))
    assert after == (hour // 2, 2, 2) and same == gaps and not late.any()
    assert f1h.tolist() == [1, 1] and f24h.tolist() == [3, 4]
    _, _, f1h, _, late = vs.advance(after, same, np.array([hour]), np.array([5]))
    assert f1h.tolist() == [2] and not late.any()


def test_stream_goes_on_from_its_checkpoint_and_from_a_batch(spark, tmp_path):
    from pyspark.sql import functions as F
    from txsentinel.streaming.velocity_state import initial_states
    df = holey(spark, 300)
    expected = velocities(add_velocity_features(df))
    parts = [df.where("timestamp < TIMESTAMP_NTZ '2026-03-01 08:00:00'"),
             df.where("timestamp >= TIMESTAMP_NTZ '2026-03-01 08:00:00' OR timestamp IS NULL")]

    def run(name, initial=None):
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / f"in-{name}"))
        query = (online_velocity(stream, initial=initial).writeStream.format("parquet")
                 .option("path", str(tmp_path / f"out-{name}"))
                 .option("checkpointLocation", str(tmp_path / f"chk-{name}")).trigger(availableNow=True).start())
        query.awaitTermination()
        return spark.read.parquet(str(tmp_path / f"out-{name}"))

    for part in parts:          # the second run is a new query that finds the first one's state
        part.write.mode("append").parquet(str(tmp_path / "in-restart"))
        out = run("restart")
    assert velocities(out) == expected
    parts[1].write.parquet(str(tmp_path / "in-batch"))
    resumed = velocities(run("batch", initial_states(parts[0])))
    late = {r["tx_id"] for r in parts[1].select(F.col("tx_id")).collect()}
    assert resumed == [r for r in expected if r["tx_id"] in late]


def test_replayed_batches_add_nothing_and_unfinished_ones_are_not_read(spark, tmp_path):
    from pyspark.sql import functions as F
    from txsentinel.streaming.scoring_stream import ResponseSink
    feats = P.engineered(spark, SF_SMALL)
    broken = feats.withColumn("hour_sin", F.when(F.expr("tx_id % 5 <> 0"), F.col("hour_sin")))
    records = js.features_to_json(broken).unionByName(
        spark.createDataFrame([(10 ** 9, "{not json"), (10 ** 9 + 1, None)], "tx_id long, value string"))
    sink = ResponseSink(spark, str(tmp_path / "sink"), default_rule_detectors())
    sink.write(records, 0)
    sink.write(records, 0)
    answers = sink.responses().collect()
    assert len(answers) == len({r["tx_id"] for r in answers}) == records.count()
    reasons = {r["tx_id"]: r["reason"] for r in answers if r["status"] == "rejected"}
    assert reasons[10 ** 9] == reasons[10 ** 9 + 1] == "corrupt" and reasons[5] == "missing hour_sin"
    assert all((r["zscore_rule"] is None) == (r["status"] == "rejected") for r in answers)
    # a batch that fails between its sinks and its marker is invisible until it is replayed
    half = records.where("tx_id < 20").withColumn("tx_id", F.col("tx_id") + 2 * 10 ** 9)
    announce = sink._path
    sink._path = lambda *a, **k: (_ for _ in ()).throw(OSError("lost")) if k else announce(*a)
    try:
        sink.write(half, 1)
    except OSError:
        pass
    sink._path = announce
    assert sink.announced() == [0] and sink.responses().count() == len(answers)
    sink.write(half, 1)
    assert sink.responses().count() == len(answers) + half.count()


def test_micro_batches_and_state_partitions_do_not_follow_the_files(spark):
    import math
    from txsentinel.streaming.scoring_stream import REPLAY_BATCHES, files_per_trigger, state_partitions
    from txsentinel.plans.registry import QUERIES
    path = write_stream_input(spark.range(400).withColumnRenamed("id", "tx_id"), "many", "tx_id", 30)
    assert math.ceil(30 / files_per_trigger(spark, path)) <= REPLAY_BATCHES
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        assert state_partitions(spark) == spark.sparkContext.defaultParallelism
        out = QUERIES["online_velocity"][0](spark, SF_SMALL)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    chk = out.inputFiles()[0].split("file://")[-1].rsplit("/out/", 1)[0]
    import os
    commits = [f for f in os.listdir(f"{chk}/chk/commits") if f.isdigit()]
    stores = [d for d in os.listdir(f"{chk}/chk/state/0") if d.isdigit()]
    assert 1 < len(commits) <= REPLAY_BATCHES
    assert len(stores) == spark.sparkContext.defaultParallelism
    batch = add_velocity_features(P.labelled(spark, SF_SMALL)).select("tx_id", "tx_frequency_1h", "tx_frequency_24h")
    assert out.select(*batch.columns).exceptAll(batch).count() == 0 and out.count() == batch.count()


def test_responses_come_in_few_micro_batches(spark):
    import re
    from txsentinel.plans.registry import QUERIES
    from txsentinel.streaming.scoring_stream import REPLAY_BATCHES
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        out = QUERIES["stream_responses"][0](spark, SF_SMALL)
        batches = {re.search(r"batch_id=(\d+)", f).group(1) for f in out.inputFiles()}
        assert 1 < len(batches) <= REPLAY_BATCHES
        assert out.count() == out.select("tx_id").distinct().count() == P.labelled(spark, SF_SMALL).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

"""No row is lost: missing times, user files, rejected records, streams, unreadable models."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from txsentinel.operators import ordered
from txsentinel.operators.detectors.rule import RuleDetector, default_rule_detectors
from txsentinel.operators.features import engineer_features
from txsentinel.plans import batch, flow as P
from txsentinel.plans.scoring import load_detectors, score_json_records
from txsentinel.plans.training import score_all, score_wide
from txsentinel.schema import FEATURES
from txsentinel.sources import json_records as js
from txsentinel.sources import transactions as st
from txsentinel.streaming.scoring_stream import run_to_table, write_stream_input
from txsentinel.streaming.velocity_state import online_velocity

ORDER = ["timestamp", "tx_id"]


def gappy(spark, share=0.1, seed=1, n=1000):
    r = random.Random(seed)
    rows = [(i, None if r.random() < share else f"2026-01-{1 + r.randrange(28):02d} 00:00:00") for i in range(n)]
    return spark.createDataFrame(rows, "tx_id long, t string").select(
        "tx_id", F.col("t").cast("timestamp_ntz").alias("timestamp"))


def position(rows):
    order = sorted(rows, key=lambda r: (r["timestamp"] is None, r["timestamp"] or 0, r["tx_id"]))
    return {r["tx_id"]: k for k, r in enumerate(order)}


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 1.0])
def test_split_with_missing_times(spark, share):
    df = gappy(spark, share)
    want = position(df.collect())
    got = {r["tx_id"]: r["is_train"] for r in ordered.positional_split_by_cut(df, ORDER).collect()}
    assert got == {t: int(k < 800) for t, k in want.items()}
    pos = {r["tx_id"]: r["is_train"] for r in ordered.positional_split(df, ORDER).collect()}
    assert pos == got


def test_folds_with_missing_times(spark):
    df = gappy(spark, 0.3)
    want = position(df.collect())
    got = {(r["tx_id"], r["fold"]): r["role"]
           for r in ordered.purged_kfold_by_keys(df, ORDER, 1000, 5, 50, 10).collect()}
    expected = {}
    for t, k in want.items():
        for fold in range(5):
            low, high = fold * 200, (fold + 1) * 200
            if low <= k < high:
                expected[t, fold] = "val"
            elif k < low - 50 or k >= high + 10:
                expected[t, fold] = "train"
    assert got == expected


HEADER = ("customer_id,transaction_amount,hour_of_day,day_of_week,merchant_category,"
          "distance_from_home,is_international,is_fraud,timestamp\n")


def csv(tmp_path, lines):
    path = tmp_path / "tx.csv"
    path.write_text(HEADER + "".join(f"{line}\n" for line in lines))
    return str(path)


def test_user_csv_without_key_runs_to_features(spark, tmp_path):
    lines = [f"{i % 5},{10 + i}.5,{i % 24},{i % 7},{i % 15},3.25,0,{int(i % 20 == 0)},"
             + ("2026-03-02 05:00:%02d" % (i % 60) if i % 2 else "2026-03-02T04:00:%02d" % (i % 60))
             for i in range(100)]
    df = st.load_transactions(spark, csv(tmp_path, lines))
    assert df.select("tx_id").distinct().count() == 100 and df.where("timestamp IS NULL").count() == 0
    feats = batch.preprocess(spark, csv(tmp_path, lines), str(tmp_path / "out"))
    assert feats.count() == 100 and set(FEATURES) <= set(feats.columns)
    no_time = engineer_features(df.drop("timestamp"))
    split = ordered.positional_split_by_cut(no_time, ["tx_id"])
    assert split.where("is_train = 1").count() == 80 and split.where("is_train = 0").count() == 20


def test_malformed_values_raise_or_are_listed(spark, tmp_path):
    path = csv(tmp_path, ["1,abc,5,1,2,3.0,0,0,2026-03-02 05:00:00", "1,5.0,5,1,2,,0,0,not a time",
                          "1,5.0,5,1,2,1.0,0,0,2026-03-02 05:00:00"])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        st.load_transactions(spark, path).collect()
    rows = st.load_transactions(spark, path, strict=False).orderBy("tx_id").collect()
    assert [r["_bad_columns"] for r in rows] == [["transaction_amount"], ["timestamp"], []]
    assert rows[1]["distance_from_home"] is None


def test_every_record_gets_an_answer(spark):
    feats = P.engineered(spark, SF_SMALL).withColumn(
        "amount_zscore", F.when(F.expr("tx_id % 5 = 0"), F.lit(None)).otherwise(F.col("amount_zscore")))
    records = js.features_to_json(feats).unionByName(
        spark.createDataFrame([(-1, "not json"), (-2, None), (-3, "{}")], "tx_id long, value string"))
    answers = {r["tx_id"]: json.loads(r["response"])
               for r in score_json_records(records, default_rule_detectors()).collect()}
    assert len(answers) == feats.count() + 3
    for tx, a in answers.items():
        if tx < 0 or tx % 5 == 0:
            assert a["status"] == "rejected" and a["reason"] and "predictions" not in a
        else:
            assert a["status"] == "analysed" and list(a["predictions"]) == ["zscore_rule", "ratio_rule"]
    assert answers[-1]["reason"] == "corrupt"
    cleaned = score_json_records(js.features_to_json(feats, clean=True), default_rule_detectors())
    assert cleaned.where("response LIKE '%rejected%'").count() == 0


def test_one_scan_and_no_exchange_for_all_models(spark, tmp_path):
    P.engineered(spark, SF_SMALL).write.parquet(str(tmp_path / "f"))
    feats = spark.read.parquet(str(tmp_path / "f"))
    for df in (score_wide(default_rule_detectors(), feats), score_all(default_rule_detectors(), feats),
               score_json_records(js.features_to_json(feats), default_rule_detectors())):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_models_load_through_the_file_system_and_errors_show(spark, tmp_path):
    base = f"file://{tmp_path}/models"
    assert load_detectors(spark, base) == {}
    RuleDetector().save(f"{base}/gbt")  # not a boosted-tree model
    with pytest.raises(Exception):
        load_detectors(spark, base)


def test_stream_slices_keep_all_rows_in_order(spark):
    lab = P.labelled(spark, SF_SMALL)
    some = lab.withColumn("timestamp", F.when(F.expr("tx_id % 10 = 1"), F.lit(None)).otherwise(F.col("timestamp")))
    before = spark.conf.get("spark.sql.files.maxRecordsPerFile")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "70")  # several files for every slice
    try:
        gaps = write_stream_input(some, "gaps", "timestamp", 4)
        path = write_stream_input(lab, "parts", "timestamp", 4)
    finally:
        spark.conf.set("spark.sql.files.maxRecordsPerFile", before)
    assert spark.read.parquet(gaps).count() == some.count()
    files = spark.read.parquet(path)
    assert len(files.inputFiles()) > 8
    bounds = files.groupBy(F.input_file_name().alias("f")).agg(
        F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).orderBy("f").collect()
    assert all(x["b"] <= y["a"] for x, y in zip(bounds, bounds[1:]))


def test_state_expires_by_event_time(spark):
    day = "2026-03-%02d 00:00:00"
    rows = [(1, 1, day % 1), (7, 1, "2026-03-01 01:00:00"), (2, 2, day % 2), (3, 2, day % 12), (4, 2, day % 13), (5, 2, day % 14), (6, 1, day % 20)]
    df = spark.createDataFrame(rows, "tx_id long, customer_id long, t string").select(
        "tx_id", "customer_id", F.col("t").cast("timestamp_ntz").alias("timestamp"))
    path = write_stream_input(df, "expire", "timestamp", 7)
    schema = "tx_id long, customer_id long, timestamp timestamp_ntz"

    def gaps(expire):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        return {r["tx_id"]: r["tx_frequency_24h"] for r in run_to_table(
            online_velocity(stream, expire, "1 hour"), f"expire-{expire}".replace(" ", "")).collect()}

    kept, dropped = gaps(None), gaps("5 days")
    assert set(kept) == set(dropped) == {1, 2, 3, 4, 5, 6, 7}
    assert kept[6] == 2 and dropped[6] == 1  # a new customer has its own (fixed) first gap only


def test_features_build_without_a_job(spark):
    tracker = spark.sparkContext.statusTracker()
    lab = P.labelled(spark, SF_SMALL)
    before = set(tracker.getJobIdsForGroup(None) or [])
    engineer_features(lab)
    assert set(tracker.getJobIdsForGroup(None) or []) == before

"""Hand-made edge frames (FIXTURES.md section 4)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from txsentinel.operators import evaluate as ev
from txsentinel.operators import features as fe
from txsentinel.operators.scaling import clean_features
from txsentinel.schema import TX_SCHEMA
from txsentinel.sources import json_records as js
from txsentinel.sources import transactions as st

T0 = dt.datetime(2026, 3, 1)


def tx(spark, rows):
    full = []
    for r in rows:
        d = dict(tx_id=None, customer_id=1, transaction_amount=10.0, hour_of_day=12, day_of_week=0,
                 merchant_category=0, distance_from_home=1.0, is_international=0, is_fraud=0,
                 timestamp=T0)
        d.update(r)
        full.append(tuple(d[f.name] for f in TX_SCHEMA.fields))
    return spark.createDataFrame(full, TX_SCHEMA)


def by_id(df):
    return {r["tx_id"]: r for r in df.collect()}


def test_single_transaction_customer_std_is_one(spark):
    df = tx(spark, [dict(tx_id=1, customer_id=7, transaction_amount=5.0)])
    out = by_id(fe.engineer_features(df))
    assert out[1]["amount_zscore"] == 0.0  # (5 - 5) / 1.0
    assert out[1]["tx_frequency_1h"] == 0 and out[1]["tx_frequency_24h"] == 1  # first gap 9999


def test_identical_amounts_give_null_zscore(spark):
    df = tx(spark, [dict(tx_id=i, transaction_amount=3.0, timestamp=T0 + dt.timedelta(hours=i))
                    for i in range(3)])
    out = by_id(fe.engineer_features(df))
    assert all(r["amount_zscore"] is None for r in out.values())
    assert all(r["zscore_x_frequency"] is None for r in out.values())
    cleaned = by_id(clean_features(fe.engineer_features(df)))
    assert all(r["amount_zscore"] == 0.0 for r in cleaned.values())


def test_median_zero_uses_one(spark):
    df = tx(spark, [dict(tx_id=1, transaction_amount=0.0), dict(tx_id=2, transaction_amount=0.0),
                    dict(tx_id=3, transaction_amount=4.0, timestamp=T0 + dt.timedelta(hours=1))])
    out = by_id(fe.engineer_features(df))
    assert out[3]["amount_to_median_ratio"] == 4.0


def test_tied_timestamps_break_on_tx_id(spark):
    df = tx(spark, [dict(tx_id=i, timestamp=T0) for i in (3, 1, 2)])
    gaps = by_id(fe.tx_gap_seconds(df))
    assert gaps[1]["gap_seconds"] == 9999.0
    assert gaps[2]["gap_seconds"] == 0.0 and gaps[3]["gap_seconds"] == 0.0
    vel = by_id(fe.add_velocity_features(df))
    assert [vel[i]["tx_frequency_1h"] for i in (1, 2, 3)] == [0, 1, 2]


def test_nan_and_inf_amounts(spark):
    df = tx(spark, [dict(tx_id=1, transaction_amount=float("nan")),
                    dict(tx_id=2, transaction_amount=float("inf"),
                         timestamp=T0 + dt.timedelta(hours=1))])
    norm = by_id(st.normalize_nulls(df))
    assert norm[1]["transaction_amount"] is None
    assert math.isinf(norm[2]["transaction_amount"])
    cleaned = by_id(clean_features(fe.engineer_features(st.normalize_nulls(df))))
    assert all(r["transaction_amount"] == 0.0 for r in cleaned.values())


def test_null_customer_gets_no_stats(spark):
    df = tx(spark, [dict(tx_id=1, customer_id=None, transaction_amount=5.0),
                    dict(tx_id=2, customer_id=2, transaction_amount=6.0)])
    out = by_id(fe.engineer_features(df))
    assert out[1]["amount_deviation"] is None
    assert out[2]["amount_deviation"] == 0.0


def test_missing_required_column(spark):
    df = tx(spark, [dict(tx_id=1)]).drop("merchant_category", "is_fraud")
    with pytest.raises(ValueError, match="merchant_category"):
        st.validate_columns(df)


def test_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        st.load_transactions(spark, str(tmp_path / "nope.csv"))


def test_csv_round_trip_and_timestamp_parse(spark, tmp_path):
    df = tx(spark, [dict(tx_id=i, timestamp=T0 + dt.timedelta(hours=i)) for i in range(4)])
    path = str(tmp_path / "tx.csv")
    st.write_table(df, path, fmt="csv")
    back = st.load_transactions(spark, path, fmt="csv")
    assert back.schema["timestamp"].dataType.simpleString() == "timestamp_ntz"
    assert sorted(r["tx_id"] for r in back.collect()) == [0, 1, 2, 3]
    st.write_table(df.limit(1), path, mode="ignore", fmt="csv")  # S7: kept as is
    assert st.load_transactions(spark, path, fmt="csv").count() == 4


def test_no_timestamp_uses_fallback(spark):
    df = tx(spark, [dict(tx_id=i) for i in range(7)]).drop("timestamp")
    out = by_id(fe.add_velocity_features(df))
    assert [out[i]["tx_frequency_1h"] for i in range(7)] == [0, 1, 2, 3, 4, 0, 1]
    assert [out[i]["tx_frequency_24h"] for i in range(7)] == list(range(7))


def scores(spark, rows):
    return spark.createDataFrame(rows, "tx_id long, model string, label int, score double, "
                                       "prediction int")


def test_one_class_only_still_four_counts(spark):
    s = scores(spark, [(i, "m", 0, float(i), 0) for i in range(5)])
    c = ev.confusion_counts(s).first()
    assert (c.true_negatives, c.false_positives, c.false_negatives, c.true_positives) == (5, 0, 0, 0)
    m = ev.classification_metrics(s).first()
    assert m.precision == 0.0 and m.recall == 0.0 and m.f1_score == 0.0
    auc = ev.auc_scores(ev.cumulative_counts(s)).first()
    assert auc.auc_roc is None and auc.auc_pr is None


def test_all_scores_equal(spark):
    s = scores(spark, [(i, "m", i % 2, 0.5, 1) for i in range(10)])
    auc = ev.auc_scores(ev.cumulative_counts(s)).first()
    assert auc.auc_roc == pytest.approx(0.5)
    assert auc.auc_pr == pytest.approx(0.5)
    sweep = ev.threshold_sweep(s).collect()
    assert len(sweep) == 201 and all(r.recall == 1.0 for r in sweep)


def test_auc_matches_brute_force(spark):
    import random
    rnd = random.Random(3)
    rows = [(i, "m", int(rnd.random() < 0.3), round(rnd.random(), 2), 0) for i in range(300)]
    s = scores(spark, rows)
    pos = [r[3] for r in rows if r[2] == 1]
    neg = [r[3] for r in rows if r[2] == 0]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    auc = ev.auc_scores(ev.cumulative_counts(s)).first()
    assert auc.auc_roc == pytest.approx(brute, abs=1e-12)
    # average precision by definition
    order = sorted(set(r[3] for r in rows), reverse=True)
    ap, prev_r = 0.0, 0.0
    for t in order:
        tp = sum(1 for r in rows if r[3] >= t and r[2] == 1)
        fp = sum(1 for r in rows if r[3] >= t and r[2] == 0)
        rec = tp / len(pos)
        ap += (rec - prev_r) * tp / (tp + fp)
        prev_r = rec
    assert auc.auc_pr == pytest.approx(ap, abs=1e-12)


def test_optimal_threshold_ties_take_lowest(spark):
    s = scores(spark, [(1, "m", 1, 0.9, 1), (2, "m", 0, 0.5, 0), (3, "m", 1, 0.1, 0)])
    o = ev.optimal_threshold(ev.cumulative_counts(s)).first()
    # thresholds 0.9 (P=1,R=.5) and 0.1 (P=2/3,R=1): F1 0.6667 vs 0.8 -> 0.1
    assert o.optimal_threshold == pytest.approx(0.1)
    assert o.f1_at_optimal == pytest.approx(0.8, abs=1e-9)


def test_malformed_json_is_invalid(spark):
    df = spark.createDataFrame([(1, "not json"), (2, '{"transaction_amount": 1.0}')],
                               "tx_id long, value string")
    out = by_id(js.parse_tx_json(df))
    assert out[1]["is_valid"] == 0 and out[2]["is_valid"] == 0


def test_api_example_record_identities(spark):
    """The one sample request obeys the interaction and cyclical identities."""
    from txsentinel.functions.scalars import cyclical
    df = spark.createDataFrame([(150.5, 5.2, 0.5, 2.0, 14, 3)],
                               "amount double, dist double, z double, f double, h int, d int")
    hs, hc = cyclical("h", 24)
    ds, dc = cyclical("d", 7)
    r = df.select((F.col("amount") * F.col("dist")).alias("axd"), (F.col("z") * F.col("f")).alias("zxf"),
                  hs.alias("hs"), hc.alias("hc"), ds.alias("ds"), dc.alias("dc")).first()
    assert r.axd == pytest.approx(782.6, abs=2e-3)
    assert r.zxf == pytest.approx(1.0)
    assert (r.hs, r.hc) == (pytest.approx(-0.5, abs=2e-3), pytest.approx(-0.866, abs=2e-3))
    assert (r.ds, r.dc) == (pytest.approx(0.433, abs=2e-3), pytest.approx(-0.9, abs=2e-3))
    assert r.hs ** 2 + r.hc ** 2 == pytest.approx(1.0)


def test_dataset_summary_counts_nulls(spark):
    df = tx(spark, [dict(tx_id=1, customer_id=None, is_fraud=1),
                    dict(tx_id=2, transaction_amount=None),
                    dict(tx_id=3)])
    r = st.dataset_summary(df).first()
    assert (r.n_total, r.n_fraud, r.n_legit, r.n_customers, r.null_cells) == (3, 1, 2, 1, 2)
    assert r.fraud_pct == pytest.approx(100.0 / 3)

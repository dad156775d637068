"""Ordered operators against brute force, including a hot group."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from txsentinel.operators import ordered


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        g = 0 if i % 3 == 0 else rnd.randint(1, 40)  # group 0 holds a third of the rows
        rows.append((i, g, round(rnd.gauss(50, 20), 2), rnd.randint(0, 3)))
    return rows, spark.createDataFrame(rows, "id long, g long, v double, w long")


def test_running_totals_per_group(spark, skewed):
    rows, df = skewed
    out = {r.id: r for r in ordered.running_totals(df, ["v", "id"], {"c": "w"}, ["g"],
                                                   group_totals=True, num_partitions=7).collect()}
    by_g = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        by_g.setdefault(r[1], []).append(r)
    for g, rs in by_g.items():
        acc = 0
        total = sum(r[3] for r in rs)
        for r in rs:
            acc += r[3]
            assert out[r[0]].c == acc
            assert out[r[0]].c_total == total


def test_global_position_is_a_permutation(spark, skewed):
    rows, df = skewed
    pos = ordered.global_position(df, [F.col("v").desc(), "id"], num_partitions=5).collect()
    expected = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])))}
    assert {r.id: r.pos for r in pos} == expected


def test_exact_quantiles_match_numpy(spark, skewed):
    rows, df = skewed
    qs = {"p25": 0.25, "med": 0.5, "p95": 0.95, "p0": 0.0, "p100": 1.0}
    got = {r.g: r for r in ordered.exact_quantiles(df, "v", qs, ["g"], num_partitions=6).collect()}
    for g in set(r[1] for r in rows):
        vals = np.array([r[2] for r in rows if r[1] == g])
        for name, q in qs.items():
            assert getattr(got[g], name) == pytest.approx(np.percentile(vals, 100 * q), abs=1e-9)


def test_positional_split(spark, skewed):
    rows, df = skewed
    out = ordered.positional_split(df, ["id"], 0.8).collect()
    assert sum(r.is_train for r in out) == int(len(rows) * 0.8)
    assert all((r.is_train == 1) == (r.id < 2400) for r in out)


def test_purged_kfold_matches_rule(spark):
    n = 103
    df = spark.range(n).withColumnRenamed("id", "pos")
    got = {(r.pos, r.fold): r.role for r in ordered.purged_kfold(df, n, 5, 7, 3).collect()}
    fold_size = n // 5
    expected = {}
    for i in range(5):
        s = i * fold_size
        e = s + fold_size if i < 4 else n
        for j in range(n):
            if s <= j < e:
                expected[(j, i)] = "val"
            elif j < s - 7 or j >= e + 3:
                expected[(j, i)] = "train"
    assert got == expected


@pytest.mark.parametrize("parts", [3, 37, 120])
def test_ranged_velocity_equals_window(spark, parts):
    """Skew-safe velocity (hot customer, NULL customer, tiny partitions) equals
    the plain per-customer window."""
    import datetime as dt
    from txsentinel.operators.features import add_velocity_features
    rnd = random.Random(parts)
    t0 = dt.datetime(2026, 3, 1)
    rows = []
    for i in range(900):
        c = 5 if i % 3 == 0 else (None if i % 97 == 0 else rnd.randint(1, 12))
        ts = t0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 20))
        rows.append((i, c, ts))
    df = spark.createDataFrame(rows, "tx_id long, customer_id long, timestamp timestamp_ntz")
    cols = ["tx_id", "gap_seconds", "tx_frequency_1h", "tx_frequency_24h"]
    a = add_velocity_features(df, keep_gap=True, strategy="ranged", num_partitions=parts)
    b = add_velocity_features(df, keep_gap=True, strategy="window")
    assert a.count() == 900
    assert a.select(*cols).exceptAll(b.select(*cols)).count() == 0


def test_fallback_row_numbers_split_hot_customer(spark):
    from txsentinel.operators.features import velocity_fallback
    rows = [(i, 1 if i % 2 else None) for i in range(50)]
    df = spark.createDataFrame(rows, "tx_id long, customer_id long")
    out = {r.tx_id: r for r in velocity_fallback(df, num_partitions=6).collect()}
    ones = sorted(i for i in range(50) if i % 2)
    for k, i in enumerate(ones):
        assert out[i].tx_frequency_1h == k % 5 and out[i].tx_frequency_24h == k % 20
    # rows without a customer have no count (pandas groups leave missing keys out)
    assert all(out[i].tx_frequency_1h is None and out[i].tx_frequency_24h is None for i in range(0, 50, 2))


def test_cut_split_and_key_folds_match_positions(spark, skewed):
    rows, df = skewed
    a = ordered.positional_split(df, ["v", "id"], 0.8).select("id", "is_train")
    b = ordered.positional_split_by_cut(df, ["v", "id"], 0.8, bins=200).select("id", "is_train")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    n = len(rows)
    pos = ordered.global_position(df, ["v", "id"])
    f1 = ordered.purged_kfold(pos, n, 5, 40, 9).select("id", "fold", "role")
    f2 = ordered.purged_kfold_by_keys(df, ["v", "id"], n, 5, 40, 9, bins=64).select(
        "id", "fold", "role")
    assert f1.exceptAll(f2).count() == 0 and f2.exceptAll(f1).count() == 0


@pytest.mark.parametrize("bins", [2, 7, 4096])
def test_selection_by_small_and_large_histograms(spark, skewed, bins):
    rows, df = skewed
    n, keys = ordered.keys_at_ranks(df, ["v", "id"], [0, 1, 250, len(rows) - 1, len(rows)], bins)
    wanted = sorted((r.v, r.id) for r in df.collect())
    assert n == len(wanted) and keys == {r: wanted[r] for r in (0, 1, 250, n - 1)}


def test_selection_of_extreme_and_missing_values(spark):
    import datetime as dt
    inf, nan = float("inf"), float("nan")
    doubles = [-inf, -1e308, -1.5, 0.0, 1e-300, 2.0, 1e308, inf, nan, None]
    longs = [-2 ** 63, -2 ** 63 + 1, -1, 0, 2 ** 53, 2 ** 53 + 1, 2 ** 63 - 2, 2 ** 63 - 1, None]
    t0 = dt.datetime(2026, 3, 8, 1, 59, 59, 999999)
    times = [t0, t0 + dt.timedelta(microseconds=1), t0 + dt.timedelta(days=4000), None]
    rows = [(d, n, t, 7) for d in doubles for n in longs for t in times]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "d double, n long, t timestamp_ntz, same int")
    last = lambda v: (v is None, v != v if v is not None else False, 0 if v is None or v != v else v)
    wanted = sorted(((d, n, t) for d, n, t, _ in rows),
                    key=lambda r: (last(r[0]), r[1] is None, r[1] or 0, r[2] is None, r[2] or t0))
    text = lambda r: (repr(r[0]), r[1], None if r[2] is None else r[2].strftime("%Y-%m-%d %H:%M:%S.%f"))
    for bins in (2, 64):
        n, keys = ordered.keys_at_ranks(df, ["same", "d", "n", "t"], range(0, len(rows), 13), bins)
        assert n == len(rows)
        assert {r: (repr(k[1]), k[2], k[3]) for r, k in keys.items()} == {
            r: text(wanted[r]) for r in range(0, len(rows), 13)}


def test_one_quantile_by_selection(spark, skewed):
    rows, df = skewed
    values = [r.v for r in df.collect()]
    with_gap = df.select("v").unionByName(spark.createDataFrame([(None,)], "v double"))
    for q in (0.0, 0.013, 0.5, 0.95, 1.0):
        assert ordered.exact_quantile(with_gap, "v", q) == pytest.approx(float(np.quantile(values, q)), abs=1e-12)
    assert ordered.exact_quantile(df.where("v IS NULL"), "v", 0.5) is None


def test_selection_of_an_empty_table_and_of_text(spark):
    assert ordered.keys_at_ranks(spark.createDataFrame([], "a long"), ["a"], [0]) == (0, {})
    with pytest.raises(TypeError):
        ordered.keys_at_ranks(spark.createDataFrame([("x",), ("y",)], "a string"), ["a"], [0])


def test_split_reads_ranges_and_collects_cells(spark, tmp_path):
    """No order, limit or offset over rows; the candidates' range reaches the scan."""
    spark.range(5000).selectExpr("id", "CAST(id % 97 AS DOUBLE) AS v").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    out = ordered.positional_split_by_cut(df, ["v", "id"], 0.5)
    assert out.where("is_train = 1").count() == 2500
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Sort", "Exchange", "Limit", "Offset"))
    span = ordered._Span(["v", "id"], [df.schema[c].dataType for c in ("v", "id")],
                         {"lo_v0": 3.0, "lo_n0": 3.0, "hi_v0": 3.0, "hi_n0": 3.0,
                          "lo_v1": 100, "lo_n1": 100, "hi_v1": 900, "hi_n1": 900})
    scan = df.where(span.holds())._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,100)" in scan and "LessThanOrEqual(id,900)" in scan


def test_cumulative_counts_ranged_equals_window(spark):
    from txsentinel.operators import evaluate as ev
    rnd = random.Random(11)
    rows = [(i, "m" + str(i % 3), int(rnd.random() < 0.2), round(rnd.random(), 3), 0)
            for i in range(2000)]
    s = spark.createDataFrame(rows, "tx_id long, model string, label int, score double, "
                                    "prediction int")
    cols = ["model", "score", "pos", "neg", "tp", "fp", "n_pos", "n_neg"]
    a = ev.cumulative_counts(s, num_partitions=5, method="ranged").select(*cols)
    b = ev.cumulative_counts(s, method="window").select(*cols)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_cut_split_is_time_zone_free(spark):
    """Keys of timestamp_ntz columns round-trip without session-zone shifts."""
    import datetime as dt
    t0 = dt.datetime(2026, 3, 8, 0, 0)  # a DST change day in America/New_York
    rows = [(i, t0 + dt.timedelta(minutes=7 * i)) for i in range(500)]
    df = spark.createDataFrame(rows, "tx_id long, timestamp timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        out = ordered.positional_split_by_cut(df, ["timestamp", "tx_id"], 0.8, bins=50)
        assert sorted(r.tx_id for r in out.where("is_train = 1").collect()) == list(range(400))
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_ranged_sequences_equal_window(spark):
    import datetime as dt
    from txsentinel.operators.features import sequence_features
    rnd = random.Random(5)
    t0 = dt.datetime(2026, 3, 1)
    rows = [(i, 7 if i % 2 else rnd.randint(1, 5), t0 + dt.timedelta(minutes=rnd.randint(0, 9999)),
             float(i), float(i % 13)) for i in range(400)]
    df = spark.createDataFrame(rows, "tx_id long, customer_id long, timestamp timestamp_ntz, "
                                     "a double, b double")
    kw = dict(length=4, features=["a", "b"])
    x = sequence_features(df, strategy="ranged", num_partitions=23, **kw).select("tx_id", "sequence")
    y = sequence_features(df, strategy="window", **kw).select("tx_id", "sequence")
    assert x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0

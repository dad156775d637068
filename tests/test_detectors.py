"""Detector properties on the injected sf0.01 data (rows-only checks)."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_MID
from txsentinel.functions.hashing import keyed_normal, keyed_uniform
from txsentinel.operators import evaluate as ev
from txsentinel.operators.detectors.gbt import GBTDetector, param_search, top_importances
from txsentinel.operators.detectors.iforest import IsolationForestDetector
from txsentinel.operators.detectors.discriminator import (
    DiscriminatorDetector, copula_factor, copula_rows, quantile_grids,
)
from txsentinel.operators.detectors.recon import (
    AutoencoderDetector, PCAReconstructionDetector, choose_components,
)
from txsentinel.operators.profile import normal_only
from txsentinel.plans import flow as P


@pytest.fixture(scope="module")
def split(spark):
    return P.split(spark, SF_MID, persist=True)


@pytest.fixture(scope="module")
def train(split):
    return split.where("is_train = 1")


@pytest.fixture(scope="module")
def test(split):
    return split.where("is_train = 0")


def auc(scores):
    return ev.auc_scores(ev.cumulative_counts(scores)).first().auc_roc


def flag_rate(scores):
    return scores.agg(F.avg("prediction")).first()[0]


def test_gbt_learns_and_round_trips(spark, train, test, tmp_path):
    det = GBTDetector(params={"n_estimators": 15, "max_depth": 4, "learning_rate": 0.1,
                              "subsample": 0.8}).fit(train)
    s = det.score(test)
    assert auc(s) > 0.85
    imp = det.importances()
    assert imp.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    assert top_importances(imp, 15).count() == 15
    det.save(str(tmp_path / "gbt"))
    again = GBTDetector.load(spark, str(tmp_path / "gbt")).score(test)
    assert again.exceptAll(s).count() == 0


def test_param_search_picks_a_grid_point(spark, train):
    grid = [{"n_estimators": 3, "max_depth": 3, "learning_rate": 0.3, "subsample": 1.0},
            {"n_estimators": 3, "max_depth": 5, "learning_rate": 0.3, "subsample": 1.0}]
    best, table = param_search(train, ["timestamp", "tx_id"], grid, n_splits=2, purge=50,
                               embargo=10)
    assert best in grid and table.count() == 2


def test_isolation_forest_contamination(spark, train, test, tmp_path):
    det = IsolationForestDetector(n_trees=50).fit(train)
    assert flag_rate(det.score(train)) == pytest.approx(0.02, abs=0.005)
    s = det.score(test)
    assert auc(s) > 0.8
    det.save(str(tmp_path / "if"))
    again = IsolationForestDetector.load(spark, str(tmp_path / "if")).score(test)
    assert again.exceptAll(s).count() == 0


def test_isolation_forest_scores_in_the_jvm_like_a_walk_over_its_nodes(spark, train, test):
    import numpy as np
    from txsentinel.operators.detectors.base import feature_array, prepared
    from txsentinel.operators.detectors.iforest import avg_path_length
    det = IsolationForestDetector(n_trees=20).fit(train)
    rows = prepared(test, det.scaler, None).select("tx_id", feature_array(det.features).alias("x")).collect()
    trees = {t: g.set_index("node_id") for t, g in det.nodes.groupby("tree_id")}

    def path(x, nodes):
        at, depth = 0, 0
        while nodes.at[at, "left"] >= 0:
            at = nodes.at[at, "left" if x[nodes.at[at, "feature"]] < nodes.at[at, "threshold"] else "right"]
            depth += 1
        return depth + float(avg_path_length(np.array([nodes.at[at, "size"]]))[0])

    got = {r["tx_id"]: r for r in det.score(test).collect()}
    for r in rows[::20]:
        mean = np.mean([path(r["x"], nodes) for nodes in trees.values()])
        s = 2.0 ** (-mean / float(avg_path_length(np.array([det.psi]))[0]))
        assert got[r["tx_id"]]["score"] == pytest.approx(s - det.threshold, abs=1e-9)
        assert got[r["tx_id"]]["prediction"] == int(got[r["tx_id"]]["score"] > 0)
    plan = det.score(test)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize("q,rate", [(0.95, 0.05), (0.99, 0.01)])
def test_pca_reconstruction_thresholds(spark, train, test, q, rate):
    normals = normal_only(train)
    det = PCAReconstructionDetector(k=8, quantile=q).fit(normals)
    assert flag_rate(det.score(normals)) == pytest.approx(rate, abs=0.004)
    assert auc(det.score(test)) > 0.75
    assert det.latent(test).first().latent.__len__() == 8


def test_autoencoder_loss_decreases(spark, train, test, tmp_path):
    normals = normal_only(train)
    det = AutoencoderDetector(hidden=(16, 8, 16), epochs=8, learning_rate=5e-3).fit(normals)
    losses = [h[0] for h in det.history]
    assert losses[-1] < losses[0]
    assert flag_rate(det.score(normals)) == pytest.approx(0.05, abs=0.01)
    assert len(det.latent(test).first().latent) == 8
    det.save(str(tmp_path / "ae"))
    again = AutoencoderDetector.load(spark, str(tmp_path / "ae"))
    assert again.score(test).exceptAll(det.score(test)).count() == 0


def test_pca_components_chosen_on_a_validation_fold(spark, train, test):
    k = choose_components(train, ["timestamp", "tx_id"])
    det = PCAReconstructionDetector(k=k).fit(normal_only(train))
    assert auc(det.score(test)) > 0.85
    other = det.with_quantile("p99", 0.99, normal_only(train))
    assert other.components == det.components and other.threshold > det.threshold


def test_autoencoder_trains_on_the_real_net(spark, train, test):
    det = AutoencoderDetector(epochs=25).fit(normal_only(train))
    assert det.history[-1][1] < 0.2  # validation loss; it starts near 1
    assert auc(det.score(test)) > 0.85


def test_discriminator_bar(spark, train, test):
    det = DiscriminatorDetector(max_iter=10).fit(normal_only(train))
    assert auc(det.score(test)) > 0.85
    # few trees give few different scores: flags are strictly above the P95, ties with it are not
    own = det.score(normal_only(train))
    assert 0 < flag_rate(own) <= 0.051
    assert own.where(F.col("score") >= det.threshold).count() >= 0.05 * own.count()


def test_copula_keeps_marginals_and_dependence(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "tx_id")
    x, e = keyed_normal("tx_id", "x1", "x2"), keyed_normal("tx_id", "e1", "e2")
    real = rows.select("tx_id", F.exp(x).alias("a"), (x * 0.8 + e * 0.6).alias("b"),
                       F.floor(keyed_uniform("tx_id", "c") * 3).cast("double").alias("c"), F.lit(7.0).alias("d"))
    grids = quantile_grids(real, ["a", "b", "c", "d"])
    drawn = copula_rows(real.select("tx_id"), grids, copula_factor(real, grids), "t").cache()
    # the dependence survives the skewed marginal; features of the same row are not copied from it
    assert drawn.select(F.corr(F.log("a"), "b")).first()[0] == pytest.approx(0.8, abs=0.02)
    assert abs(drawn.select(F.corr("a", "c")).first()[0]) < 0.03
    assert abs(drawn.join(real.select("tx_id", F.col("b").alias("rb")), "tx_id").select(F.corr("b", "rb")).first()[0]) < 0.03
    for q in (0.1, 0.5, 0.9):
        got, want = (t.agg(F.percentile("a", q)).first()[0] for t in (drawn, real))
        assert got == pytest.approx(want, rel=0.06)
    assert {r["c"]: round(r["count"] / 20_000, 1) for r in drawn.groupBy("c").count().collect()} == {0.0: 0.3, 1.0: 0.3, 2.0: 0.3}
    assert drawn.select("d").distinct().collect() == [(7.0,)]
    again = copula_rows(real.select("tx_id").repartition(7), grids, copula_factor(real, grids), "t")
    assert again.select(F.sum("b"), F.max("a")).first()[1] == drawn.select(F.max("a")).first()[0]


def test_reference_rows_are_drawn_in_tasks_by_the_same_numbers(spark, train):
    import numpy as np
    from txsentinel.functions.hashing import keyed_uniforms
    from txsentinel.operators.detectors.base import fit_feature_scaler, prepared
    ids = spark.createDataFrame([(-3,), (0,), (17,), (10 ** 15,)], "tx_id long")
    want = [r[0] for r in ids.select(keyed_uniform("tx_id", "ref42:box:a")).collect()]
    assert keyed_uniforms([str(r[0]).encode() for r in ids.collect()], "ref42:box:a").tolist() == want
    assert len(keyed_uniforms([], "s")) == 0
    det, normals = DiscriminatorDetector(), normal_only(train)
    rows = det.training_rows(prepared(normals, fit_feature_scaler(normals, det.features), None))
    # digests, number conversions and grid look-ups of 55 numbers a row were expressions of one projection
    assert "md5" not in rows._jdf.queryExecution().optimizedPlan().toString()
    got = rows.toPandas()
    assert (got["_label"] == 1).sum() == (got["_label"] == 0).sum() == normals.count()
    real, drawn = (np.stack(got.loc[got["_label"] == v, "features"]) for v in (1, 0))
    # half of the reference rows may leave the copula, each feature in a fifth of them: half of that lies outside
    outside = (drawn < real.min(axis=0)) | (drawn > real.max(axis=0))
    assert 0.01 < outside.mean() < 0.06 and abs(outside.any(axis=1).mean() - 0.45) < 0.08


def test_copula_of_few_rows(spark):
    one = spark.createDataFrame([(1, 2.0, 3.0)], "tx_id long, a double, b double")
    none = one.where("tx_id < 0")
    for rows, n in ((one, 1), (none, 0)):
        grids = quantile_grids(rows, ["a", "b"])
        drawn = copula_rows(rows.select("tx_id"), grids, copula_factor(rows, grids), "t").collect()
        assert [tuple(r) for r in drawn] == [(1, 2.0, 3.0)][:n]


def test_forest_sample_follows_one_rule(spark):
    from txsentinel.operators.detectors.iforest import binomial_steps, tree_samples
    assert binomial_steps(3, 0.5) == pytest.approx([0.125, 0.5, 0.875])
    for n, psi in ((100, 64), (5000, 64)):
        rows = spark.range(n).withColumnRenamed("id", "tx_id")
        got = tree_samples(rows, n, 50, psi).groupBy("tree_id").agg(
            F.count("*").alias("n"), F.countDistinct("tx_id").alias("d")).collect()
        assert len(got) == 50 and all(r["n"] == r["d"] == psi for r in got)


def test_pca_errors_are_one_matrix_product_per_batch(spark, train):
    import numpy as np
    from txsentinel.operators.detectors.base import prepared
    from txsentinel.schema import CLIP_BOUND
    normals = normal_only(train)
    det = PCAReconstructionDetector(k=4, quantile=0.95).fit(normals)
    rows = det._errors(prepared(normals, det.scaler, CLIP_BOUND)).select("err", *det.features).toPandas()
    X, P = rows[det.features].to_numpy(float), np.array(det.components)
    assert rows["err"].to_numpy() == pytest.approx(np.mean((X - X @ P @ P.T) ** 2, axis=1), abs=1e-9)
    assert det.threshold == pytest.approx(np.quantile(rows["err"], 0.95), abs=1e-12)
    # interpreted array functions computed the projection once per feature
    plan = det.score(train)._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan and "zip_with(" not in plan
    # another quantile reads the errors that the fit wrote
    assert det.with_quantile("p99", 0.99).threshold == pytest.approx(np.quantile(rows["err"], 0.99), abs=1e-12)


def test_autoencoder_passes_read_whole_matrices(spark, train, monkeypatch):
    import numpy as np
    import pyarrow as pa
    from txsentinel.operators.detectors import recon
    rows = np.arange(50.0).reshape(25, 2)
    batches = [pa.RecordBatch.from_pydict({"x": list(rows[a:b]), "is_val": [i % 3 == 0 for i in range(a, b)]})
               for a, b in ((0, 7), (7, 7), (7, 25)) if b > a]
    monkeypatch.setattr(recon, "BLOCK_ROWS", 10)
    blocks = [b.to_pydict() for b in recon._blocks(iter(batches))]
    X = [np.frombuffer(b["x"][0]).reshape(-1, 2) for b in blocks]
    assert [len(x) for x in X] == [10, 10, 5] and np.array_equal(np.concatenate(X), rows)
    assert [v for b in blocks for v in np.frombuffer(b["is_val"][0], bool)] == [i % 3 == 0 for i in range(25)]


def test_autoencoder_does_not_depend_on_how_many_tasks_make_its_passes(spark, train, monkeypatch):
    from txsentinel.operators.detectors import recon
    monkeypatch.setattr(recon, "ROWS_PER_PARTITION", 700)
    normals = normal_only(train)
    coalesce, asked = type(normals).coalesce, []

    def fit(tasks):
        monkeypatch.setattr(type(normals), "coalesce", lambda df, n: asked.append(n) or coalesce(df, tasks or n))
        return AutoencoderDetector(hidden=(8, 4, 8), epochs=2).fit(normals)

    many, few = fit(None), fit(1)
    assert asked and max(asked) <= spark.sparkContext.defaultParallelism     # not one task per partition
    assert few.weights == pytest.approx(many.weights, abs=1e-9) and len(few.history) == 3


def test_all_detectors_are_fitted_beside_the_boosted_trees(spark, monkeypatch):
    from threading import Event
    from txsentinel.plans import models as M
    begun, asked = Event(), {}

    def fitted(spark, sf, name, cores=None):
        asked[name] = cores
        if name == "gbt":       # one after the other it would wait in vain
            assert begun.wait(20)
        begun.set() if name == "discriminator" else None
        return name

    monkeypatch.setattr(M, "split_table", lambda *a: None)
    monkeypatch.setattr(M, "fitted", fitted)
    assert M.fitted_all(spark, SF_MID) == {n: n for n in M.ALL_MODELS}
    assert asked["autoencoder"] == max(1, spark.sparkContext.defaultParallelism // 2)


def test_autoencoder_passes_leave_cores_free_and_hand_over_one_vector_a_task(spark, train, monkeypatch):
    from txsentinel.operators.detectors import recon
    monkeypatch.setattr(recon, "ROWS_PER_PARTITION", 700)
    normals, DataFrame = normal_only(train), type(train)
    coalesce, mapped, asked, rows = DataFrame.coalesce, DataFrame.mapInArrow, [], []
    monkeypatch.setattr(DataFrame, "coalesce", lambda df, n: asked.append(n) or coalesce(df, n))

    def counted(df, f, schema):
        out = mapped(df, f, schema)
        if "loss_val" in schema:
            rows.append(out.select("n_train").count())
        return out

    monkeypatch.setattr(DataFrame, "mapInArrow", counted)
    AutoencoderDetector(hidden=(8, 4, 8), epochs=1, cores=2).fit(normals)
    assert asked == [2] and rows == [2, 2]      # 11 partitions in two tasks


def test_autoencoder_steps_in_float32_follow_plain_adam():
    import numpy as np
    from txsentinel.operators.detectors import recon
    sizes, rng = [3, 5, 2, 5, 3], np.random.default_rng(1)
    X = rng.normal(size=(20, 3)).astype(np.float32)
    w = recon._flatten(recon._init_weights(sizes, 7))
    state = np.concatenate([w, np.zeros(2 * len(w))]).astype(np.float32)
    net, m, v = recon._Network(sizes, 8), np.zeros(len(w)), np.zeros(len(w))
    for step, k in enumerate(range(0, 20, 8), 1):
        rows, params = X[k:k + 8].astype(float), recon._unflatten(w, sizes)
        acts, loss = recon._forward(params, rows), float(np.sum(recon._row_mse(params, rows)))
        delta, parts = 2.0 * (acts[-1] - rows) / 3, []
        for i in range(3, -1, -1):
            parts[:0] = [acts[i].T @ delta, delta.sum(axis=0)]
            delta = (delta @ params[2 * i].T) * (acts[i] > 0)
        g = recon._flatten(parts) / len(rows)
        assert net.loss(recon._unflatten(state[:len(w)], sizes), X[k:k + 8]) == pytest.approx(loss, rel=1e-4)
        assert net.adam_step(state, X[k:k + 8], step, 1e-3) == pytest.approx(loss, rel=1e-4)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 1e-3 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-7)
    assert state.dtype == np.float32 and state[:len(w)] == pytest.approx(w, abs=1e-5)


def test_autoencoder_takes_all_cores_when_the_others_are_done(spark, train, monkeypatch):
    from txsentinel.operators.detectors import recon
    monkeypatch.setattr(recon, "ROWS_PER_PARTITION", 700)
    normals, DataFrame, asked, free = normal_only(train), type(train), [], iter([False, True])
    coalesce = DataFrame.coalesce
    monkeypatch.setattr(DataFrame, "coalesce", lambda df, n: asked.append(n) or coalesce(df, n))
    det = AutoencoderDetector(hidden=(8, 4, 8), epochs=2, cores=1, alone=lambda: next(free)).fit(normals)
    assert asked == [1, spark.sparkContext.defaultParallelism] and len(det.history) == 3


def test_discriminator_grows_its_trees_by_histogram_rounds(spark, train, monkeypatch):
    from txsentinel.operators.detectors import discriminator as D
    grown, plain = [], getattr(D, "boosted_trees", None)
    monkeypatch.setattr(D, "boosted_trees", lambda *a, **k: grown.append(k["trees"]) or plain(*a, **k), raising=False)
    det = DiscriminatorDetector(max_iter=2).fit(normal_only(train))
    assert grown == [2] and det.model.getNumTrees == 2

"""The three batch entry points end to end (small detectors), with sinks."""

import os

from tests.conftest import SF_SMALL
from txsentinel.plans import batch
from txsentinel.plans.training import TrainingConfig


def test_preprocess_train_evaluate(spark, tmp_path):
    out = str(tmp_path / "run")
    feats = batch.preprocess(spark, SF_SMALL, out)
    n = feats.count()
    assert n == spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
    batch.preprocess(spark, SF_SMALL, out)  # raw table kept, not regenerated
    cfg = TrainingConfig(models=("gbt", "isolation_forest", "pca_p95"),
                         gbt_params={"n_estimators": 5, "max_depth": 3, "learning_rate": 0.3,
                                     "subsample": 1.0}, iforest_trees=20)
    scores = batch.train(spark, out, cfg)
    assert sorted(r.model for r in scores.select("model").distinct().collect()) == \
        ["gbt", "isolation_forest", "pca_p95"]
    assert scores.where("model = 'gbt'").count() == n - int(n * 0.8)
    table = batch.evaluate(spark, out)
    assert table.count() == 3
    for d in ("tournament", "thresholds", "importances", "models/gbt", "models/isolation_forest"):
        assert os.path.exists(os.path.join(out, d))
    assert batch.evaluate(spark, out, ["gbt"]).count() == 1  # partition-pruned read


def test_sequence_model_shares_the_network_and_the_projection_size_is_chosen(spark):
    from txsentinel.plans import flow as P
    from txsentinel.plans.training import train_all
    split = P.split(spark, SF_SMALL, persist=True)
    models = ("pca_p99", "autoencoder", "sequence_autoencoder")
    fitted, scores = train_all(split, TrainingConfig(models=models, ae_epochs=3, ae_hidden=(8, 4, 8)))
    assert fitted["sequence_autoencoder"].threshold > fitted["autoencoder"].threshold
    assert 1 <= fitted["pca_p99"].k < 18
    assert {r["model"] for r in scores.select("model").distinct().collect()} == set(models)

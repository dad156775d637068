"""Reconstruction-error detectors.

Both are fitted on legit training rows only, score = mean squared
reconstruction error in standardised space, threshold = exact percentile of
the training errors (P95 for the deep variant, P99 for the sequence
variant), flag = error > threshold (strict).

* ``PCAReconstructionDetector`` (M7): MLlib PCA (distributed covariance);
  projection and reconstruction are two matrix products per Arrow batch.
* ``AutoencoderDetector`` (M8): a dense ReLU autoencoder trained by rounds of
  local mini-batch Adam: a round broadcasts weights and moments, every
  partition makes one pass in mini-batches (``mapInArrow``, numpy in float32, as
  Keras trains), Spark sums the results in float64 weighted by rows
  (``Summarizer.sum``, partial aggregation) and the driver receives one vector
  per round.  A keyed-hash 15 % validation
  split drives early stopping with best-weight restore.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txsentinel.functions.hashing import keyed_uniform
from txsentinel.operators.detectors.base import (
    feature_array, fit_feature_scaler, load_meta, load_scaler, long_scores, prepared, save_meta,
    save_scaler, verdict,
)
from txsentinel.operators.ordered import exact_quantile
from txsentinel.operators.scaling import Scaler, assemble
from txsentinel.schema import CLIP_BOUND, FEATURES
from txsentinel.session import materialize


def _threshold(errors: DataFrame, q: float) -> float:
    """Exact quantile of written errors: rank selection reads them a few times and shuffles cells only."""
    return float(exact_quantile(errors, "err", q))


@dataclass
class PCAReconstructionDetector:
    name: str = "pca_reconstruction"
    k: int = 8
    quantile: float = 0.95
    features: list[str] = field(default_factory=lambda: list(FEATURES))
    scaler: Scaler | None = None
    components: list[list[float]] | None = None  # d x k
    threshold: float | None = None
    train_errors: DataFrame | None = field(default=None, repr=False)

    def fit(self, train_normal: DataFrame) -> "PCAReconstructionDetector":
        self.scaler = fit_feature_scaler(train_normal, self.features)
        data = assemble(prepared(train_normal, self.scaler, CLIP_BOUND), self.features)
        model: PCAModel = PCA(k=self.k, inputCol="features", outputCol="_pca").fit(data)
        self.components = model.pc.toArray().tolist()
        self.train_errors = self._written_errors(train_normal)
        self.threshold = _threshold(self.train_errors, self.quantile)
        return self

    def _written_errors(self, rows: DataFrame) -> DataFrame:
        return materialize(self._errors(prepared(rows, self.scaler, CLIP_BOUND)).select("err"), "pca_train")

    def _errors(self, scaled: DataFrame) -> DataFrame:
        """Mean squared error between x and its reconstruction P P^T x."""
        P = np.asarray(self.components)

        @F.pandas_udf(T.DoubleType())
        def mse(x: pd.DataFrame) -> pd.Series:
            X = x.to_numpy(dtype=float)
            return pd.Series(np.mean((X - (X @ P) @ P.T) ** 2, axis=1))

        return scaled.withColumn("err", mse(F.struct(*[F.col(c).cast("double") for c in self.features])))

    def with_quantile(self, name: str, quantile: float, train_normal: DataFrame | None = None
                      ) -> "PCAReconstructionDetector":
        """The same fitted projection under another training quantile (no second fit); without
        ``train_normal`` the errors of the fit are used again."""
        out = replace(self, name=name, quantile=quantile)
        if train_normal is not None or out.train_errors is None:
            out.train_errors = out._written_errors(train_normal)
        out.threshold = _threshold(out.train_errors, quantile)
        return out

    def add_verdict(self, df: DataFrame, out: str) -> DataFrame:
        if self.components is None:
            raise ValueError("model is not trained")
        e = F.col("err")
        errs = self._errors(prepared(df, self.scaler, CLIP_BOUND))
        return errs.withColumn(out, verdict(e, e > F.lit(self.threshold))).drop("err")

    def score(self, df: DataFrame) -> DataFrame:
        return long_scores(self.add_verdict(df, "_v"), self.name, "_v")

    def latent(self, df: DataFrame) -> DataFrame:
        """M8b analogue: the k principal-component scores as array<double>."""
        P = np.asarray(self.components)

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def project(x: pd.DataFrame) -> pd.Series:
            return pd.Series(list(x.to_numpy(dtype=float) @ P), dtype=object)

        scaled = prepared(df, self.scaler, CLIP_BOUND)
        return scaled.select("tx_id", project(F.struct(*[F.col(c).cast("double") for c in self.features]))
                             .alias("latent"))

    def save(self, path: str) -> None:
        save_scaler(path, self.scaler)
        save_meta(path, {"name": self.name, "k": self.k, "quantile": self.quantile,
                         "features": self.features, "components": self.components,
                         "threshold": self.threshold})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "PCAReconstructionDetector":
        m = load_meta(spark, path)
        return cls(name=m["name"], k=m["k"], quantile=m["quantile"], features=m["features"],
                   scaler=load_scaler(spark, path), components=m["components"],
                   threshold=m["threshold"])


def choose_components(train: DataFrame, order: list[str],
                      candidates: tuple[int, ...] = (4, 6, 8, 10, 12)) -> int:
    """M7: the number of components with the best AUC on the last fifth of the training rows.

    One PCA is fitted on the normal rows before them; fewer components are a prefix of it, and one
    wide pass over the validation rows scores all candidates.  Ties go to the smaller number."""
    from txsentinel.operators.evaluate import auc_scores, cumulative_counts
    from txsentinel.operators.ordered import positional_split_by_cut
    from txsentinel.operators.profile import normal_only
    from txsentinel.plans.training import score_all

    rows = materialize(positional_split_by_cut(train.drop("is_train", "n_rows"), order), "pca-folds")
    full = PCAReconstructionDetector(k=max(candidates)).fit(normal_only(rows.where("is_train = 1")))
    detectors = {f"k{k}": replace(full, k=k, components=[row[:k] for row in full.components])
                 for k in candidates}
    scores = score_all(detectors, rows.where("is_train = 0"))
    auc = {r["model"]: r["auc_roc"] or 0.0 for r in auc_scores(cumulative_counts(scores)).collect()}
    return max(sorted(candidates), key=lambda k: auc.get(f"k{k}", 0.0))


# ------------------------------------------------------------ autoencoder ---
def _init_weights(sizes: list[int], seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    params = []
    for a, b in zip(sizes[:-1], sizes[1:]):
        limit = np.sqrt(6.0 / (a + b))  # Glorot uniform
        params.append(rng.uniform(-limit, limit, size=(a, b)))
        params.append(np.zeros(b))
    return params


def _flatten(params: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([p.ravel() for p in params])


def _unflatten(vec: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    out, i = [], 0
    for a, b in zip(sizes[:-1], sizes[1:]):
        out.append(vec[i:i + a * b].reshape(a, b))
        i += a * b
        out.append(vec[i:i + b])
        i += b
    return out


def _forward(params: list[np.ndarray], X: np.ndarray):
    acts = [X]
    h = X
    n_layers = len(params) // 2
    for li in range(n_layers):
        z = h @ params[2 * li] + params[2 * li + 1]
        h = z if li == n_layers - 1 else np.maximum(z, 0.0)
        acts.append(h)
    return acts


#: Rows a partition holds at least while the autoencoder trains (about 40 mini-batches a pass).
ROWS_PER_PARTITION = 10_000


#: Moments below this are zero: in float32 they would end as numbers without a full mantissa, which are slow.
_TINY = np.float32(1e-30)


class _Network:
    """Training passes over mini-batches of float32 rows, in arrays that are made once."""

    def __init__(self, sizes: list[int], batch: int):
        self.sizes, self.batch = sizes, batch
        self.acts, self.deltas, self.zeros = ([np.zeros((batch, k), np.float32) for k in sizes] for _ in range(3))
        self.masks = [np.zeros((batch, k), bool) for k in sizes]
        self.ones = np.ones(batch, np.float32)
        self.grad = np.empty(sum((a + 1) * b for a, b in zip(sizes[:-1], sizes[1:])), np.float32)
        self.room = np.empty_like(self.grad)
        self.grads = _unflatten(self.grad, sizes)

    def _forward(self, params: list[np.ndarray], X: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """(inputs of all layers, output minus input)."""
        n, acts, last = len(X), [X], len(self.sizes) - 1
        for i in range(1, last):
            h = self.acts[i][:n]
            np.matmul(acts[-1], params[2 * i - 2], out=h)
            h += params[2 * i - 1]
            acts.append(np.maximum(h, self.zeros[i][:n], out=h))
        diff = self.deltas[last][:n]
        np.matmul(acts[-1], params[-2], out=diff)
        diff += params[-1]
        diff -= X
        return acts, diff

    def loss(self, params: list[np.ndarray], X: np.ndarray) -> float:
        """Sum over the rows of ``X`` of their mean squared error."""
        total = 0.0
        for k in range(0, len(X), self.batch):
            flat = self._forward(params, X[k:k + self.batch])[1].ravel()
            total += float(flat @ flat)
        return total / self.sizes[0]

    def adam_step(self, state: np.ndarray, X: np.ndarray, step: int, rate: float) -> float:
        """One Adam step on ``state`` = (weights, first, second moments), in place; summed row loss."""
        n, some = len(state) // 3, len(X)
        w, m, v = state[:n], state[n:2 * n], state[2 * n:]
        params = _unflatten(w, self.sizes)
        acts, delta = self._forward(params, X)
        flat = delta.ravel()
        loss = float(flat @ flat) / self.sizes[0]
        delta *= np.float32(2.0 / (self.sizes[0] * some))
        for i in range(len(acts) - 1, -1, -1):
            np.matmul(acts[i].T, delta, out=self.grads[2 * i])
            np.matmul(self.ones[:some], delta, out=self.grads[2 * i + 1])
            if i:
                below = self.deltas[i][:some]
                np.matmul(delta, params[2 * i].T, out=below)
                below *= np.greater(acts[i], self.zeros[i][:some], out=self.masks[i][:some])
                delta = below
        g, t = self.grad, self.room
        for moment, share in ((m, 0.1), (v, 0.001)):
            np.subtract(g, moment, out=t)
            t *= np.float32(share)
            moment += t
            moment += _TINY
            moment -= _TINY
            g *= g                  # the second moment is of the squares
        np.multiply(v, np.float32(1.0 / (1 - 0.999 ** step)), out=t)
        np.sqrt(t, out=t)
        t += np.float32(1e-7)
        np.divide(m, t, out=t)
        t *= np.float32(rate / (1 - 0.9 ** step))
        w -= t
        return loss


def _row_mse(params: list[np.ndarray], X: np.ndarray) -> np.ndarray:
    out = _forward(params, X)[-1]
    return np.mean((out - X) ** 2, axis=1)


#: Rows of one matrix that the autoencoder's passes read.
BLOCK_ROWS = 10_240


def _blocks(batches):
    """(x, is_val) rows of a partition, in their order, as matrices of BLOCK_ROWS rows with the partition's number."""
    held, shard = None, TaskContext.get().partitionId() if TaskContext.get() else 0

    def block(X, val):
        return pa.RecordBatch.from_pydict({
            "shard": pa.array([shard], pa.int32()), "x": [X.tobytes()], "is_val": [val.tobytes()]})

    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        val = batch.column("is_val").to_numpy(zero_copy_only=False).astype(bool)
        held = (x, val) if held is None else tuple(np.concatenate(p) for p in zip(held, (x, val)))
        while len(held[0]) >= BLOCK_ROWS:
            yield block(held[0][:BLOCK_ROWS], held[1][:BLOCK_ROWS])
            held = held[0][BLOCK_ROWS:], held[1][BLOCK_ROWS:]
    if held is not None and len(held[0]):
        yield block(*held)


@dataclass
class AutoencoderDetector:
    name: str = "autoencoder"
    hidden: tuple[int, ...] = (64, 32, 16, 32, 64)
    epochs: int = 100
    learning_rate: float = 1e-3
    patience: int = 10
    batch_size: int = 256
    validation: float = 0.15
    quantile: float = 0.95
    seed: int = 42
    features: list[str] = field(default_factory=lambda: list(FEATURES))
    scaler: Scaler | None = None
    weights: np.ndarray | None = None
    threshold: float | None = None
    history: list[tuple[float, float]] = field(default_factory=list)
    train_errors: DataFrame | None = field(default=None, repr=False)
    cores: int | None = None    # tasks of one training pass at most; None: as many as there are cores
    alone: Callable[[], bool] | None = field(default=None, repr=False)  # whether the other cores are free by now

    @property
    def sizes(self) -> list[int]:
        d = len(self.features)
        return [d, *self.hidden, d]

    def _matrix(self, df: DataFrame) -> DataFrame:
        """The columns of ``df`` without the features, plus ``x``: the scaled features."""
        return prepared(df, self.scaler, None).withColumn(
            "x", feature_array(self.features)).drop(*self.features)

    def fit(self, train_normal: DataFrame) -> "AutoencoderDetector":
        """Rounds of local mini-batch Adam: every partition makes one pass over its rows (in
        keyed-hash order) from the broadcast weights and moments; Spark averages the results by
        row count.  A partition holds at least ``ROWS_PER_PARTITION`` rows, so that a pass has
        enough steps; the validation loss of the averaged weights drives early stopping."""
        self.scaler = fit_feature_scaler(train_normal, self.features)
        data = self._matrix(train_normal).select("tx_id", "x").withColumn(
            "is_val", keyed_uniform("tx_id", f"val{self.seed}") < F.lit(self.validation))
        spark = data.sparkSession
        order = keyed_uniform("tx_id", f"order{self.seed}")
        parts = max(1, min(train_normal.count() // ROWS_PER_PARTITION,
                           8 * spark.sparkContext.defaultParallelism))
        data = data.repartition(parts, "tx_id").sortWithinPartitions(order)
        # a pass reads whole matrices: rows are taken apart once, not in every pass
        blocks = data.select(F.col("x").cast("array<float>"), "is_val").mapInArrow(_blocks, "shard int, x binary, is_val binary").persist(
            StorageLevel.MEMORY_AND_DISK_DESER)     # not serialised and compressed once more
        # a task makes the passes of several partitions one after the other, each on its own
        tasks = blocks.coalesce(min(parts, self.cores or spark.sparkContext.defaultParallelism))
        d = len(self.features)
        sizes, batch, rate = self.sizes, self.batch_size, self.learning_rate
        w = _flatten(_init_weights(sizes, self.seed))
        state, steps = np.concatenate([w, np.zeros(2 * len(w))]), 0
        best, best_w, bad = np.inf, w.copy(), 0
        out_schema = ("n_train long, loss_train double, n_val long, loss_val double, steps long, "
                      "state array<double>")
        try:
            limited = self.cores is not None
            for _ in range(self.epochs + 1):
                if limited and self.alone is not None and self.alone():
                    tasks, limited = blocks.coalesce(min(parts, spark.sparkContext.defaultParallelism)), False
                bc = spark.sparkContext.broadcast((state, steps))

                def one_pass(batches, bc=bc):
                    start, first = bc.value
                    net = _Network(sizes, batch)
                    frozen = _unflatten(start[:len(start) // 3].astype(np.float32), sizes)
                    rows = (block for part in batches for block in zip(
                        part.column(0).to_pylist(), *([v.as_buffer() for v in part.column(c)] for c in (1, 2))))
                    total, last = np.zeros(len(start)), first
                    n_train = n_val = 0
                    lt = lv = 0.0
                    for _, shard in groupby(rows, key=lambda block: block[0]):
                        own, step, nt = start.astype(np.float32), first, 0
                        for _, x, v in shard:
                            X, val = np.frombuffer(x, np.float32).reshape(-1, d), np.frombuffer(v, bool)
                            lv += net.loss(frozen, X[val])
                            n_val += int(val.sum())
                            X = X[~val]
                            for k in range(0, len(X), batch):
                                step += 1
                                lt += net.adam_step(own, X[k:k + batch], step, rate)
                            nt += len(X)
                        total += own.astype(float) * nt
                        n_train, last = n_train + nt, max(last, step)
                    # one vector a task, handed over as it lies in memory
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([n_train]), pa.array([lt]), pa.array([n_val]), pa.array([lv]), pa.array([last]),
                         pa.ListArray.from_arrays(pa.array([0, len(total)], pa.int32()), pa.array(total))],
                        names=["n_train", "loss_train", "n_val", "loss_val", "steps", "state"])

                # the sums are vector aggregates with partial merges; one vector reaches the driver
                tot = (tasks.mapInArrow(one_pass, out_schema)
                       .select("n_train", "loss_train", "n_val", "loss_val", "steps",
                               array_to_vector("state").alias("g"))
                       .agg(F.sum("n_train").alias("nt"), F.sum("loss_train").alias("lt"),
                            F.sum("n_val").alias("nv"), F.sum("loss_val").alias("lv"),
                            F.max("steps").alias("steps"), Summarizer.sum(F.col("g")).alias("g"))
                       .first())
                bc.unpersist()
                nt, nv = int(tot["nt"] or 0), int(tot["nv"] or 0)
                train_loss = (tot["lt"] or 0.0) / max(nt, 1)
                val_loss = (tot["lv"] or 0.0) / max(nv, 1) if nv else train_loss
                self.history.append((train_loss, val_loss))
                if not np.isfinite(train_loss):
                    raise FloatingPointError("autoencoder loss is not finite")
                if val_loss < best:
                    best, best_w, bad = val_loss, state[:len(w)].copy(), 0
                else:
                    bad += 1
                    if bad >= self.patience:
                        break
                state, steps = tot["g"].toArray() / max(nt, 1), int(tot["steps"] or 0)
            self.weights = best_w
            errs = materialize(self._errors(self._matrix(train_normal)).select("tx_id", "err"), "ae_train")
            self.threshold = _threshold(errs, self.quantile)
            self.train_errors = errs
        finally:
            blocks.unpersist()
        return self

    def with_quantile(self, name: str, quantile: float) -> "AutoencoderDetector":
        """The same trained network under another training quantile (no second fit)."""
        out = replace(self, name=name, quantile=quantile)
        out.threshold = _threshold(self.train_errors, quantile)
        return out

    def _errors(self, matrix: DataFrame) -> DataFrame:
        spark = matrix.sparkSession
        bc = spark.sparkContext.broadcast(self.weights)
        sizes = self.sizes

        @F.pandas_udf(T.DoubleType())
        def mse(x: pd.Series) -> pd.Series:
            if len(x) == 0:
                return pd.Series([], dtype=float)
            X = np.vstack(x.to_numpy()).astype(float)
            return pd.Series(_row_mse(_unflatten(bc.value, sizes), X))

        return matrix.select("*", mse(F.col("x")).alias("err"))

    def add_verdict(self, df: DataFrame, out: str) -> DataFrame:
        if self.weights is None:
            raise ValueError("model is not trained")
        e = F.col("err")
        errs = self._errors(self._matrix(df))
        return errs.withColumn(out, verdict(e, e > F.lit(self.threshold))).drop("x", "err")

    def score(self, df: DataFrame) -> DataFrame:
        return long_scores(self.add_verdict(df, "_v"), self.name, "_v")

    def latent(self, df: DataFrame) -> DataFrame:
        """The bottleneck activations (encoder half) as array<double>."""
        if self.weights is None:
            raise ValueError("model is not trained")
        spark = df.sparkSession
        bc = spark.sparkContext.broadcast(self.weights)
        sizes = self.sizes
        depth = int(np.argmin(sizes[1:-1])) + 1  # index of the narrowest layer

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def encode(x: pd.Series) -> pd.Series:
            if len(x) == 0:
                return pd.Series([], dtype=object)
            X = np.vstack(x.to_numpy()).astype(float)
            acts = _forward(_unflatten(bc.value, sizes), X)
            return pd.Series(list(acts[depth]))

        return self._matrix(df).select("tx_id", encode(F.col("x")).alias("latent"))

    def save(self, path: str) -> None:
        if self.weights is None:
            raise ValueError("model is not trained")
        save_scaler(path, self.scaler)
        save_meta(path, {"name": self.name, "hidden": list(self.hidden), "quantile": self.quantile,
                         "features": self.features, "weights": self.weights.tolist(),
                         "threshold": self.threshold, "seed": self.seed})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "AutoencoderDetector":
        m = load_meta(spark, path)
        return cls(name=m["name"], hidden=tuple(m["hidden"]), quantile=m["quantile"],
                   features=m["features"], scaler=load_scaler(spark, path),
                   weights=np.asarray(m["weights"]), threshold=m["threshold"], seed=m["seed"])

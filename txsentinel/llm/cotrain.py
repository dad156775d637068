"""Quality classifier by co-training.

Two views of a document, each with a logistic regression of its own:

* content: hashed word shares, distinct words, repeated words, word lengths, and layout (lines,
  cases, digits, punctuation and markup shares of the text);
* page metadata: language, source and stated length, nothing of the text.

Rounds: each classifier labels the unlabelled rows it is most confident about (a share per class
that follows the labels) and hands them to the *other* view's training rows; then both are fitted
on.  Afterwards each view is calibrated on labelled rows held back from training (Platt), the
calibrated log-odds are averaged, and the average is calibrated again.

The labelled rows are a bounded sample (``MAX_LABELLED``, by a hash of the identifier).  The
unlabelled pool is every other document: features are written once, and a round reads them a few
times on Spark.  How confident the most confident share is comes from a histogram of log-odds summed
over all partitions; a fit takes steps whose gradient and curvature are summed the same way.  The
curvature is that of a quadratic upper bound of the loss, so no step can overshoot.
Which label a row was handed follows from the rounds' weights and thresholds, so nothing is kept per
row.  Scoring covers every row in one pass over the texts without any shuffle.

Defined results: null text counts as empty, null metadata as its own value;
without labels of both kinds the score is the share of label 1 (1 without any
labels) and every row is kept when that share is not below the threshold;
repeated rows give repeated rows (a labelled identifier trains once); other columns pass through
``score_quality`` untouched unless they are named like its results.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txsentinel.llm.arrow_text import fresh_names, slices, text_buffer, word_hashes
from txsentinel.llm.toxic_crf import fit_logistic
from txsentinel.session import materialize

MAX_LABELLED = 12_000
ROUNDS = 4
#: Steps over the pool after every round, from the weights of the round before.
STEPS = 3
RIDGE = 2.0
#: Pseudo-labels a view hands over per round, as a share of the unlabelled pool, and the least
#: probability of such a label.
HANDED_SHARE, CONFIDENCE = 0.05, 0.95
#: Cells of the histogram of confident log-odds, from the least confident to ``TOP``.
CELLS, TOP = 1024, 30.0
_LEAST = float(np.log(CONFIDENCE / (1 - CONFIDENCE)))
#: Rows scored below this probability of good quality are rejected.
THRESHOLD = 0.5

WORD_BUCKETS, META_BUCKETS = 64, 24

# Character classes of the layout columns
_CLASSES = ["other", "upper", "lower", "digit", "blank", "newline", ".,;:", "!", "?", "#$%&*+=@^~_",
            "|", "<>{}[]()\\/", "'\"-", "high"]
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[[32, 9]], _CLASS[10] = 1, 2, 3, 4, 5
for _k in range(6, 13):
    _CLASS[list(_CLASSES[_k].encode())] = _k
_CLASS[128:] = 13

CONTENT_SIZE = WORD_BUCKETS + 6 + len(_CLASSES) + 2
META_SIZE = 2 * META_BUCKETS + 2
SIZE = CONTENT_SIZE + META_SIZE
_ADDED = ("score", "content_score", "metadata_score", "kept")


def features(buf: np.ndarray, off: np.ndarray, lang: list, source: list, stated: list) -> np.ndarray:
    """float32 rows of both views (content columns first)."""
    rows = len(off) - 1
    words, doc = word_hashes(buf, off)
    n = np.bincount(doc, minlength=rows).astype(float)
    safe = np.maximum(n, 1)
    size = np.diff(off).astype(float)
    bucket = (words % np.uint64(WORD_BUCKETS)).astype(np.int64)
    bag = np.bincount(doc * WORD_BUCKETS + bucket, minlength=rows * WORD_BUCKETS)
    bag = np.sqrt(bag.reshape(rows, WORD_BUCKETS) / safe[:, None])
    order = np.lexsort((words, doc))
    w, d = words[order], doc[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(w)))
    distinct = np.bincount(d[at], minlength=rows)
    most = np.zeros(rows)
    np.maximum.at(most, d[at], counts)
    content = np.column_stack([
        bag, distinct / safe, np.log1p(n) - np.log1p(distinct), most / safe, np.log1p(n),
        np.minimum(size / safe, 50) / 10, (distinct <= 3).astype(float)])
    kind = _CLASS[buf].astype(np.int64)
    owner = np.repeat(np.arange(rows), np.diff(off))
    layout = np.bincount(owner * len(_CLASSES) + kind, minlength=rows * len(_CLASSES))
    layout = layout.reshape(rows, len(_CLASSES))
    lines = layout[:, 5] + 1.0
    meta = np.zeros((rows, 2 * META_BUCKETS + 2))
    for k, values in enumerate((lang, source)):
        for i, v in enumerate(values):
            code = 0 if v is None else 1 + zlib.crc32(str(v).encode()) % (META_BUCKETS - 1)
            meta[i, k * META_BUCKETS + code] = 1.0
    chars = np.array([np.nan if c is None else float(c) for c in stated])
    meta[:, -2] = np.where(np.isnan(chars), 0, np.log1p(np.maximum(np.nan_to_num(chars), 0)))
    meta[:, -1] = np.isnan(chars)
    return np.column_stack([content, layout / np.maximum(size, 1)[:, None], np.log(lines),
                            np.log1p(size / lines), meta]).astype(np.float32)


@dataclass
class CoTrained:
    """Standardised logistic views, their calibrations and the joint one."""

    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: tuple[np.ndarray, np.ndarray] | None = None
    calibrations: tuple[np.ndarray, np.ndarray] | None = None
    joint: np.ndarray | None = None

    def views(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = (x - self.mean) / self.scale
        return _with_one(z[:, :CONTENT_SIZE]), _with_one(z[:, CONTENT_SIZE:])

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality: joint, content view, metadata view."""
        if self.weights is None:
            flat = np.full(len(x), self.prior)
            return flat, flat, flat
        odds = [_platt_odds(c, v @ w)
                for c, v, w in zip(self.calibrations, self.views(x), self.weights)]
        return (_sigmoid(_platt_odds(self.joint, (odds[0] + odds[1]) / 2)),
                _sigmoid(odds[0]), _sigmoid(odds[1]))


def _with_one(x):
    return np.column_stack([np.ones(len(x)), x])


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _platt_odds(c: np.ndarray, z: np.ndarray) -> np.ndarray:
    return c[0] + c[1] * np.clip(z, -30, 30)


def _platt(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Intercept and (positive) slope; targets smoothed by one pseudo-row per class."""
    high, low = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    c = fit_logistic(_with_one(np.clip(z, -30, 30)), np.where(y > 0, high, low), ridge=1e-2)
    return c if c[1] > 0 else np.array([np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)), 0.0])


class ArrayPool:
    """Unlabelled feature rows in memory."""

    def __init__(self, x: np.ndarray):
        self.x = x

    def total(self, part) -> np.ndarray | None:
        return part(self.x) if len(self.x) else None


class TablePool:
    """Unlabelled feature rows in a table (x binary, float32); sums are taken on Spark."""

    def __init__(self, rows: DataFrame):
        self.rows = rows.select("x")

    def total(self, part) -> np.ndarray | None:
        """Sum over all rows of ``part`` (feature rows -> vector); one vector reaches the driver."""
        def run(batches):
            held = None
            for batch in batches:
                raw, _ = text_buffer(batch.column(0))
                if len(raw):
                    mine = part(raw.view(np.float32).reshape(-1, SIZE).astype(float))
                    held = mine if held is None else held + mine
            if held is not None:
                yield pa.RecordBatch.from_pydict({"v": pa.array([held], pa.list_(pa.float64()))})

        sums = self.rows.mapInArrow(run, "v array<double>").select(array_to_vector("v").alias("v"))
        found = sums.agg(F.count(F.lit(1)).alias("n"), Summarizer.sum(F.col("v")).alias("v")).first()
        return found["v"].toArray() if found["n"] else None


def given_labels(views: tuple, history: list) -> np.ndarray:
    """What a view was handed for every row: 1, 0 or -1 (nothing).  ``history``: per round the giving
    view, its weights, and the log-odds from which it gave label 1 and label 0; the first label stays."""
    out = np.full(len(views[0]), -1)
    for giver, w, high, low in history:
        z = views[giver] @ w
        free = out < 0
        out[free & (z >= high)] = 1
        out[free & (z <= low)] = 0
    return out


def confident(views: tuple, weights: list, history: list) -> np.ndarray:
    """Rows of the pool, then per view and class counts of its confident log-odds among the rows that
    the other view has not been handed."""
    out = [np.array([float(len(views[0]))])]
    for v in (0, 1):
        z = (views[v] @ weights[v])[given_labels(views, history[1 - v]) < 0]
        for sure in (z, -z):
            cell = (np.minimum(sure[sure >= _LEAST], TOP) - _LEAST) / (TOP - _LEAST) * CELLS
            out.append(np.bincount(np.minimum(cell.astype(int), CELLS - 1), minlength=CELLS).astype(float))
    return np.concatenate(out)


def least_sure(counts: np.ndarray, quota: float) -> float:
    """The log-odds from which at most ``quota`` rows are handed over (the top cell at least)."""
    above = np.cumsum(counts[::-1])[::-1]
    if not above[0]:
        return float("inf")
    fits = np.flatnonzero(above <= quota)
    top = int(np.flatnonzero(counts)[-1])
    return _LEAST + min(int(fits[0]) if len(fits) else top, top) * (TOP - _LEAST) / CELLS


def _slopes(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log-likelihood at w, and the curvature of its quadratic lower bound that
    touches it there: (sigmoid(z) - 1/2) / z per row, never below the true one."""
    z = x @ w
    z = np.where(np.abs(z) < 1e-6, 1e-6, z)
    bound = (_sigmoid(z) - 0.5) / z
    return x.T @ (y - _sigmoid(z)), (x * bound[:, None]).T @ x


def step_sums(views: tuple, weights: list, history: list) -> np.ndarray:
    """Gradient and curvature of both views over the rows they were handed, as one vector."""
    out = []
    for v in (0, 1):
        label = given_labels(views, history[v])
        gradient, curvature = _slopes(views[v][label >= 0], label[label >= 0], weights[v])
        out += [gradient, curvature.ravel()]
    return np.concatenate(out)


def co_train(x: np.ndarray, y: np.ndarray, pool, rounds: int = ROUNDS,
             prior: float | None = None) -> CoTrained:
    """Fit on labelled rows (x, y) and a pool of unlabelled ones (ArrayPool, TablePool)."""
    prior = float(y.mean()) if prior is None and len(y) else 1.0 if prior is None else prior
    if not len(y) or y.min() == y.max():
        return CoTrained(prior)
    model = CoTrained(prior, x.mean(0), np.maximum(x.std(0), 1e-3))
    # every fourth labelled row of either class is held back for calibration
    held = np.zeros(len(y), bool)
    for c in (0, 1):
        own = np.flatnonzero(y == c)
        held[own[3::4]] = True
    if not (y[held] == 0).any() or not (y[held] == 1).any():
        held = np.ones(len(y), bool)
        train = held
    else:
        train = ~held
    views = model.views(x)
    own = [view[train] for view in views]
    weights = [fit_logistic(view, y[train], ridge=RIDGE, rounds=12) for view in own]
    history: list[list] = [[], []]
    for _ in range(rounds):
        counts = pool.total(lambda rows: confident(model.views(rows), weights, history))
        if counts is None:
            break
        quota = counts[0] * HANDED_SHARE
        sides = counts[1:].reshape(2, 2, CELLS)
        for v in (0, 1):
            high = least_sure(sides[v][0], max(1.0, quota * prior))
            low = -least_sure(sides[v][1], max(1.0, quota * (1 - prior)))
            history[1 - v].append((v, weights[v], high, low))
        for _ in range(STEPS):
            sums = pool.total(lambda rows: step_sums(model.views(rows), weights, history))
            weights = [_stepped(w, view, y[train], part) for w, view, part in zip(weights, own, _parts(sums, own))]
    model.weights = tuple(weights)
    odds = [views[v][held] @ weights[v] for v in (0, 1)]
    model.calibrations = tuple(_platt(o, y[held]) for o in odds)
    both = sum(_platt_odds(c, o) for c, o in zip(model.calibrations, odds)) / 2
    model.joint = _platt(both, y[held])
    return model


def _parts(sums: np.ndarray, views: list):
    """(gradient, curvature) of each view out of ``step_sums``."""
    at = 0
    for d in (view.shape[1] for view in views):
        yield sums[at:at + d], sums[at + d:at + d + d * d].reshape(d, d)
        at += d + d * d


def _stepped(w: np.ndarray, x: np.ndarray, y: np.ndarray, handed: tuple) -> np.ndarray:
    """One step over the labelled rows (x, y) and the handed ones' sums; the penalised loss falls."""
    penalty = np.full(len(w), RIDGE)
    penalty[0] = 1e-6
    gradient, curvature = _slopes(x, y, w)
    return w + np.linalg.solve(curvature + handed[1] + np.diag(penalty), gradient + handed[0] - penalty * w)


def _map(df: DataFrame, text: str, lang: str, source: str, chars: str, carried, extra, finish):
    """mapInArrow over ``carried`` columns and the features; ``finish`` makes the new columns."""
    def pick(name, kind):
        return (F.col(f"`{name}`") if name in df.columns else F.lit(None)).cast(kind)

    own = fresh_names([f.name for f in carried], "lang", "source", "chars", "text")
    frame = df.select(*[F.col(f"`{f.name}`") for f in carried], *[
        pick(name, kind).alias(alias) for name, kind, alias in zip(
            (lang, source, chars, text), ("string", "string", "double", "string"), own)])
    keep = len(carried)

    def run(batches):
        for batch in batches:
            for rows, buf, off in slices(batch, own[3]):
                x = features(buf, off, *(rows.column(keep + k).to_pylist() for k in range(3)))
                yield pa.RecordBatch.from_arrays(rows.columns[:keep] + finish(x),
                                                 names=rows.schema.names[:keep] + [f.name for f in extra])

    return frame.mapInArrow(run, T.StructType([*carried, *extra]))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED,
        rounds: int = ROUNDS, label: str = "quality") -> CoTrained:
    """Fit from documents (doc_id, text, lang, source, n_chars) and labels (doc_id, quality)."""
    marked = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
              .groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y")))
    share = marked.agg(F.avg("y")).first()[0]
    if share is None or share in (0.0, 1.0):
        return CoTrained(1.0 if share is None else share)
    # a bounded sample of labels, so it may be collected and broadcast
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).collect()
    known = docs.sparkSession.createDataFrame([(r["doc_id"], r["y"]) for r in chosen], "id long, y int")
    docs = docs.select(*[c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in docs.columns])
    docs = docs.join(F.broadcast(known), docs["doc_id"].cast("long") == known["id"], "left").drop("id")
    carried = [docs.schema["doc_id"], docs.schema["y"]]
    rows = materialize(_map(docs, "text", "lang", "source", "n_chars", carried, [T.StructField("x", T.BinaryType())],
                            lambda x: [pa.array([r.tobytes() for r in x], pa.binary())]), "quality-features")
    own = rows.where("y IS NOT NULL").groupBy("doc_id").agg(F.first("y").alias("y"), F.min("x").alias("x")).collect()
    own = sorted((r["doc_id"], r["y"], bytes(r["x"])) for r in own)
    x = np.array([np.frombuffer(b, np.float32) for _, _, b in own], np.float32).reshape(-1, SIZE).astype(float)
    return co_train(x, np.array([y for _, y, _ in own], float), TablePool(rows.where("y IS NULL")), rounds, share)


def score_quality(docs: DataFrame, model: CoTrained, threshold: float = THRESHOLD,
                  carry: list[str] | None = None, text: str = "text", lang: str = "lang",
                  source: str = "source", chars: str = "n_chars") -> DataFrame:
    """``carry`` columns (all by default) plus score, content_score, metadata_score, kept."""
    names = docs.columns if carry is None else carry
    carried = [f for f in docs.schema.fields if f.name in names and f.name not in _ADDED]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    extra = [T.StructField(n, T.DoubleType()) for n in _ADDED[:3]] + [T.StructField("kept", T.BooleanType())]

    def finish(x):
        joint, content, meta = shared.value.scores(x.astype(float))
        return [*(pa.array(s, pa.float64()) for s in (joint, content, meta)),
                pa.array(joint >= threshold, pa.bool_())]

    return _map(docs, text, lang, source, chars, carried, extra, finish)

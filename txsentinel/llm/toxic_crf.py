"""Toxic span tagging with a linear-chain conditional random field.

* Labelled tokens: from labelled training documents, words and word beginnings
  that stand out in toxic documents (G-squared on document counts, above what chance
  gives to any of the words tested) mark
  the tokens of toxic documents as toxic; all other tokens are clean.
* Model: two tags; a token's score sums weights of its word, its beginnings of
  4 to 7 bytes and its neighbours; a 2 x 2 transition table and start scores
  link neighbours.  Trained by gradient ascent on the conditional likelihood of
  whole documents (exact expectations by forward-backward).
* Scoring: forward-backward marginals of every token of the whole text.  Spans
  are runs of tokens whose marginal is at least one half, given as byte
  offsets.  A document's score is a logistic function of its largest marginal
  and its expected number of toxic tokens, calibrated on the training documents.

The model is fitted on a bounded sample, ``MAX_LABELLED`` training documents,
chosen by a hash of their identifier; scoring covers every row.  The chain runs
over whole batches at once: 2 x 2 matrix products in blocks, so its cost per
token does not depend on how long a text is.

Inputs of a score are the text alone.  Defined results: null and empty texts
score as a document without tokens; without labels of both kinds every score
is the share of toxic labels (0 without labels); repeated rows give repeated
rows; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txsentinel.llm.arrow_text import LOWER, prefix_hash, range_hash, slices, word_spans

#: Documents the model is fitted on, at most: toxic and clean half each as far as there are.
MAX_LABELLED = 3000
#: Evidence that makes a word, beginning or neighbour a feature (G-squared).
FEATURE_G2 = 10.0
EPOCHS = 40
#: Tokens that one forward-backward call of the training holds.
TRAIN_TOKENS = 200_000
#: Documents of the rarer class from which on some are held back for the calibration.
MIN_HELD = 100

_U64 = np.uint64
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Salts that keep the kinds of feature apart: word, beginnings, previous and next word.
BEGINNINGS = (4, 5, 6, 7)
_SALT = [_U64(0x9E3779B97F4A7C15 * (k + 1) & (2**64 - 1)) for k in range(7)]


def token_spans(buf: np.ndarray, off: np.ndarray):
    """(lower-cased bytes, start, end, document index) of runs of letters and digits."""
    low = LOWER[buf]
    start, end, doc = word_spans(low, off, _SEPARATOR[low])
    return low, start, end, doc


def token_features(low: np.ndarray, start: np.ndarray, end: np.ndarray,
                   doc: np.ndarray) -> list[np.ndarray]:
    """One array of 64-bit feature hashes per kind; 0 stands for none."""
    prefix = prefix_hash(low)
    word = range_hash(prefix, start, end)
    out = [word ^ _SALT[0]]
    for k, n in enumerate(BEGINNINGS):
        begin = range_hash(prefix, start, np.minimum(start + n, end)) ^ _SALT[1 + k]
        out.append(np.where(end - start > n, begin, _U64(0)))
    before, after = np.zeros(len(word), _U64), np.zeros(len(word), _U64)
    same = doc[1:] == doc[:-1]
    before[1:] = np.where(same, word[:-1] ^ _SALT[5], _U64(0))
    after[:-1] = np.where(same, word[1:] ^ _SALT[6], _U64(0))
    return [*out, before, after]


# ---- the chain: all documents of a batch in one sequence, restarted by rank-one matrices ----

_BLOCK = 64


def _ratios(a00, a01, a10, a11) -> np.ndarray:
    """Running ratios r_i = (a01 + a11 r_{i-1}) / (a00 + a10 r_{i-1}), r_{-1} = 0, by blocks."""
    n = len(a00)
    if n <= _BLOCK:
        out = np.empty(n)
        r = 0.0
        for i in range(n):
            r = (a01[i] + a11[i] * r) / (a00[i] + a10[i] * r)
            out[i] = r
        return out
    blocks = -(-n // _BLOCK)
    pad = blocks * _BLOCK - n

    def grid(x, fill):
        return np.concatenate([x, np.full(pad, fill)]).reshape(blocks, _BLOCK).T.copy()

    m = [grid(a00, 1.0), grid(a01, 0.0), grid(a10, 0.0), grid(a11, 1.0)]
    p00, p01, p10, p11 = (x[0].copy() for x in m)
    for i in range(1, _BLOCK):
        p00, p01, p10, p11 = (p00 * m[0][i] + p01 * m[2][i], p00 * m[1][i] + p01 * m[3][i],
                              p10 * m[0][i] + p11 * m[2][i], p10 * m[1][i] + p11 * m[3][i])
        if i % 8 == 7:
            scale = 1.0 / (p00 + p01 + p10 + p11)
            p00, p01, p10, p11 = p00 * scale, p01 * scale, p10 * scale, p11 * scale
    ends = _ratios(p00, p01, p10, p11)
    r = np.concatenate([[0.0], ends[:-1]])
    out = np.empty((_BLOCK, blocks))
    for i in range(_BLOCK):
        r = (m[1][i] + m[3][i] * r) / (m[0][i] + m[2][i] * r)
        out[i] = r
    return out.T.reshape(-1)[:n]


def forward_backward(logit: np.ndarray, first: np.ndarray, trans: np.ndarray, begin: float):
    """Marginals of tag 1, and expected (0->1, 1->0, 1->1) transitions and toxic starts.

    ``logit``: score of tag 1 over tag 0 per token; ``first``: starts of documents;
    ``trans``: log weights [[0->0, 0->1], [1->0, 1->1]]; ``begin``: log weight of starting with 1.
    """
    e = np.exp(np.clip(logit, -12, 12))
    w = np.exp(trans)
    t00 = np.where(first, 1.0, w[0, 0])
    t01 = np.where(first, np.exp(begin), w[0, 1])
    t10 = np.where(first, 1.0, w[1, 0])
    t11 = np.where(first, np.exp(begin), w[1, 1])
    r = _ratios(t00, t01 * e, t10, t11 * e)
    # q_i from token i + 1 back to i; the last token of a document gets 1 from the rank-one start
    b00, b01 = np.append(t00[1:], 1.0), np.append(t01[1:] * e[1:], 1.0)
    b10, b11 = np.append(t10[1:], 1.0), np.append(t11[1:] * e[1:], 1.0)
    q = _ratios(b00[::-1], b10[::-1], b01[::-1], b11[::-1])[::-1]
    marginal = r * q / (1.0 + r * q)
    inner = np.flatnonzero(~first)
    before = r[inner - 1]
    x00, x01 = t00[inner], t01[inner] * e[inner] * q[inner]
    x10, x11 = before * t10[inner], before * t11[inner] * e[inner] * q[inner]
    total = x00 + x01 + x10 + x11
    expected = np.array([(x01 / total).sum(), (x10 / total).sum(), (x11 / total).sum()])
    return marginal, expected


@dataclass
class CrfModel:
    """Feature hashes (sorted) with weights, transition scores, document calibration."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, _U64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -8.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    begin: float = 0.0
    calibration: np.ndarray | None = None
    prior: float = 0.0

    def __post_init__(self):
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.keys & _U64((1 << 20) - 1)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, feature numbers) of the hashes that are features."""
        at = np.flatnonzero(self.seen[hashes & _U64((1 << 20) - 1)])
        slot = np.searchsorted(self.keys, hashes[at])
        hit = slot < len(self.keys)
        hit[hit] = self.keys[slot[hit]] == hashes[at[hit]]
        return at[hit], slot[hit]

    def logits(self, features: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(features[0]), self.bias)
        for hashes in features:
            at, slot = self.find(hashes)
            out[at] += self.weights[slot]
        return out

    def marginals(self, buf: np.ndarray, off: np.ndarray):
        """(start, end, document, marginal) of every token."""
        low, start, end, doc = token_spans(buf, off)
        if not len(start):
            return start, end, doc, np.zeros(0)
        first = np.ones(len(doc), bool)
        first[1:] = doc[1:] != doc[:-1]
        p, _ = forward_backward(self.logits(token_features(low, start, end, doc)), first,
                                self.trans, self.begin)
        return start, end, doc, p

    def scores(self, doc: np.ndarray, p: np.ndarray, rows: int) -> np.ndarray:
        if self.calibration is None:
            return np.full(rows, self.prior)
        z = document_evidence(doc, p, rows) @ self.calibration
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def document_evidence(doc: np.ndarray, p: np.ndarray, rows: int) -> np.ndarray:
    """1, largest marginal, log(1 + expected toxic tokens) of every document."""
    top = np.zeros(rows)
    np.maximum.at(top, doc, p)
    expected = np.bincount(doc, p, rows) if len(doc) else np.zeros(rows)
    return np.column_stack([np.ones(rows), top, np.log1p(expected)])


def g_squared(a: np.ndarray, n1: int, b: np.ndarray, n0: int) -> np.ndarray:
    """Signed log-likelihood ratio of document counts a of n1 against b of n0."""
    def part(o, e):
        return np.where(o > 0, o * np.log(np.maximum(o, 1e-12) / e), 0.0)

    share = np.clip((a + b) / (n1 + n0), 1e-12, 1 - 1e-12)
    g = 2 * (part(a, n1 * share) + part(n1 - a, n1 * (1 - share))
             + part(b, n0 * share) + part(n0 - b, n0 * (1 - share)))
    return np.where(a * n0 >= b * n1, g, -g)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30,
                 weight: np.ndarray | None = None) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps (the first column is the intercept)."""
    w = np.zeros(x.shape[1])
    weight = np.ones(len(x)) if weight is None else weight
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (y - p)) - penalty * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, grad)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(texts: list[str], toxic: list[int], prior: float, epochs: int = EPOCHS) -> CrfModel:
    """Fit on labelled documents (driver side, bounded sample)."""
    y_doc = np.asarray(toxic, bool)
    if not len(texts) or y_doc.all() or not y_doc.any():
        return CrfModel(prior=prior)
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"])
    parts, seen = [], 0
    for rows, buf, off in slices(batch):
        low, start, end, doc = token_spans(buf, off)
        parts.append((doc + seen, *token_features(low, start, end, doc)))
        seen += rows.num_rows
    doc, *features = (np.concatenate(p) for p in zip(*parts))
    del parts
    # every fourth document of either class calibrates the score, if there are enough of them
    held = np.zeros(len(y_doc), bool)
    if min(y_doc.sum(), (~y_doc).sum()) >= MIN_HELD:
        for c in (True, False):
            held[np.flatnonzero(y_doc == c)[3::4]] = True
    own = ~held[doc]
    doc, features = doc[own], [f[own] for f in features]
    n1, n0 = int(y_doc[~held].sum()), int((~y_doc[~held]).sum())
    # document counts of each feature, toxic and clean
    keys, g2, kinds, tested = [], [], [], 0
    for kind, hashes in enumerate(features):
        order = np.lexsort((doc, hashes))
        h, d = hashes[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[new], d[new]
        unique, at = np.unique(h, return_inverse=True)
        a = np.bincount(at, y_doc[d], len(unique))
        b = np.bincount(at, ~y_doc[d], len(unique))
        g = g_squared(a, n1, b, n0)
        tested += len(unique) if kind <= len(BEGINNINGS) else 0
        use = (np.abs(g) >= FEATURE_G2) & (unique != 0)
        keys.append(unique[use])
        g2.append(g[use])
        kinds.append(np.full(use.sum(), kind))
    keys, g2, kinds = np.concatenate(keys), np.concatenate(g2), np.concatenate(kinds)
    order = np.argsort(keys)
    keys, g2, kinds = keys[order], g2[order], kinds[order]
    model = CrfModel(keys, np.zeros(len(keys)), prior=prior)
    found = [tuple(a.astype(np.int32) for a in model.find(hashes)) for hashes in features]
    del features
    # evidence that chance gives to less than one of the words and beginnings tested
    strong = 2 * np.log(max(tested, 2))
    # labelled tokens: strong evidence of the token's own word or beginning, in a toxic document
    y = np.zeros(len(doc))
    for at, slot in found[:1 + len(BEGINNINGS)]:
        y[at[(g2[slot] >= strong) & (kinds[slot] <= len(BEGINNINGS))]] = 1.0
    y *= y_doc[doc]
    first = np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    # whole documents at a time, so that a step's arrays stay small
    heads = np.flatnonzero(first)
    cuts = [*heads[np.unique(np.searchsorted(heads, np.arange(0, len(doc), TRAIN_TOKENS)))
                   .clip(max=len(heads) - 1)].tolist(), len(doc)]
    inner = np.flatnonzero(~first)
    was, now = y[inner - 1], y[inner]
    observed = np.array([((1 - was) * now).sum(), (was * (1 - now)).sum(), (was * now).sum()])
    # gradient ascent (Adam) on the penalised conditional likelihood
    size = len(keys) + 5                       # weights, bias, three transitions, start
    theta, m1, m2 = np.zeros(size), np.zeros(size), np.zeros(size)
    theta[len(keys)] = -4.0
    for step in range(1, epochs + 1):
        model.weights, model.bias = theta[:-5], theta[-5]
        model.trans = np.array([[0.0, theta[-4]], [theta[-3], theta[-2]]])
        model.begin = theta[-1]
        logit = np.full(len(doc), model.bias)
        for at, slot in found:
            logit[at] += model.weights[slot]
        p, expected = np.empty(len(doc)), np.zeros(3)
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                p[a:b], moved = forward_backward(logit[a:b], first[a:b], model.trans, model.begin)
                expected += moved
        error = y - p
        grad = np.zeros(size)
        for at, slot in found:
            grad[:-5] += np.bincount(slot, error[at], len(keys))
        grad[-5] = error.sum()
        grad[-4:-1] = observed - expected
        grad[-1] = error[first].sum()
        grad -= 0.5 * np.append(theta[:-5], np.zeros(5))
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.99 * m2 + 0.01 * grad * grad
        theta = theta + 0.3 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    used = np.abs(theta[:-5]) >= 0.02
    model = CrfModel(keys[used], theta[:-5][used], theta[-5],
                     np.array([[0.0, theta[-4]], [theta[-3], theta[-2]]]), theta[-1], prior=prior)
    evidence = []
    for rows, buf, off in slices(batch):
        _, _, doc, p = model.marginals(buf, off)
        evidence.append(document_evidence(doc, p, rows.num_rows))
    judged = held if held.any() else np.ones(len(y_doc), bool)
    evidence, y = np.vstack(evidence)[judged], y_doc[judged].astype(float)
    # the sample is balanced: weights bring the classes back to their shares among the labels
    share = np.clip(prior, 1e-3, 1 - 1e-3)
    weight = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
    model.calibration = fit_logistic(evidence, y, 0.1, weight=weight)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, allowed, max_labelled: int = MAX_LABELLED,
                    label: str = "toxic"):
    """(texts, labels, share of label 1): up to half of the bound from either class, by hash order."""
    rows = (labels.where(allowed & F.col(label).isNotNull())
            .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("__y")))
    counts = {r["__y"]: r["count"] for r in rows.groupBy("__y").count().collect()}
    total = sum(counts.values())
    if not total:
        return [], [], 0.0
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = None
    for y in (0, 1):
        room = max_labelled // 2 if counts.get(1 - y, 0) >= max_labelled // 2 \
            else max_labelled - counts.get(1 - y, 0)
        part = rows.where(F.col("__y") == y).orderBy(*order).limit(room)
        picked = part if picked is None else picked.unionByName(part)
    # at most max_labelled rows: bounded, so it may be broadcast
    sample = (docs.select("doc_id", F.col("text").cast("string").alias("text"))
              .join(F.broadcast(picked), "doc_id").collect())
    sample = sorted(sample, key=lambda r: (r["doc_id"], r["text"] or ""))
    return ([r["text"] or "" for r in sample], [r["__y"] for r in sample], counts.get(1, 0) / total)


def fit(docs: DataFrame, labels: DataFrame, allowed=None,
        max_labelled: int = MAX_LABELLED) -> CrfModel:
    """Fit on the labelled rows for which ``allowed`` (a condition on doc_id) holds."""
    allowed = F.lit(True) if allowed is None else allowed
    return train(*labelled_sample(docs, labels, allowed, max_labelled))


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()),
                                   T.StructField("end", T.LongType())]))
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def tag(docs: DataFrame, model: CrfModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, spans (byte offsets of toxic runs) of every row; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name == doc_id]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()),
                           T.StructField("spans", _SPANS)])
    frame = docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches):
        crf = shared.value
        for batch in batches:
            for rows, buf, off in slices(batch, "__text"):
                start, end, doc, p = crf.marginals(buf, off)
                spans: list[list] = [[] for _ in range(rows.num_rows)]
                last = -2
                for i in np.flatnonzero(p >= 0.5).tolist():
                    d = int(doc[i])
                    if i == last + 1 and spans[d]:
                        spans[d][-1]["end"] = int(end[i] - off[d])
                    else:
                        spans[d].append({"start": int(start[i] - off[d]), "end": int(end[i] - off[d])})
                    last = i
                score = crf.scores(doc, p, rows.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(score, pa.float64()), pa.array(spans, _SPANS_ARROW)],
                    names=[doc_id, "score", "spans"])

    return frame.mapInArrow(run, schema)

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from txsentinel.llm import toxic_crf as tc


@pytest.mark.parametrize("seed", range(4))
def test_forward_backward_equals_enumeration(seed):
    r = np.random.default_rng(seed)
    sizes = [3, 1, 6, 2]
    first = np.zeros(sum(sizes), bool)
    first[np.cumsum([0, *sizes[:-1]])] = True
    logit, begin = r.normal(size=len(first)), r.normal()
    trans = np.array([[0.0, r.normal()], [r.normal(), r.normal()]])
    got, expected = tc.forward_backward(logit, first, trans, begin)
    want, pairs, at = [], np.zeros((2, 2)), 0
    for n in sizes:
        total, tags, moves = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=n):
            s = y[0] * begin + sum(logit[at + i] * y[i] for i in range(n))
            s += sum(trans[a, b] for a, b in zip(y, y[1:]))
            total += np.exp(s)
            tags += np.exp(s) * np.array(y)
            for a, b in zip(y, y[1:]):
                moves[a, b] += np.exp(s)
        want += (tags / total).tolist()
        pairs += moves / total
        at += n
    assert np.allclose(got, want) and np.allclose(expected, [pairs[0, 1], pairs[1, 0], pairs[1, 1]])


def test_long_chains_agree_with_a_plain_loop():
    r = np.random.default_rng(0)
    n = 5000
    first = r.random(n) < 0.01
    first[0] = True
    logit = r.normal(scale=4, size=n)
    trans = np.array([[0.0, -1.0], [0.5, 1.5]])
    got, _ = tc.forward_backward(logit, first, trans, -1.0)
    parts = [tc.forward_backward(logit[a:b], first[a:b], trans, -1.0)[0]
             for a, b in itertools.pairwise([*np.flatnonzero(first), n])]
    assert np.allclose(got, np.concatenate(parts))


BAD = ["idiot", "stupid", "moronic", "moronesque"]


def corpus(n=1500):
    r = random.Random(4)
    vocab = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 8))) for _ in range(500)]
    docs, labels = [], []
    for d in range(n):
        words, toxic = r.choices(vocab, k=r.randint(3, 80)), int(r.random() < 0.25)
        if toxic:
            for _ in range(r.randint(2, 5)):
                words.insert(r.randint(0, len(words)), r.choice(BAD[:2] + ["moron" + "".join(r.choices("xyz", k=3))]).title())
        docs.append((d, " ".join(words)))
        labels.append((d, 1, toxic))
    return docs, labels


def test_held_out_accuracy_spans_and_edges(spark):
    docs, labels = corpus()
    extra = [(9000, None), (9001, ""), (9002, "word " * 40_000 + "idiot!"), (None, "stupid idiot"), docs[0]]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs + extra], "doc_id long, text string, score int")
    model = tc.fit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
                   F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    rows = tc.tag(frame, model).withColumn(
        "held", F.crc32(F.col("doc_id").cast("string")) % 4 == 2).collect()
    assert len(rows) == len(docs) + len(extra)
    toxic = {d: t for d, _, t in labels}
    held = [r for r in rows if r["held"] and r["doc_id"] in toxic]
    assert np.mean([(r["score"] >= 0.3) == bool(toxic[r["doc_id"]]) for r in held]) > 0.97
    text = dict(docs + extra)
    for r in rows:
        assert 0 <= r["score"] <= 1
        for s in r["spans"]:
            body = (text[r["doc_id"]] or "").encode()[s["start"]:s["end"]].decode().lower()
            assert any(w in body for w in ("idiot", "stupid", "moron")), body
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[9000]["score"] == by_id[9001]["score"] < 0.3 and by_id[9000]["spans"] == []
    assert by_id[9002]["spans"][-1]["end"] == 5 * 40_000 + 5
    tagged = [by_id[d] for d, _, t in labels if t]
    assert np.mean([len(r["spans"]) > 0 for r in tagged]) > 0.95


@pytest.mark.parametrize("labels, score", [([], 0.0), ([(1, 1, 0)], 0.0), ([(1, 1, 1)], 1.0)])
def test_without_both_classes(spark, labels, score):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = tc.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert [r["score"] for r in tc.tag(docs, model).collect()] == [score] * 2
    assert tc.tag(docs.where("false"), model).count() == 0

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from txsentinel.llm import hpylm


def corpus():
    r = random.Random(5)
    vocab = ["w%d" % k for k in range(300)]
    follow = collections.defaultdict(lambda: r.sample(vocab, 4))
    rows = []
    for d in range(400):
        w, words = r.choice(vocab), []
        for _ in range(r.randint(0, 120)):
            words.append(w.upper() if r.random() < 0.1 else w)
            w = r.choice(follow[w]) if r.random() < 0.85 else r.choice(vocab + ["rare%d" % r.randrange(10**6)])
        rows.append((d, " ".join(words)))
    return rows + [(400, None), (401, ""), (401, ""), (None, "w1 w2"), (402, "w1 " * 20_000)]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 2


def tokens(text):
    return (text or "").encode().lower().split() + [None]


@pytest.mark.parametrize("bucket, dictionary", [(10**6, 10**6), (3000, 40)])  # one bucket; sections, rare words
def test_counts_are_exact_and_scores_beat_unigrams(spark, bucket, dictionary):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 0.5) for d, t in rows], "doc_id long, text string, score double").repartition(5)
    got = hpylm.score_corpus(docs, held_out(), bucket_tokens=bucket, dictionary_size=dictionary).collect()
    assert len(got) == len(rows)
    count = collections.Counter(w for d, t in rows if not held(d) for w in tokens(t))
    total, types = sum(count.values()), len(count)
    by_id = collections.defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r)
    for d, t in rows:
        r, own = by_id[d][0], tokens(t)
        base = sum(math.log10((count[w] + 1) / (total + types + 1)) for w in own)
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held(d), len(own), total)
        assert r["n_known"] == sum(count[w] > 0 for w in own)
        assert r["base_score"] == pytest.approx(base, abs=1e-6)
        assert r["score"] < 0 and math.isfinite(r["score"])
    out = [r for r in got if r["held_out"] and r["n_tokens"] < 1000]
    assert sum(r["score"] for r in out) > 0.8 * sum(r["base_score"] for r in out)


def test_probabilities_of_a_context_sum_to_one():
    rng = np.random.default_rng(0)
    n, words = 4000, 30
    v, x = rng.integers(0, 4, n).astype(np.uint64), rng.integers(0, 3, n).astype(np.uint64)
    w = (rng.integers(0, words, n) % rng.integers(1, words, n)).astype(np.uint64)
    # every word once more as an unseen (held-out) trigram of every context
    grid = np.array([(a, b, c) for a in range(4) for b in range(3) for c in range(words)], np.uint64)
    v, x, w = np.append(v, grid[:, 0]), np.append(x, grid[:, 1]), np.append(w, grid[:, 2])
    model = hpylm.Bucket(v, np.zeros(len(v), np.int64), x, w, np.append(np.ones(n), np.zeros(len(grid))), 1)
    model.start(np.full(words, 1 / words))
    for _ in range(4):
        model.sweep()
    p = model.predict()
    total = np.bincount(model.inner, p)
    assert np.allclose(total, 1)
    assert (model.leaf.t <= np.maximum(model.count, 0)).all() and (model.leaf.t[model.count > 0] >= 1).all()


def test_seating_follows_the_chinese_restaurant():
    # mean number of tables of c customers of one dish with base probability one:
    # E[t] = (theta / d) (prod (theta + d + i) / (theta + i) - 1)
    theta, d, c = 1.0, 0.5, 12
    t, _ = hpylm.seat(np.full(40_000, c), np.zeros(40_000), np.ones(40_000), theta, d, np.random.default_rng(0))
    want = theta / d * (np.prod([(theta + d + i) / (theta + i) for i in range(c)]) - 1)
    assert t.mean() == pytest.approx(want, rel=0.01)


def test_empty_table(spark):
    assert hpylm.score_corpus(spark.createDataFrame([], "doc_id long, text string"), held_out()).count() == 0


def test_everything_held_out(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = hpylm.score_corpus(docs, F.lit(True)).first()
    assert (r["train_tokens"], r["n_known"], r["base_score"], r["n_tokens"]) == (0, 0, 0.0, 3)


def test_sections_of_a_context_share_their_evidence(spark):
    # z follows v, but only after five of the words before v; q never follows v
    r = random.Random(3)
    rows = []
    for d in range(600):
        x = r.randrange(100)
        after = "z" if x < 5 else "y%d" % r.randrange(20)
        rows.append((d, " ".join("x%d v %s f%d" % (x, after, r.randrange(3000)) for _ in range(5)) + " g%d q f%d" % (d % 4, r.randrange(3000))))
    for k in range(60):
        rows += [(2000 + 2 * k, "new%d v z" % k), (2001 + 2 * k, "new%d v q" % k)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = hpylm.score_corpus(docs, F.col("doc_id") >= 2000, bucket_tokens=400).collect()
    score = {x["doc_id"]: x["score"] for x in got}
    gain = [score[2000 + 2 * k] - score[2001 + 2 * k] for k in range(60)]
    assert min(gain) > 0.3                       # in every section, not only where z was met
    assert max(gain) - min(gain) < 0.1


def test_a_trigram_is_in_one_section_only():
    dictionary = hpylm.Dictionary(np.array([1, 2, 3], np.uint64), np.array([900, 800, 1]), 100)
    off = np.arange(0, 41 * 6, 6)
    tokens = hpylm.Tokens(np.frombuffer(b"a b c " * 40, np.uint8), off)
    tokens.word[:] = np.tile(np.array([1, 2, 3, hpylm.END], np.uint64), 40)
    chunk = hpylm.Chunk(dictionary, 1)
    salt = [np.arange(40, dtype=np.uint64)] * ("salt" in hpylm.Chunk.add.__code__.co_varnames)
    chunk.add(tokens, dictionary.codes(tokens.word), np.zeros(40, bool), *salt)
    v, x, w, *_, section, _, _ = chunk.parts[0]
    assert len(set(section[(w == 3) & (v == 2) & (x == 1)].tolist())) == 1


def test_no_bucket_meets_a_token_of_every_document(spark):
    # all documents start alike: their first tokens are dealt out, and a frequent trigram goes once per chunk
    words = np.array([1, 2, hpylm.END], np.uint64)
    dictionary = hpylm.Dictionary(words, np.array([900, 900, 900]), 100)
    assert dictionary.section_counts(np.array([hpylm._BEGIN_CODE])) == [9]
    tokens = hpylm.Tokens(np.frombuffer(b"a b " * 900, np.uint8), np.arange(0, 901 * 4, 4))
    tokens.word[:] = np.tile(words, 900)
    chunk = hpylm.Chunk(dictionary, 4)
    chunk.add(tokens, dictionary.codes(tokens.word), np.arange(900) % 3 == 0)
    rows = [hpylm._unpack(body) for _, body in chunk.deal(False)]
    assert sum(r["w"].shape[1] for r in rows) == 3 and sum(int(r["n"].sum()) for r in rows) == 3 * 600
    assert int(chunk.often["on"].sum()) == 2700


def test_root_parts_meet_few_rows(spark):
    body = hpylm._pack({"w": np.arange(5), "c": np.ones(5, int), "n": np.full(5, 2)})
    requests = spark.createDataFrame([(-1, b, bytearray(body)) for b in range(100)] + [(3, 1, bytearray(body))],
                                     "part int, bucket int, body binary")
    got = hpylm._few_requests(requests, 100).collect()
    assert sum(r["part"] == -1 for r in got) == 10 and sum(r["part"] == 3 for r in got) == 1
    _, people, seen, _ = hpylm._merged([r["body"] for r in got if r["part"] == -1])
    assert people.tolist() == [100] * 5 and seen.tolist() == [200] * 5

import collections
import random

import pytest

from txsentinel.llm import suffix_dedup


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(b[i:i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for (doc_id, _), b in zip(rows, texts):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans, at = [], 0
        while at < len(b):
            if gone[at]:
                end = at
                while end < len(b) and gone[end]:
                    end += 1
                spans.append((at, end))
                at = end
            at += 1
        out.append((doc_id, len(b), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def corpus(seed=0):
    r = random.Random(seed)

    def text(n):
        return "".join(r.choices("abcdé \n", k=n))

    passages = [text(n) for n in (25, 40, 41, 60, 90)]
    rows = [(d, text(r.randint(0, 150))) for d in range(30)]
    for d in range(30, 110):
        own = [text(r.randint(0, 60)) for _ in range(3)]
        rows.append((d, own[0] + r.choice(passages) + own[1] + r.choice(passages)[r.randint(0, 5):] + own[2]))
    rows += [(200, rows[40][1]), (201, rows[40][1]), (202, "ab" * 300), (203, None), (204, ""), (205, "x" * 39),
             (206, "x" * 40), (207, "x" * 41), (None, rows[50][1]), (None, None), (208, text(60)), (208, text(70))]
    return rows + [rows[3], rows[60], rows[60]]


@pytest.mark.parametrize("hot, shard", [(4096, 1 << 20), (4096, 500), (1, 1 << 20)])  # one shard, many, counted
def test_matches_brute_force(spark, hot, shard):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 5, 7) for d, t in rows],
                                 "doc_id long, text string, rk int, spans int").repartition(6)
    got = suffix_dedup.remove_repeats(docs, length=40, gram=8, hot_regions=hot, shard_bytes=shard).collect()
    found = sorted(((r["doc_id"], r["n_bytes"], [(s["s"], s["e"]) for s in r["spans"]], bytes(r["kept"]))
                    for r in got), key=str)
    assert found == brute(rows, 40)


def test_common_minimizers_take_no_exchange_of_texts_of_their_own(spark, monkeypatch):
    rows = [(d, t, 0) for d, t in corpus()]
    written, materialize = [], suffix_dedup.materialize
    monkeypatch.setattr(suffix_dedup, "materialize", lambda df, name: written.append(
        (name, df._jdf.queryExecution().optimizedPlan().toString())) or materialize(df, name))
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(6)
    got = suffix_dedup.remove_repeats(docs, length=40, gram=8, hot_regions=3)
    # every join that needs the texts is part of the last query, which exchanges them once
    assert not [name for name, plan in written if name != "regions" and "body" in plan]
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan[:plan.index("Initial Plan")].count("ReusedExchange") >= 2


def test_empty_and_short(spark):
    docs = spark.createDataFrame([(1, "short"), (2, "short")], "doc_id long, text string")
    assert [bytes(r["kept"]) for r in suffix_dedup.remove_repeats(docs).collect()] == [b"short"] * 2
    assert suffix_dedup.remove_repeats(docs.where("false")).count() == 0


def test_runs_are_bounded_and_cover_all_starts():
    import numpy as np
    grams = np.random.default_rng(0).integers(0, 4, 5000).astype(np.uint64) << np.uint64(40)
    start, n, h = suffix_dedup.minimizer_runs(grams, 40, 8)
    assert start[0] == 0 and (start[1:] == (start + n)[:-1]).all() and (start + n)[-1] == 5000 - 32
    assert n.max() <= 33
    for a, k, v in zip(start, n, h):
        assert v == grams[a:a + 33].min() == grams[a + k - 1:a + k + 32].min()


@pytest.mark.parametrize("shared", [b"z" * 40, b"a" * 40])  # the largest and the smallest string of the shard
def test_last_string_of_a_shard_is_compared(shared):
    regions = [b"b" * 5 + shared, b"c" * 5 + shared]
    assert [f.tolist() for f in suffix_dedup.shard_repeats(regions, [6, 6], 40)] == [[5], [5]]

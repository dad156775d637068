import random

import numpy as np
import pytest

from txsentinel.llm import tensor_minhash as tm
from txsentinel.llm.components import connected_components


def shingles(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows, percent):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            i = len(sets[a] & sets[b])
            if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def family_corpus():
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefghij", k=5))
    rows, n = [], 0
    for size in (1, 1, 2, 3, 40):
        base = [word() for _ in range(r.randint(30, 150))]
        for _ in range(size):
            own = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3, 6])):
                own[r.randrange(len(own))] = word()
            n += 1
            rows.append((n, (" " if n % 2 else "\n").join(own).title()))
    return rows + [(n + 1, "one two"), (n + 2, "ONE  two"), (n + 3, "two one"), (n + 4, ""), (n + 5, None),
                   (n + 6, " \t"), (n + 7, " ".join(word() for _ in range(20_000)))]


@pytest.mark.parametrize("percent, block", [(85, 512), (80, 7)])
def test_classes_match_brute_force(spark, percent, block):
    rows = family_corpus()
    docs = spark.createDataFrame([(d, t, "c", 0) for d, t in rows], "doc_id long, text string, key string, rep int")
    got = tm.near_duplicates(docs, percent=percent, block=block).collect()
    want = brute(rows, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (want[r["doc_id"]][1] == r["doc_id"]) for r in got) and len(got) == len(rows)


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, None), (7, "A B c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, tm.near_duplicates(docs).drop("text_hash").collect()), key=str)
    assert got == sorted([(None, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (None, 0, None, False),
                          (7, 2, 5, False)], key=str)
    assert tm.near_duplicates(docs.where("false")).count() == 0


def test_one_identifier_with_different_texts(spark):
    """Strangers that share an identifier stay in the classes of their own texts."""
    a, b = ("%s " % w * 1 + " ".join(f"{w}{i}" for i in range(60)) for w in ("alpha", "beta"))
    rows = [(1, a), (1, b), (2, a), (3, b + " more"), (0, a + " tail"), (9, "own words of nobody else at all"), (9, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r)[:4] for r in tm.near_duplicates(docs).select("doc_id", "component_id", "kept", "text_hash").collect()]
    hashed = {r["text"]: r["h"] for r in docs.select("text", tm.text_hash(docs["text"]).alias("h")).collect()}
    assert sorted(got) == sorted((d, c, d == c, hashed[t]) for (d, t), c in zip(rows, (0, 1, 0, 1, 0, 9, 0)))


def test_tables_are_pairs_of_two_small_collections():
    values = np.sort(np.random.default_rng(0).integers(0, 2**63, 300).astype(np.uint64))
    sketch = tm.tensor_sketch(np.concatenate([values, values[:290]]), np.array([0, 300, 590, 590]))
    assert sketch.shape == (3, 2 * tm.SIDE) and not sketch[2].any()
    same = sketch[0] == sketch[1]
    assert same[:tm.SIDE].any() and same[tm.SIDE:].any()


def test_components(spark):
    r = random.Random(0)
    edges = [(k, k + 1) for k in range(100, 160)] + [(r.randrange(50), r.randrange(50)) for _ in range(40)]
    edges += [(7, 7), (None, 3)]
    root = {x: x for e in edges[:-1] for x in e}
    for _ in range(200):
        for a, b in edges[:-1]:
            root[a] = root[b] = min(root[a], root[b])
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x["node"]: x["component"] for x in got} == root

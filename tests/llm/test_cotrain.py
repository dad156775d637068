import random

import numpy as np
import pytest

from txsentinel.llm import cotrain


def corpus(n=900):
    r = random.Random(2)
    vocab = ["".join(r.choices("abcdefghijklm", k=r.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for d in range(n):
        words, good = r.choices(vocab, k=r.randint(5, 150)), r.random() < 0.75
        if not good:
            kind = r.randrange(3)
            words = [[w.upper() + "!!" for w in words], [w + "$$$" for w in words], words[:2] * len(words)][kind]
        text = " ".join(words)
        docs.append((d, text, r.choice(["en", "de", None]), "s%d" % r.randrange(5), len(text)))
        if d % 2:
            labels.append((d, int(good), 0))
        docs[-1] += (good,)
    return docs, labels


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_held_out_accuracy_and_rows(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame([d[:5] for d in docs], SCHEMA)
    model = cotrain.fit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r for r in cotrain.score_quality(frame, model).collect()}
    assert len(got) == len(docs)
    unseen = [d for d in docs if d[0] % 2 == 0]
    right = [got[d[0]]["kept"] == d[5] for d in unseen]
    assert sum(right) / len(right) > 0.95
    kept_good = [got[d[0]]["kept"] for d in unseen if d[5]]
    assert sum(kept_good) / len(kept_good) > 0.97
    assert all(0 <= got[d[0]][c] <= 1 for d in docs for c in ("score", "content_score", "metadata_score"))


def test_pseudo_labels_help_a_view_with_few_labels():
    r = np.random.default_rng(0)
    n = 1200
    y = r.integers(0, 2, n).astype(float)
    x = r.normal(size=(n, cotrain.SIZE))
    x[:, 0] += 3 * (2 * y - 1)                       # clear in the content view
    x[:, cotrain.CONTENT_SIZE:] += 0.35 * (2 * y - 1)[:, None]   # spread over the other view
    few = np.arange(60)
    test = np.arange(900, n)

    def accuracy(rounds):
        model = cotrain.co_train(x[few], y[few], cotrain.ArrayPool(x[60:900]), rounds=rounds)
        return ((model.scores(x[test])[2] > 0.5) == y[test]).mean()

    assert accuracy(4) >= accuracy(0)


@pytest.mark.parametrize("labels, score", [([], 1.0), ([(1, 1, 0)], 1.0), ([(1, 0, 0)], 0.0), ([(1, None, 0)], 1.0)])
def test_without_both_classes(spark, labels, score):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3), (2, None, None, None, None)], SCHEMA)
    model = cotrain.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = cotrain.score_quality(docs, model).collect()
    assert [r["score"] for r in rows] == [score] * 2 and [r["kept"] for r in rows] == [score >= 0.5] * 2


def test_edge_rows_and_columns(spark):
    docs, labels = corpus(300)
    rows = [d[:5] for d in docs] + [(None, None, None, None, None), (7000, "", "en", "x", -5), (7001, "y " * 40_000, "en", "x", 1),
                                    docs[0][:5]]
    frame = spark.createDataFrame([(*d, "clash", 3.5) for d in rows], SCHEMA + ", kept string, score double")
    model = cotrain.fit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = cotrain.score_quality(frame, model)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "content_score",
                           "metadata_score", "kept"]
    assert out.where("score IS NOT NULL AND kept IS NOT NULL").count() == len(rows)
    assert cotrain.score_quality(frame.where("false"), model).count() == 0


def plain_co_training(x, y, pool, rounds, share):
    """The same rounds row by row: every view keeps the list of rows it was handed."""
    model = cotrain.CoTrained(share, x.mean(0), np.maximum(x.std(0), 1e-3))
    held = np.zeros(len(y), bool)
    for c in (0, 1):
        held[np.flatnonzero(y == c)[3::4]] = True
    views, others = model.views(x), model.views(pool)
    weights = [cotrain.fit_logistic(views[v][~held], y[~held], ridge=cotrain.RIDGE, rounds=12) for v in (0, 1)]
    handed = [{}, {}]
    width = (cotrain.TOP - cotrain._LEAST) / cotrain.CELLS
    for _ in range(rounds):
        now = [{}, {}]
        for v in (0, 1):
            odds = others[v] @ weights[v]
            for label, sign, part in ((1, 1, share), (0, -1, 1 - share)):
                quota = max(1.0, len(pool) * cotrain.HANDED_SHARE * part)
                cells = {}
                for i, z in enumerate(sign * odds):
                    if i not in handed[1 - v] and z >= cotrain._LEAST:
                        cells.setdefault(min(int((min(z, cotrain.TOP) - cotrain._LEAST) / width), cotrain.CELLS - 1), []).append(i)
                taken = []
                for cell in sorted(cells, reverse=True):
                    if taken and len(taken) + len(cells[cell]) > quota:
                        break
                    taken += cells[cell]
                now[1 - v].update({i: label for i in taken})
        for v in (0, 1):
            handed[v] = {**now[v], **handed[v]}
        for _ in range(cotrain.STEPS):
            for v in (0, 1):
                rows = np.array(sorted(handed[v]), int)
                z = np.vstack([views[v][~held], others[v][rows]])
                t = np.append(y[~held], [handed[v][i] for i in rows])
                odds = z @ weights[v]
                p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
                penalty = np.full(z.shape[1], cotrain.RIDGE)
                penalty[0] = 1e-6
                curvature = z.T @ np.diag(np.tanh(odds / 2) / (2 * odds)) @ z + np.diag(penalty)
                weights[v] = weights[v] + np.linalg.solve(curvature, z.T @ (t - p) - penalty * weights[v])
    return weights, handed


def test_the_whole_pool_takes_part_as_in_plain_co_training(spark):
    docs, labels = corpus(700)
    # a language that no label has, so that only pseudo-labels speak about it
    docs = [d if d[0] % 2 or d[0] % 14 else (d[0], d[1], "xx", *d[3:]) for d in docs]
    frame = spark.createDataFrame([d[:5] for d in docs], SCHEMA)
    model = cotrain.fit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rounds=2)
    import pyarrow as pa
    from txsentinel.llm.arrow_text import text_buffer
    x = cotrain.features(*text_buffer(pa.array([d[1] for d in docs])), *zip(*[d[2:5] for d in docs])).astype(float)
    known = {d: q for d, q, _ in labels}
    own = np.array([d[0] in known for d in docs])
    y = np.array([known[d[0]] for d in docs if d[0] in known], float)
    weights, handed = plain_co_training(x[own], y, x[~own], 2, y.mean())
    assert all(len(h) > 10 for h in handed[1:])      # the content view is sure of many rows
    for got, want in zip(model.weights, weights):
        np.testing.assert_allclose(got, want, atol=1e-6)
    rare = [i for i, d in enumerate([d for d in docs if d[0] not in known]) if d[2] == "xx"]
    assert any(i in handed[1] for i in rare)


def test_steps_do_not_overshoot_on_separable_pools():
    """Many handed rows that lie far on the right side leave no true curvature."""
    r = np.random.default_rng(4)
    y = (r.random(3000) < 0.86).astype(float)
    x = r.normal(size=(3000, cotrain.SIZE)) * 0.2
    x[:, :20] += 4 * (2 * y - 1)[:, None]
    model = cotrain.co_train(x[:400], y[:400], cotrain.ArrayPool(x[400:]))
    assert all(np.abs(w).max() < 20 for w in model.weights)
    joint, content, _ = model.scores(x)
    assert ((content > 0.5) == y).mean() > 0.97 and ((joint > 0.5) == y).mean() > 0.97

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from txsentinel.llm import fim


def expected(doc_id, text, seed=1):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k:k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["", None, "a", "é", "漢字😀 mixed\n text", "with <M> inside", "<P", "P><S", "x" * 300_000 + "漢" * 100_000]
ROWS = [(i, t) for i, t in enumerate(TEXTS * 12)] + [(None, "no id"), (None, None), (3, "é"), (3, "é"), (3, "other")]


def test_outputs_and_restored_texts(spark):
    docs = spark.createDataFrame([(i, t, "o", "n", "b", 5) for i, t in ROWS],
                                 "doc_id long, text string, output string, name string, body string, n int")
    rows = fim.restore(fim.transform(docs)).collect()
    assert rows[0].asDict().keys() == {"doc_id", "name", "body", "n", "form", "prefix_chars", "middle_chars",
                                       "output", "restored"}
    got = sorted((str(r["doc_id"]), r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])
                 for r in rows)
    assert got == sorted((str(i), *expected(i, t)) for i, t in ROWS)
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    assert sorted((str(r["doc_id"]), r["restored"]) for r in rows) == sorted((str(i), t or "") for i, t in ROWS)
    assert {(r["name"], r["body"]) for r in rows} == {("n", "b")}


def test_empty_table_and_null_output(spark):
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    row = fim.restore(spark.createDataFrame([(None, "psm2")], "output string, form string")).first()
    assert row["restored"] == ""


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab<PSM>é漢😀", max_size=40), st.integers(0, 40), st.integers(0, 40),
       st.sampled_from(["psm", "spm"]))
def test_rotations_are_inverted(text, a, b, form):
    if any(x in text for x in ("<P>", "<S>", "<M>")):
        return
    a, b = sorted((min(a, len(text)), min(b, len(text))))
    data = bytearray(text.encode())
    fim.rearrange(data, len(text[:a].encode()), len(text[:b].encode()), form)
    p, m, s = text[:a], text[a:b], text[b:]
    assert data.decode() == (f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}")
    fim.bring_back(data, form)
    assert data.decode() == text


@pytest.mark.parametrize("block", [1, 2, 3, 64])
def test_blocks_change_nothing(monkeypatch, block):
    import numpy as np

    monkeypatch.setattr(fim, "BLOCK", block)
    text = "aé漢😀" * 9
    view = np.frombuffer(text.encode(), np.uint8)
    assert fim.code_points(view) == len(text)
    assert [fim.byte_offset(view, k) for k in range(len(text) + 1)] == [len(text[:k].encode()) for k in range(len(text) + 1)]
    data = bytearray(range(37))
    fim.rotate(data, 3, 10, 30)
    assert list(data) == [*range(3), *range(10, 30), *range(3, 10), *range(30, 37)]

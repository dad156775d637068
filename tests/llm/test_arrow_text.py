import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from txsentinel.llm.arrow_text import (prefix_hash, range_hash, slices, text_buffer, word_hashes,
                                       word_spans)

TEXTS = st.lists(st.one_of(st.none(), st.text("aB \t\n\x0bçé.", max_size=30)), max_size=12)


def expected_words(text):
    return (text or "").encode().lower().split()


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_those_of_bytes_split(texts):
    buf, off = text_buffer(pa.array(texts, pa.string()))
    start, end, doc = word_spans(buf, off)
    got = [[] for _ in texts]
    for a, b, d in zip(start, end, doc):
        got[d].append(bytes(buf[a:b]).lower())
    assert got == [expected_words(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_equal_words_have_equal_hashes(texts):
    hashes, doc = word_hashes(*text_buffer(pa.array(texts, pa.string())))
    flat = [w for t in texts for w in expected_words(t)]
    assert len(flat) == len(hashes)
    pairs = dict(zip(flat, hashes.tolist()))
    assert [pairs[w] for w in flat] == hashes.tolist()
    assert len(set(pairs.values())) == len(pairs)


def test_range_hash_depends_on_content_only():
    buf = np.frombuffer(b"abcabcabcd" * 500, np.uint8)
    p = prefix_hash(buf)
    at = np.arange(0, 4900, 10)
    assert len(np.unique(range_hash(p, at, at + 3))) == 1
    assert len(np.unique(range_hash(p, at, at + at % 7 + 1))) == 7


def test_slices_cover_all_rows_and_offsets_of_sliced_arrays():
    texts = ["x" * n for n in (0, 5, 3000, 1, 0, 2000, 7)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["id", "text"])
    seen = []
    for rows, buf, off in slices(batch.slice(1), "text", limit=1000):
        ids = rows.column(0).to_pylist()
        seen += [(i, bytes(buf[a:b]).decode()) for i, a, b in zip(ids, off, off[1:])]
    assert seen == list(zip(range(1, 7), texts[1:]))


def test_words_of_structured_bytes_differ():
    """The Thue-Morse word and its complement collide in every polynomial hash modulo 2^64."""
    bits = [0]
    while len(bits) < 2048:
        bits += [1 - b for b in bits]
    words = [bytes(97 + b for b in bits[:n]) for n in (256, 1024, 2048)]
    words += [bytes(195 - c for c in w) for w in words] + [b"c" * n for n in (7, 8, 9, 1023, 1024, 1025, 5000)]
    hashes, _ = word_hashes(*text_buffer(pa.array([b" ".join(words + words[::-1]).decode()])))
    assert len(set(hashes.tolist())) == len(words)
    assert hashes[:len(words)].tolist() == hashes[len(words):][::-1].tolist()

import base64

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from txsentinel.llm import bpe


@pytest.fixture(scope="module")
def encoding():
    with open(bpe.default_rank_file(), "rb") as fh:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, fh)}
    return tiktoken.Encoding("t", pat_str=bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'sté 12\n\t\x1c  !?_ñß漢😀\u00a0\u2003"), max_size=60),
       st.integers(1, 8))
def test_chunks_change_nothing(encoding, text, size):
    assert "".join(bpe.safe_chunks(text, size)) == text
    assert bpe.encode_one(encoding, text, size).tolist() == encoding.encode_ordinary(text)


def test_frame_round_trip(spark, encoding):
    texts = ["", None, "Hello's  world\n\n42x", "<|endoftext|> é漢", "a" * 70_000 + " b1" * 30_000, "Hello's  world\n\n42x"]
    docs = spark.createDataFrame([(i, t, "clash", -1) for i, t in enumerate(texts)],
                                 "doc_id long, text string, ids string, n_tokens int")
    rows = {r["doc_id"]: r for r in bpe.decode_ids(bpe.encode_texts(docs)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        ids = np.frombuffer(bytes(rows[i]["ids"]), "<u4").tolist()
        assert ids == encoding.encode_ordinary(t or "")
        assert rows[i]["n_tokens"] == len(ids)
        assert bytes(rows[i]["decoded"]) == (t or "").encode()


def test_empty_table_and_partial_bytes(spark, encoding):
    assert bpe.encode_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    first = np.asarray(encoding.encode_ordinary("漢"), "<u4")[:1]
    row = bpe.decode_ids(spark.createDataFrame([(bytearray(first.tobytes()),), (None,)], "ids binary")).collect()
    assert bytes(row[0]["decoded"]) == encoding.decode_bytes(first.tolist())
    assert bytes(row[1]["decoded"]) == b""

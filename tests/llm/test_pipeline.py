"""The pipeline against brute force: each stage's decision is worked out again in plain Python."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from txsentinel.llm import bpe, cotrain
from test_decontam import substring_distance
from test_tensor_minhash import brute

SF = "/root/testdata/sf0.001"


def test_stages_are_the_five_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality", "exact_dedup", "near_dedup", "decontaminate", "encode"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows after every stage, each written and read again."""
    base = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{base}/{k}")
        out.append(spark.read.parquet(f"{base}/{k}"))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns_stay_until_the_last(stages):
    for df in stages[1:-1]:
        assert df.schema.names == stages[0].schema.names


def test_quality_matches_the_operator(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = cotrain.score_quality(stages[0], cotrain.fit(stages[0], labels)).where("kept")
    assert texts(stages[1]) == texts(scored)
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    assert len(good & set(texts(stages[1]))) >= 0.97 * len(good & set(texts(stages[0])))


def test_exact_copies(stages):
    best = {}
    for d, t in texts(stages[1]).items():
        norm = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        best[norm] = max(best.get(norm, d), d)
    assert set(texts(stages[2])) == set(best.values())


def test_near_copies(stages):
    rows = list(texts(stages[2]).items())
    assert set(texts(stages[3])) == {d for d, (_, c) in brute(rows, corpus_pipeline.NEAR_PERCENT).items() if d == c}


def test_benchmark(spark, stages):
    from txsentinel.llm.decontam import ERROR_SHARE, word_codes
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = texts(stages[3]), texts(stages[4])
    for d, t in before.items():
        words = word_codes([t])[0].tolist()
        leak = False
        for item in items:
            p = word_codes([item])[0].tolist()
            # items share few words with other texts: skip the table where that already decides
            if len(p) - len(set(p) & set(words)) <= int(ERROR_SHARE * len(p)) + len(p) - len(set(p)):
                leak |= substring_distance(p, words) <= int(ERROR_SHARE * len(p))
        assert (d not in after) == leak


def test_encoding(stages):
    encoding = bpe._encoding("t", bpe.default_pattern(), open(bpe.default_rank_file(), "rb").read())
    want = {}
    for d, t in texts(stages[4]).items():
        ids = np.array(encoding.encode_ordinary(t or ""), "<u4")
        want[d] = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert {r["doc_id"]: tuple(r)[1:] for r in stages[5].collect()} == want


def test_run_returns_the_last_stage(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[5].collect()))


def test_edge_rows_pass_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", None, 0), (None, "a b", None, "s", 3)],
                                docs.schema)
    for rows in (docs.limit(40).unionByName(odd).unionByName(odd), docs.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, SF)
        rows.count()


def test_columns_of_a_user_stay_as_they_are(spark):
    """Columns named like the stages' own come through with their values."""
    own = ["score", "kept", "content_score", "metadata_score", "leak", "__leak", "body", "__body", "found", "__found",
           "__id", "__sha", "id", "rep", "key", "y", "x", "lang_", "c0"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    rows = docs.select("*", *[F.concat_ws("-", F.lit(c), "doc_id").alias(c) for c in own])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, SF)
        assert rows.columns == docs.columns + own
    for r in rows.collect():
        assert all(r[c] == f"{c}-{r['doc_id']}" for c in own)


def test_a_copy_does_not_take_a_clean_row_of_its_identifier_along(spark):
    a, b = (" ".join(f"{w}{i}" for i in range(80)) for w in ("gamma", "delta"))
    docs = spark.createDataFrame([(1, a, "en", "s", 1), (1, b, "en", "s", 1), (0, a + " tail", "en", "s", 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert sorted((r["doc_id"], r["text"]) for r in left) == [(0, a + " tail"), (1, b)]

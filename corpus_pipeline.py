"""Training-corpus pipeline: documents in, encoded clean documents out.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; a stage's result is written as Parquet and read again as the
next one's ``docs``.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txsentinel.llm import bpe, cotrain, decontam, exact_tree, tensor_minhash
from txsentinel.llm.arrow_text import fresh_names
from txsentinel.session import checkpoint_dir, materialize

#: Least similarity (per cent, five-word shingles) of near duplicates.
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    model = cotrain.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # the columns travel under numbers, so that none is taken for one of the classifier's own
    number = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    scored = cotrain.score_quality(docs.toDF(*number.values()), model, **{
        part: number[column] for part, column in (("text", "text"), ("lang", "lang"), ("source", "source"),
                                                  ("chars", "n_chars")) if column in number})
    return scored.where("kept").select(*[F.col(n).alias(c) for c, n in number.items()])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays (the largest doc_id).

    Rows that repeat both doc_id and text, and rows without doc_id, stay or go together."""
    groups = exact_tree.exact_groups(docs)
    gone = materialize(groups.where("NOT kept").select(F.col("doc_id").alias("__id"),
                                                       F.col("text_sha256").alias("__sha")).distinct(), "copies")
    sha = F.sha2(exact_tree.normalised(docs["text"]), 256)
    return docs.join(gone.hint("merge"), docs["doc_id"].eqNullSafe(gone["__id"]) & (sha == gone["__sha"]),
                     "left_anti")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays (the smallest doc_id).

    Rows without doc_id cannot be named as copies and stay; of rows with one doc_id, those go whose
    own text is a copy."""
    classes = tensor_minhash.near_duplicates(docs, percent=NEAR_PERCENT)
    gone = materialize(classes.where("NOT kept AND doc_id IS NOT NULL")
                       .select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "near-copies")
    same = (docs["doc_id"] == gone["__id"]) & (tensor_minhash.text_hash(docs["text"]) == gone["__hash"])
    return docs.join(gone.hint("merge"), same, "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its error budget go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leak = fresh_names(docs.columns, "leak")[0]
    return decontam.flag_contaminated(docs, items, leak).where(f"NOT {leak}").drop(leak)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian u32), their digest, and the digest of the decoded bytes."""
    coded = bpe.decode_ids(bpe.encode_texts(docs.select("doc_id", "text")))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs

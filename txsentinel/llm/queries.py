"""Registered queries of the training-data operators: name -> (builder, oracle SQL or None).

Every query applies its operator with production parameters to whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txsentinel.llm import (bpe, cotrain, decontam, exact_tree, fim, hpylm, mixture, suffix_dedup,
                            tensor_minhash, toxic_crf, turn_repair, url_filter, warc_fixity)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_hpylm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return hpylm.score_corpus(read(spark, sf_dir, "documents"), held_out)


def op2_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = cotrain.fit(docs, read(spark, sf_dir, "labels"))
    return cotrain.score_quality(docs, model, carry=["doc_id"])


def op3_tensor_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensor_minhash.near_duplicates(read(spark, sf_dir, "documents"), percent=85)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = bpe.decode_ids(bpe.encode_texts(docs))
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


#: The contract's rules: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"),
             ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

URL_SQL = r"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0
                                   THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS h FROM rest),
judged AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path FROM parts),
ruled AS (SELECT page_id, host, path,
  CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%'
            THEN 'www.example.com/en/'
       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
       WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
       WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
       WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM judged)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return (url_filter.judge_urls(pages, URL_RULES)
            .select("page_id", "host", "path", "rule", "verdict"))


def op6_exact_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (exact_tree.exact_groups(read(spark, sf_dir, "documents"))
            .select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["e"] - s["s"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def damaged_replica(pages: DataFrame) -> DataFrame:
    """A second replica of ``pages``: some records changed, some lost."""
    n = F.floor(F.length("html") / 2).cast("int")
    hurt = F.concat(F.substr("html", F.lit(1), n), F.lit("~~"), F.substr("html", n + 1))
    return (pages.where("page_id % 101 <> 13")
            .withColumn("html", F.when(F.expr("page_id % 101 = 7"), hurt).otherwise(F.col("html"))))


WARC_SQL = r"""
WITH src AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
both_ AS (SELECT page_id, url, html AS a,
                 CASE WHEN page_id % 101 = 7 THEN substr(html, 1, length(html) // 2) || '~~'
                      || substr(html, length(html) // 2 + 1) ELSE html END AS b FROM src),
rec AS (SELECT page_id, page_id // 4096 AS file, page_id % 4096 AS slot,
  'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
  || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
  || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' AS head,
  chr(13) || chr(10) || chr(13) || chr(10) AS gap, a, b FROM both_),
full_ AS (SELECT page_id, file, slot, head || strlen(a) || gap || a || gap AS ra,
                 head || strlen(b) || gap || b || gap AS rb FROM rec),
placed AS (SELECT *, sum(strlen(ra)) OVER (PARTITION BY file ORDER BY slot
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fin FROM full_)
SELECT file, CAST(slot AS INTEGER) AS slot, CAST(fin - strlen(ra) AS BIGINT) AS "start", CAST(fin AS BIGINT) AS "end",
       CASE WHEN page_id % 101 = 13 THEN 'missing' ELSE 'changed' END AS status, sha256(ra) AS first_hash,
       CASE WHEN page_id % 101 = 13 THEN NULL ELSE sha256(rb) END AS second_hash
FROM placed WHERE page_id % 101 = 13 OR ra <> rb
"""


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc_fixity.audit(warc_fixity.warc_records(pages),
                             warc_fixity.warc_records(damaged_replica(pages)))


def op9_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    bucket = F.crc32(F.col("doc_id").cast("string")) % 4
    model = toxic_crf.fit(docs, read(spark, sf_dir, "labels"), bucket != 2)
    tagged = toxic_crf.tag(docs, model)
    return tagged.select("doc_id", F.coalesce(bucket == 2, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"),
                         F.size("spans").alias("n_spans"))


def op11_fim_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = fim.transform(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return fim.restore(moved).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.report(turn_repair.damaged(read(spark, sf_dir, "conversations")))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_hpylm": (op1_hpylm, None),
    "op2_cotraining": (op2_cotraining, None),
    "op3_tensor_minhash": (op3_tensor_minhash, None),
    "op4_byte_bpe": (op4_byte_bpe, None),
    "op5_url_rules": (op5_url_rules, URL_SQL),
    "op6_exact_tree": (op6_exact_tree, exact_tree.ORACLE_SQL),
    "op7_suffix_dedup": (op7_suffix_dedup, None),
    "op8_warc_fixity": (op8_warc_fixity, WARC_SQL),
    "op9_pigeonhole": (op9_pigeonhole, None),
    "op10_toxic_crf": (op10_toxic_crf, None),
    "op11_fim_rotation": (op11_fim_rotation, fim.ORACLE_SQL),
    "op12_turn_repair": (op12_turn_repair, turn_repair.ORACLE_SQL),
    "op13_source_mix": (op13_source_mix, mixture.ORACLE_SQL),
}

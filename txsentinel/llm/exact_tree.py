"""Exact dedup as a tree-merge of sorted digest runs (DataFrame functions only).

1. Every row becomes a small entry: identifier, run, and a content key made of
   the SHA-256, the byte length and a second, independent 64-bit hash of the
   normalised text.  Entries merge only where all three agree, so the kept
   identifier of a merge is verified at every level.  The table is written
   once; texts are read and hashed once.
2. Runs: the rows of one input partition form a run with one entry per key
   (copies add up before they move), written in key order.
3. Up: in each round the runs whose numbers agree above the lowest
   ``FAN_BITS`` bits meet (a binomial tree for 1 bit, multiway above).  They
   are exchanged by key range, sorted, and merged in one ordered pass: of the
   neighbours with equal keys the first (best identifier) stays with the sum of
   their counts.  A group of copies, however large, never brings more than
   ``2^FAN_BITS`` entries together.  Every level is written, in key order.
4. Down: the root's entries travel back the same tree by merge joins, each
   level read once, each run taking the facts of its own keys, and finally
   meet the rows of the run.  No join key has more rows than the share of a
   group inside one run.

Defined results: null text counts as empty; texts are equal when identical
after lower-casing A-Z only; of equal texts the row with the largest (or, with
``keep="smallest"``, smallest) identifier stays; rows with a null identifier
stay only if no row of the group has one; rows that repeat the kept identifier
are all marked kept; extra columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txsentinel.session import materialize

#: Number of initial runs: input partitions are dealt to them by number.
RUN_BITS = 8
#: Runs that meet in a round: 2^FAN_BITS.
FAN_BITS = 2

KEY = ["sha", "n_bytes", "check"]


def normalised(text):
    """Null as empty, A-Z lower-cased, everything else unchanged."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")),
                       string.ascii_uppercase, string.ascii_lowercase)


def digest_entries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One entry per row: id, run, content key."""
    return (docs.select(F.col(f"`{id_col}`").alias("id"), normalised(F.col(f"`{text_col}`")).alias("norm"))
            .select("id", F.pmod(F.spark_partition_id(), F.lit(1 << RUN_BITS)).alias("run"),
                    F.unhex(F.sha2("norm", 256)).alias("sha"),
                    F.octet_length("norm").alias("n_bytes"),
                    F.xxhash64("norm").alias("check")))


def first_runs(rows: DataFrame, pick=F.max) -> DataFrame:
    """One entry per run and key (keep, n), each partition in key order."""
    return (rows.groupBy("run", *KEY).agg(pick("id").alias("keep"), F.count(F.lit(1)).alias("n"))
            .sortWithinPartitions("run", *KEY))


def merge_round(level: DataFrame, pick=F.max) -> DataFrame:
    """The next level: runs that meet are exchanged by key range and merged in one pass in key order."""
    best = F.col("keep").desc_nulls_last() if pick is F.max else F.col("keep").asc_nulls_last()
    order = Window.partitionBy("run", *KEY).orderBy(best)
    together = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (level.withColumn("run", F.shiftright("run", FAN_BITS))
            .repartitionByRange("run", *KEY)
            .select("run", *KEY, "keep", F.sum("n").over(together).alias("n"),
                    F.row_number().over(order).alias("place"))
            .where("place = 1").drop("place"))


def facts_for_rows(rows: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``rows`` with keep and n: down the tree by merge joins, each level read once."""
    facts = levels[-1]
    for level in reversed(levels[:-1]):
        below = level.select("run", F.shiftright("run", FAN_BITS).alias("above"), *KEY)
        above = facts.select(F.col("run").alias("above"), *KEY, "keep", "n")
        facts = below.join(above.hint("merge"), ["above", *KEY]).drop("above")
    return rows.join(facts.hint("merge"), ["run", *KEY])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 keep: str = "largest") -> DataFrame:
    """Per row: ``id_col``, keep_id, group_size, kept, text_sha256 (hex of the normalised text)."""
    pick = {"largest": F.max, "smallest": F.min}[keep]
    rows = materialize(digest_entries(docs, id_col, text_col), "digest-entries")
    levels = [materialize(first_runs(rows, pick), "digest-runs-0")]
    for k in range(RUN_BITS // FAN_BITS):
        levels.append(materialize(merge_round(levels[-1], pick), f"digest-runs-{k + 1}"))
    joined = facts_for_rows(rows, levels)
    return joined.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"),
                         F.col("n").alias("group_size"),
                         F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
                         F.lower(F.hex("sha")).alias("text_sha256"))


def _sql(table: str = "documents", order: str = "max") -> str:
    return f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}',
                                    '{string.ascii_lowercase}') AS norm FROM {table})
SELECT doc_id, {order}(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = {order}(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""


ORACLE_SQL = _sql()

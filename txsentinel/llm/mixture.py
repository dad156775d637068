"""Mixing sources to target weights (DataFrame functions only).

1. Every document gets its size in words and a hash-random key; the texts are read once, and only
   this small entry moves on.
2. Sources are numbered in code-point order (null last) and weighted in turn.  Their targets are
   the water level that shares the budget by weight with no source above ``MAX_EPOCHS`` times its
   size.  The level comes from prefix sums over the sources in the order in which they fill up.
3. Entries are range-sorted by (source, key), so a source of any size is spread over many
   partitions.  Prefix sums are taken inside each partition; the totals of the partitions, one row
   per source and partition, give the offsets.
4. A source repeats whole epochs while they fit its budget; the rest of the budget is cut out of
   the next epoch at the exact word, so one document at most is taken in part.

Defined results: a null text has size 0; a null source is a source of its own and comes last; a
null identifier is an identifier like others; repeated rows are separate documents; a source
without words has target 0; extra columns are not read; an empty table gives an empty result.
Rows that agree in source, identifier and text may swap places, which no result shows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txsentinel.session import materialize, shuffle_partitions

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Budget as a share of all words.
BUDGET = 1.5
#: A source is repeated at most so often.
MAX_EPOCHS = 2
SEED = 1

_WORD = r"[^\x20\x09-\x0D]+"
_SOURCE = ["unnamed", "name"]       # "no source" sorts behind every name


def prefix_sums(rows: DataFrame, order: Sequence[str], sums: dict[str, Column],
                group: Sequence[str] = (), name: str = "prefix") -> DataFrame:
    """``rows`` plus, for each entry of ``sums``, its sum over all earlier rows of the group.

    ``order`` starts with the columns of ``group``.  The table is range-sorted and written once, so
    that partition numbers are fixed; a group may span any number of partitions.
    """
    n = shuffle_partitions(rows.sparkSession)
    group = list(group)
    for k, column in sums.items():
        rows = rows.withColumn(f"w_{k}", column)
    ranged = materialize(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), name)
    totals = ranged.groupBy(*group, "part").agg(*[F.sum(f"w_{k}").alias(f"w_{k}") for k in sums])
    # one row per group and partition: a group has at most as many as there are partitions
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "part", *[
        F.coalesce(F.sum(f"w_{k}").over(before), F.lit(0)).alias(f"o_{k}") for k in sums])
    inside = Window.partitionBy("part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(offsets, [*group, "part"])
    return out.select(*[c for c in rows.columns if not c.startswith("w_")], *[
        (F.col(f"o_{k}") + F.coalesce(F.sum(f"w_{k}").over(inside), F.lit(0))).alias(k) for k in sums])


def _or_empty(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                source: str = "source", seed: int = SEED) -> DataFrame:
    """id, unnamed, name (the source), size and the row's hash-random key, written once."""
    body = F.col(f"`{text}`").cast("string")
    origin = F.col(f"`{source}`").cast("string")
    return materialize(docs.select(
        F.col(f"`{doc_id}`").alias("id"), origin.isNull().alias("unnamed"),
        F.coalesce(origin, F.lit("")).alias("name"),
        F.coalesce(F.regexp_count(body, F.lit(_WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), _or_empty(F.col(f"`{doc_id}`")), F.lit(":"),
                                          _or_empty(body))), 1, 15), 16, 10).cast("long").alias("key"),
        F.monotonically_increasing_id().alias("row")), "mix-entries")


def source_targets(entries: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET,
                   max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: unnamed, name, source_size, target (words, as a double).

    With level L every source gets min(max_epochs * size, L * weight).  In the order of cap / weight
    the sources fill up one after the other, so the level behind the first k of them is (budget -
    their caps) / (weights of the others), and the right k is the first whose next source is not full.
    """
    sizes = entries.groupBy(*_SOURCE).agg(F.sum("size").alias("source_size"))
    numbered = prefix_sums(sizes, _SOURCE, {"number": F.lit(1).cast("long")}, name="mix-sources")
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]),
                          (F.pmod("number", F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(int(max_epochs))
    facts = (numbered.withColumn("weight", weight).withColumn("cap", cap)
             .withColumn("ratio", F.col("cap") / F.col("weight")))
    filled = prefix_sums(facts, ["ratio", "number"], {"caps": F.col("cap"), "shares": F.col("weight")},
                         name="mix-levels")
    total = filled.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("shares")).first()
    if not total["shares"]:
        return filled.select(*_SOURCE, "source_size", F.col("cap").cast("double").alias("target"))
    level = ((F.lit(float(budget) * float(total["words"])) - F.col("caps"))
             / (F.lit(total["shares"]) - F.col("shares")))
    # the level rises until the right source and falls behind it; none is right if all are full
    best = filled.where(level <= F.col("ratio")).agg(F.max(level)).first()[0]
    share = F.col("weight") * F.lit(float("inf") if best is None else best)
    return filled.select(*_SOURCE, "source_size", F.least(F.col("cap").cast("double"), share).alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS,
        seed: int = SEED) -> DataFrame:
    """Per document: ``doc_id``, size, source_size, target (its source's), taken (words, repeats counted)."""
    entries = word_counts(docs, doc_id, text, source, seed)
    targets = materialize(source_targets(entries, weights, budget, max_epochs), "mix-targets")
    placed = prefix_sums(entries, [*_SOURCE, "key", "id", "row"], {"ahead": F.col("size")}, _SOURCE, "mix-sorted")
    words = F.round("target").cast("long")
    size, source_size = F.col("size"), F.col("source_size")
    epochs = F.when(source_size > 0, F.floor(words / source_size)).otherwise(F.lit(0)).cast("long")
    rest = words - epochs * source_size
    part = F.least(size, F.greatest(F.lit(0).cast("long"), rest - F.col("ahead")))
    return (placed.join(targets, _SOURCE)
            .select(F.col("id").alias(doc_id), "size", "source_size", "target",
                    (epochs * size + part).cast("long").alias("taken")))


ORACLE_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS unnamed, coalesce(source, '') AS name,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15)
              AS BIGINT) AS key FROM documents),
src AS (SELECT unnamed, name, CAST(sum(size) AS BIGINT) AS source_size,
               row_number() OVER (ORDER BY unnamed, name) - 1 AS number FROM sized GROUP BY unnamed, name),
facts AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][number % {len(WEIGHTS)} + 1] AS weight,
                 {MAX_EPOCHS} * source_size AS cap FROM src),
filled AS (SELECT *, cap / weight AS ratio,
  coalesce(sum(cap) OVER w, 0) AS caps, coalesce(sum(weight) OVER w, 0) AS shares,
  sum(source_size) OVER () AS words, sum(weight) OVER () AS all_shares
  FROM facts WINDOW w AS (ORDER BY cap / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (SELECT *, (CAST({BUDGET} AS DOUBLE) * CAST(words AS DOUBLE) - CAST(caps AS DOUBLE))
                  / CAST(all_shares - shares AS DOUBLE) AS level FROM filled),
best AS (SELECT max(level) AS level FROM lev WHERE level <= ratio),
goal AS (SELECT unnamed, name, source_size,
                least(CAST(cap AS DOUBLE), coalesce(best.level * weight, CAST(cap AS DOUBLE))) AS target
         FROM lev, best),
placed AS (SELECT sized.*, source_size, target, CAST(round(target) AS BIGINT) AS words,
                  coalesce(sum(size) OVER (PARTITION BY unnamed, name ORDER BY key, doc_id
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
           FROM sized JOIN goal USING (unnamed, name)),
turns AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS epochs FROM placed)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + least(size, greatest(0, words - epochs * source_size - ahead)) AS BIGINT) AS taken
FROM turns
"""

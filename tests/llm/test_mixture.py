import hashlib
import re
from fractions import Fraction

from txsentinel.llm import mixture


def expected(rows, weights=(3, 1, 2), budget=Fraction(3, 2)):
    """(target by source, taken by row): shares by weight, the excess reshared until none is above."""
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    names = sorted({s for _, _, s in rows if s is not None}) + ([None] if any(s is None for _, _, s in rows) else [])
    total = {n: sum(z for z, r in zip(sizes, rows) if r[2] == n) for n in names}
    weight = {n: weights[k % len(weights)] for k, n in enumerate(names)}
    target = {n: Fraction(0) for n in names}
    left, open_ = budget * sum(total.values()), set(names)
    while left and open_:
        shares = sum(weight[n] for n in open_)
        for n in open_:
            target[n] += left * weight[n] / shares
        left = Fraction(0)
        for n in list(open_):
            if target[n] >= 2 * total[n]:
                left += target[n] - 2 * total[n]
                target[n] = Fraction(2 * total[n])
                open_.discard(n)
    out = []
    for n in names:
        mine = sorted(((int(hashlib.md5(f"1:{'' if d is None else d}:{t or ''}".encode()).hexdigest()[:15], 16), z, d)
                       for (d, t, s), z in zip(rows, sizes) if s == n), key=lambda r: r[0])
        words = int(target[n] + Fraction(1, 2))
        epochs, rest = divmod(words, total[n]) if total[n] else (0, 0)
        for _, z, d in mine:
            part = min(z, rest)
            rest -= part
            out.append((d, z, total[n], round(float(target[n]), 6), epochs * z + part))
    return sorted(out, key=str)


def got(frame):
    return sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"])
                   for r in frame.collect()), key=str)


def test_targets_and_cuts(spark):
    rows = [(i, "wörd " * (i % 23) + "\t\n", "hot") for i in range(800)]
    rows += [(1000 + i, "a b  c\x0bd", ["b", "é", "Z", "", None, "tiny"][i % 6]) for i in range(120)]
    rows += [(None, None, "hot"), (None, "x y", None), (5, "again", "b"), (5, "again", "b"), (7, "", "wordless"),
             (8, "w " * 30_000, "long"), (9, None, "wordless"), (10, "  no break", "b")]
    docs = spark.createDataFrame([(d, t, s, 1, "k") for d, t, s in rows],
                                 "doc_id long, text string, source string, size int, key string").repartition(7)
    frame = mixture.mix(docs)
    assert got(frame) == expected(rows)
    assert got(mixture.mix(docs.repartition(3))) == got(frame)
    assert all(r["taken"] <= 2 * r["size"] for r in frame.collect())


def test_every_source_full(spark):
    rows = [(i, "w " * (i + 1), f"s{i % 3}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert all(r["taken"] == 2 * r["size"] for r in mixture.mix(docs, budget=5.0).collect())


def test_empty_and_wordless(spark):
    schema = "doc_id long, text string, source string"
    assert mixture.mix(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, None), (2, " ", "a")]
    assert got(mixture.mix(spark.createDataFrame(rows, schema))) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_native_plan_splits_a_hot_source(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('w ', CAST(id % 9 AS INT)) AS text", "'one' AS source")
    placed = mixture.prefix_sums(mixture.word_counts(docs), ["unnamed", "name", "key", "id", "row"],
                                 {"ahead": mixture.F.col("size")}, ["unnamed", "name"])
    assert placed.selectExpr("max(ahead + size)").first()[0] == sum(i % 9 for i in range(4000))
    plan = mixture.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExistingRDD"))
    parts = mixture.materialize(mixture.word_counts(docs).repartitionByRange(8, "unnamed", "name", "key")
                                .withColumn("p", mixture.F.spark_partition_id()), "t")
    assert parts.select("p").distinct().count() == 8

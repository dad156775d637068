import hashlib

import pytest
from pyspark.sql import functions as F

from txsentinel.llm import exact_tree
from txsentinel.session import materialize


def expected(rows, keep=max):
    groups = {}
    for doc_id, text in rows:
        norm = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        groups.setdefault(norm, []).append(doc_id)
    out = []
    for doc_id, text in rows:
        norm = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        ids = [i for i in groups[norm] if i is not None]
        best = keep(ids) if ids else None
        out.append((doc_id, best, len(groups[norm]), doc_id == best, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(1, "Ab"), (2, "aB"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "x" * 100_000), (8, "X" * 100_000),
        (9, "single"), (9, "single"), (None, "ab"), (None, "only null"), (10, " ab")]
ROWS += [(100 + i, "hot copy") for i in range(3000)]


@pytest.mark.parametrize("keep, pick", [("largest", max), ("smallest", min)])
def test_groups(spark, keep, pick):
    docs = spark.createDataFrame([(i, t, 0, "c") for i, t in ROWS],
                                 "doc_id long, text string, run int, sha string").repartition(40)
    got = exact_tree.exact_groups(docs, keep=keep).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=str) == expected(ROWS, pick)


def test_empty(spark):
    assert exact_tree.exact_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    p = plan(exact_tree.exact_groups(docs))
    assert "Python" not in p and "Arrow" not in p and "Pandas" not in p


def test_runs_are_sorted_and_merged_in_order(spark):
    docs = spark.createDataFrame([(i, f"text {i % 700}") for i in range(4000)], "doc_id long, text string").repartition(30)
    rows = materialize(exact_tree.digest_entries(docs), "rows")
    runs = exact_tree.first_runs(rows)
    assert "Sort" in plan(runs)
    levels = [materialize(runs, "runs")]
    for _ in range(exact_tree.RUN_BITS // exact_tree.FAN_BITS):
        met = exact_tree.merge_round(levels[-1])
        p = plan(met)  # a key-range exchange, a sort, one ordered pass; nothing is hashed together
        assert p.count("Exchange") == 1 and "rangepartitioning(run" in p
        assert p.count("Sort ") == 1 and p.count("Window ") == 1 and "Aggregate" not in p
        levels.append(materialize(met, "runs"))
    for k, level in enumerate(levels):
        files = {}
        for r in level.select(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("at"),
                              "run", *exact_tree.KEY).collect():
            files.setdefault(r["f"], []).append((r["at"], r["run"], bytes(r["sha"]), r["n_bytes"], r["check"]))
        for got in files.values():
            keys = [r[1:] for r in sorted(got)]
            assert keys == sorted(set(keys))  # in key order, one entry per key
        assert level.agg(F.sum("n")).first()[0] == 4000
        assert level.agg(F.max("run")).first()[0] < 1 << (exact_tree.RUN_BITS - k * exact_tree.FAN_BITS)
    p = plan(exact_tree.facts_for_rows(rows, levels))
    assert p.count("FileScan") == len(levels) + 1 and p.count("SortMergeJoin") == len(levels)
    assert "Aggregate" not in p and "Broadcast" not in p

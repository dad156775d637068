import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from txsentinel.llm import decontam


def substring_distance(pattern, text):
    """Least edit distance of the pattern to any substring, by the full table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=70), st.lists(st.integers(0, 3), max_size=90))
def test_myers_equals_the_table(pattern, text):
    best, end = decontam.myers_best(decontam._peq(pattern), len(pattern), text)
    assert best == substring_distance(pattern, text)
    if best < len(pattern):
        assert substring_distance(pattern, text[:end]) == best


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choices("abcdefgh", k=r.randint(1, 4))) for _ in range(n)]


def corpus():
    items = [(k, " ".join(words(n, k))) for k, n in enumerate([3, 5, 14, 30, 60, 90])] + [(6, None), (7, "..."), (3, " ".join(words(30, 3)))]
    docs, r = [], random.Random(1)
    for d in range(120):
        body = words(r.randint(0, 200), 1000 + d)
        if d % 2:
            k = r.randrange(6)
            own = items[k][1].split()
            for _ in range(r.randint(0, max(1, len(own) // 4))):
                at = r.randrange(len(own))
                own[at:at + 1] = r.choice([[], ["new"], [own[at], "more"]])
            at = r.randint(0, len(body))
            body[at:at] = [w.upper() + r.choice(["", ",", "!"]) for w in own]
        docs.append((d, "  ".join(body)))
    return items, docs + [(500, None), (501, ""), (502, " ".join(items[4][1].split() * 2000))]


@pytest.mark.parametrize("block_bytes", [50, 1 << 20])
def test_matches_brute_force(spark, block_bytes):
    items, docs = corpus()
    got = decontam.contaminated(
        spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, distance int"),
        spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes).collect()
    found = {(r["doc_id"], r["item_id"]): r["distance"] for r in got}
    assert len(found) == len(got)
    want = {}
    for d, text in docs:
        tw = [w.lower() for w in (text or "").replace(",", " ").replace("!", " ").split()][:2500]
        for k, item in {i for i in items}:
            p = [w for w in (item or "").replace(".", "").split()]
            if p and tw and (s := substring_distance(p, tw)) <= int(decontam.ERROR_SHARE * len(p)):
                want[d, k] = s
    assert found == want
    r = next(r for r in got if r["doc_id"] == 502 and r["item_id"] == 4)
    assert (r["distance"], r["end_word"] - r["start_word"]) == (0, 60)


def test_flags_keep_rows_and_columns(spark):
    items, docs = corpus()
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs + docs[:5]], "doc_id long, text string, lang string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    flagged = decontam.flag_contaminated(frame, bench, "__leak")
    assert flagged.columns == ["doc_id", "text", "lang", "__leak"] and flagged.count() == len(docs) + 5
    ids = {r["doc_id"] for r in flagged.where("__leak").select("doc_id").collect()}
    assert ids == {r["doc_id"] for r in decontam.contaminated(frame, bench).collect()}


def test_empty_sides(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(docs, none).count() == 0
    assert decontam.flag_contaminated(docs, none, "f").where("NOT f").count() == 1
    assert decontam.contaminated(docs.where("false"), spark.createDataFrame([(1, "a b")], none.schema)).count() == 0

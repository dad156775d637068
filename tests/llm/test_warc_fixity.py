import hashlib

from txsentinel.llm import warc_fixity as wf

SCHEMA = "page_id long, url string, html string, file string"


def pages(n=9000, step=1):
    return [(i, f"http://h{i % 7}/é{i}", "x" * (i % 90), "clash") for i in range(0, n, step)]


def run(spark, a, b):
    make = lambda rows: wf.warc_records(spark.createDataFrame(rows, SCHEMA))
    return wf.audit(make(a), make(b)).collect()


def record(page):
    i, url, html, _ = page
    body = html or ""
    return (f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{'' if i is None else i}>\r\n"
            f"WARC-Target-URI: {url or ''}\r\nContent-Type: text/html\r\n"
            f"Content-Length: {len(body.encode())}\r\n\r\n{body}\r\n\r\n").encode()


def test_equal_replicas_and_empty(spark):
    assert run(spark, pages(300), pages(300)[::-1]) == []
    assert run(spark, [], []) == []
    assert [r["status"] for r in run(spark, [], pages(2))] == ["extra", "extra"]


def test_damage_is_located_with_byte_ranges(spark):
    first = pages()
    second = [(i, u, h + "!" if i in (5, 4095, 4096) else h, f) for i, u, h, f in first if i not in (77, 8000)]
    second.append((20_000, "u", "h", ""))
    rows = {(r["file"], r["slot"]): r for r in run(spark, first, second)}
    assert {k: r["status"] for k, r in rows.items()} == {
        (0, 5): "changed", (0, 4095): "changed", (1, 0): "changed", (0, 77): "missing",
        (1, 8000 - 4096): "missing", (20_000 // 4096, 20_000 % 4096): "extra"}
    files = {f: b"".join(record(p) for p in first if p[0] // 4096 == f) for f in (0, 1)}
    for (f, slot), r in rows.items():
        if r["status"] == "extra":
            assert r["start"] is None and r["first_hash"] is None
            continue
        body = files[f][r["start"]:r["end"]]
        assert body == record(first[f * 4096 + slot]) and hashlib.sha256(body).hexdigest() == r["first_hash"]


def test_nulls_and_repeated_ids(spark):
    rows = [(None, None, None, ""), (None, "u", "h", ""), (3, "a", "b", ""), (3, "a", "b", ""), (3, "c", None, ""), (4, "d", "e", "")]
    assert run(spark, rows, rows[::-1]) == []
    got = run(spark, rows, [r for k, r in enumerate(rows) if k not in (1, 3)])
    assert sorted((r["file"], r["slot"], r["status"]) for r in got) == [(-1, 0, "changed"), (0, 3, "changed")]


def test_many_records_in_one_slot_take_one_bounded_row(spark):
    rows = [(None, f"u{i}", "h", "") for i in range(5000)] + [(8, "a", "b", "")] * 3000
    leaves = wf.leaves(wf.warc_records(spark.createDataFrame(rows, SCHEMA).repartition(9)))
    plan = leaves._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Exchange hashpartitioning(file") == 1
    assert sorted((r["file"], r["node"], len(r["hash"])) for r in leaves.collect()) == [(-1, 0, 64), (0, 8, 64)]
    assert run(spark, rows, rows[::-1]) == []
    one_less = [r for k, r in enumerate(rows) if k != 6000]         # one of 3000 equal copies is gone
    assert [(r["file"], r["slot"], r["status"]) for r in run(spark, rows, one_less)] == [(0, 8, "changed")]
    swapped = rows[1:] + [(None, "u1", "h", "")]                    # same number of records
    assert [(r["file"], r["status"]) for r in run(spark, rows, swapped)] == [(-1, "changed")]


def test_only_files_with_damage_are_descended(spark):
    levels = wf.merkle_levels(wf.warc_records(spark.createDataFrame(pages(9000, 3), SCHEMA)))
    assert [levels[-1].count(), levels[0].count()] == [3, 3000]
    assert levels[-1].agg({"length": "sum"}).first()[0] == sum(len(record(p)) for p in pages(9000, 3))

import hashlib
import random
import zlib
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from txsentinel.llm import turn_repair as tr

SPACE = " \t\n\x0b\x0c\r"


def least_edits(rows):
    """(cost, audit) by plain recursion over suffixes; rows: (initial, bad, cut)."""
    step = {"": ("u", "u"), "s": ("u", "u"), "u": ("a", "a"), "a": ("u", "u")}

    @lru_cache(None)
    def best(i, state, inserted):
        options = []
        if i == len(rows) and state in ("", "a"):
            options.append((0, ""))
        if inserted < 3:
            cost, audit = best(i, step[state][1], inserted + 1)
            options.append((cost + 5, "I" + audit))
        if i < len(rows):
            initial, bad, cut = rows[i]
            cost, audit = best(i + 1, state, 0)
            options.append((cost + 2, "D" + audit))
            if not bad:
                extra = 5 if cut else 0
                legal = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
                if initial and initial in legal:
                    cost, audit = best(i + 1, initial, 0)
                    options.append((cost + extra, "K" + audit))
                cost, audit = best(i + 1, step[state][0], 0)
                options.append((cost + 1 + extra, "R" + audit))
        return min(options) if options else (10 ** 9, "")

    for i in range(len(rows), -1, -1):          # shallow recursion
        for state in ("", "s", "u", "a"):
            best(i, state, 0)
    return best(0, "", 0)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(name.encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def expected(rows):
    hurt, result = damage(rows), {}
    for conv in {r[0] for r in rows}:
        mine = [r[1:] for r in hurt if r[0] == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(
            f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()))
        seen, faults = set(), []
        for _, role, text in mine:
            tail = text.rstrip(SPACE)
            faults.append("blank" if not tail else "duplicate" if (role, text) in seen
                          else "truncated" if tail[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in mine]
        cost, audit = least_edits(tuple((i, f in ("blank", "duplicate"), f == "truncated")
                                        for i, f in zip(initials, faults)))
        lines, state, k = [], "", 0
        for letter in audit:
            want = "assistant" if state == "u" else "user"
            if letter == "I":
                lines.append(want + ":")
                state = want[0]
                continue
            _, role, text = mine[k]
            k += 1
            if letter != "D":
                role = want if letter == "R" else role
                state = role[0]
                lines.append(f"{role}:{text}")
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        result[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
                        illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return result


def check(spark, rows, kind="long"):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows],
                                  f"conv_id {kind}, turn long, role string, text string, key string, row int")
    got = {r["conv_id"]: tuple(r)[1:] for r in tr.report(tr.damaged(frame.repartition(5))).collect()}
    assert got == expected(rows)
    return got


def conversation(conv, n, rng, turns=None):
    roles = ["user", "assistant", "system", "tool", "", None, "unknown"]
    texts = ["A full turn.", "ends nowhere", "", "  ", None, "Why?", "Long " * 400 + "."]
    return [(conv, t if turns is None else rng.choice(turns), rng.choices(roles, [9, 9, 3, 1, 1, 1, 1])[0],
             rng.choice(texts) if rng.random() < .4 else f"Turn {rng.randrange(50)}.") for t in range(n)]


def test_reports_match_brute_force(spark):
    rng = random.Random(5)
    rows = [r for conv in range(80) for r in conversation(conv, rng.randrange(1, 12), rng)]
    rows += conversation(None, 15, rng) + conversation(900, 30, rng, [None, 1, 2, 7])
    rows += [(901, None, None, None)] * 4 + [(902, 3, "user", "Same.")] * 9 + [(903, 5, "assistant", "é\x00漢.")]
    check(spark, rows)


def test_one_conversation_over_many_partitions(spark):
    rng = random.Random(7)
    rows = [r for conv in (1, 3) for r in conversation(conv, 6, rng)] + conversation(2, 900, rng)
    check(spark, rows)
    known = tr.facts(tr.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert tr.solved_runs(known).where("conv_id = 2").select("part").distinct().count() > 3


def test_text_ids_and_conversations_without_rows(spark):
    dropped = next(t for t in range(1000) if zlib.crc32(f"gone:{t}".encode()) % 20 == 0)
    got = check(spark, [("gone", dropped, "user", "Hello."), ("here", 1, "user", "Hi.")], "string")
    assert got["gone"] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_empty_table(spark):
    rows = tr.damaged(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert tr.report(rows).count() == 0 and tr.repaired_turns(rows).count() == 0


def test_repaired_turns_are_the_hashed_ones(spark):
    rows = tr.damaged(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    lines = {}
    for r in sorted(tr.repaired_turns(rows).collect(), key=lambda r: (r["conv_id"], r["position"])):
        assert r["position"] == len(lines.setdefault(r["conv_id"], []))
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for r in tr.report(rows).collect():
        text = "\n".join(lines.get(r["conv_id"], []))
        assert r["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest()


ROW = st.tuples(st.sampled_from("suax"), st.booleans(), st.booleans()).map(lambda r: (r[0], r[1], r[2] and not r[1]))


@settings(max_examples=200, deadline=None)
@given(st.lists(ROW, max_size=14), st.integers(1, 5))
def test_search_and_pieces_find_the_least_audit(rows, piece):
    want = least_edits(tuple(rows))
    assert tr.solve(rows, (tr.START,), tr.END, 64)[tr.START] == want
    assert tr.solve(rows, (tr.START,), tr.END, piece)[tr.START] == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(ROW, max_size=6), min_size=2, max_size=4))
def test_chained_runs_find_the_least_audit(parts):
    solutions, texts = [], {}
    for number, rows in enumerate(parts):
        run = tr._Run("c", number, number > 0)
        for k, (initial, bad, cut) in enumerate(rows):
            run.add(initial, "blank" if bad else "truncated" if cut else "", number * 10 + k)
        for s in run.solutions(True):
            texts[number, s["entry"], s["finish"]] = s["audit"]
            solutions.append(s)
    chosen = tr.chain(solutions)
    whole = tuple(r for rows in parts for r in rows)
    audit = "".join(texts[p["part"], p["entry"], p["finish"]] for p in chosen)
    assert (sum(p["cost"] for p in chosen), audit) == least_edits(whole)
    assert sum(p["illegal"] for p in chosen) == sum(
        a[0] + b[0] not in tr.LEGAL for a, b in zip(whole, whole[1:]))


@pytest.mark.parametrize("entry, end", [(tr.ASSISTANT, tr.START), (tr.USER, tr.SYSTEM)])
def test_ends_that_cannot_be_reached(entry, end):
    assert tr.solve([("u", False, False)] * 3, (entry,), end) == {}

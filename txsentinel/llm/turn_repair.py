"""Conversation structure repair by iterative-deepening A*.

A repaired conversation has roles system? (user assistant)+, or is empty.  Reading it from the left
is an automaton of four states; the role that must come next follows from the state, so Rerole and
Insert need no target.  Edits of a conversation are a path through (row, state); Delete costs 2,
Insert 5, Keep 0, Rerole 1, and an undeleted truncated row 5 more.

Search (``search``): depth first, edits in ASCII order (D, I, K, R), under a cost bound that grows to
the least cost seen beyond it.  The lower bound of the rest is the cost that the rows' faults force.
A table keeps what a failed visit has proven about a (row, state), over all bounds, and cuts later
visits.  The first accepting path is the cheapest, and the ASCII-least of the cheapest.

On Spark:

1. Rows become facts (role initial, fault, digest of role and text); texts stay behind.  Repeats are
   found by partial aggregation on the digest.
2. Facts are range-sorted by (conversation, turn, ...).  A conversation is not gathered: what a
   partition holds of it is a run, and only the first and last run of a partition can be part of a
   larger one.  Whole conversations are searched at once.  Runs at the edges are solved for every
   state they may begin and end in.
3. The edges' costs (at most 40 numbers per partition edge) are chained on the driver, which picks
   one solution per run: cheapest, then ASCII-least.
4. Long runs are searched in pieces of ``PIECE`` rows, from the last to the first: the least costs
   from the end of a piece are known when it is searched.  Every row ends its own edits in D, K or
   R, so no piece's audit is a prefix of another, and piecewise least is least overall.
5. The audit travels as a header ahead of its conversation's rows in one exchange of the texts; a
   task replays the edits while the rows stream past, holding one row.  (A SHA-256 of a whole
   conversation has to be taken by one task in any case.)

Defined results: null turns come first; rows of one turn are ordered by role, then by the SHA-256 of
role and text (equal rows are interchangeable); a null role or text reads as one space; a row counts
as a duplicate if any earlier row of the conversation has its role and text; the initial of an empty
role is empty and never legal; a null conversation id is a conversation; a conversation without rows
has zeros, an empty audit and the hash of the empty string; extra columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from txsentinel.session import materialize, shuffle_partitions

# automaton: what has been read so far
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: State after the role that the state asks for, and that role.
FORWARD = (USER, USER, ASSISTANT, USER)
WANTED = ("user", "user", "assistant", "user")
INF = 1 << 40
#: Costs of ending in each state, and of a run that something follows.
ACCEPTING = (0, INF, INF, 0)
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: Rows of one search.
PIECE = 64
FAULTS = ("blank", "duplicate", "truncated")
#: Ends that a run is solved for: the four states, or the end of the conversation.
END = 4

_SPACES = " \t\n\x0b\x0c\r"


def keeps(state: int, initial: str) -> int | None:
    """State after keeping a row with this role initial; None if it cannot be kept."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def search(rows: list[tuple[str, bool, bool]], entry: int, ends: tuple[int, ...],
           closing: bool) -> tuple[int, str, int] | None:
    """Cheapest edits of ``rows`` from state ``entry``: (cost, audit, state reached), or None.

    ``rows``: role initial, must be deleted, truncated.  ``ends``: cost of each state behind the last
    row.  Only a closing search may insert behind the last row.
    """
    n = len(rows)
    floor = [0] * (n + 1)
    floor[n] = min(ends) if not closing else 0
    for i in range(n - 1, -1, -1):
        floor[i] = floor[i + 1] + (DELETE if rows[i][1] else min(DELETE, TRUNCATED) if rows[i][2] else 0)
    if floor[n] >= INF:
        return None
    proven: dict[tuple[int, int], int] = {}
    path: list[str] = []
    reached = [entry]

    def edits(i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        if i == n:
            if closing:
                yield "I", INSERT, i, FORWARD[state]
            return
        initial, bad, cut = rows[i]
        extra = TRUNCATED if cut else 0
        yield "D", DELETE, i + 1, state
        yield "I", INSERT, i, FORWARD[state]
        if not bad:
            to = keeps(state, initial)
            if to is not None:
                yield "K", extra, i + 1, to
            yield "R", REROLE + extra, i + 1, FORWARD[state]

    def dive(i: int, state: int, left: int) -> int:
        """-1 if a path of cost ``left`` or less was found, else a lower bound above ``left``."""
        low = proven.get((i, state), floor[i])
        if low > left:
            return low
        low = INF
        if i == n:
            if ends[state] <= left:
                reached[0] = state
                return -1
            low = ends[state]
        for letter, cost, to_row, to_state in edits(i, state):
            path.append(letter)
            rest = dive(to_row, to_state, left - cost) if cost <= left else max(0, floor[to_row])
            if rest < 0:
                return -1
            path.pop()
            low = min(low, cost + rest)
        proven[i, state] = max(low, left + 1)
        return proven[i, state]

    limit = 7 * n + 2 * INSERT + max(e for e in ends if e < INF)
    bound = floor[0]
    while bound <= limit:
        found = dive(0, entry, bound)
        if found < 0:
            audit = "".join(path)
            return bound, audit, reached[0]
        bound = found
    return None


def solve(rows: list[tuple[str, bool, bool]], entries: tuple[int, ...], end: int,
          piece: int = PIECE) -> dict[int, tuple[int, str]]:
    """entry -> (cost, audit) of a run of any length that stops in state ``end`` (or END)."""
    costs = ACCEPTING if end == END else tuple(0 if s == end else INF for s in STATES)
    starts = list(range(0, len(rows), piece)) or [0]
    known = []
    for start in reversed(starts):
        closing = end == END and start == starts[-1]
        found = {s: search(rows[start:start + piece], s, costs, closing) for s in (STATES if start else entries)}
        known.append(found)
        costs = tuple(found[s][0] if found.get(s) else INF for s in STATES)
    out = {}
    for entry in entries:
        if costs[entry] < INF:
            audit, state = [], entry
            for found in reversed(known):
                _, letters, state = found[state]
                audit.append(letters)
            out[entry] = costs[entry], "".join(audit)
    return out


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, present: rows damaged by a hash of conversation and turn.

    Of the hash mod 20: 0 drops the row (it stays as a row that is not present), 1 empties the text, 2
    takes out ``.``, ``!`` and ``?``, 3 repeats the row, 4 sets the role to user.
    """
    def filled(name):
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(filled(conv_id), F.lit(":"), filled(turn))) % 20
    body = filled(text)
    rows = conversations.select(
        F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), kind.alias("kind"),
        F.when(kind == 4, "user").otherwise(filled(role)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(body, ".!?", "")).otherwise(body).alias("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", "role", "text", (F.col("kind") != 0).alias("present"),
                       F.explode(copies).alias("copy")).drop("copy")


def facts(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, initial, key (digest of role and text), fault and row of every row."""
    tail = F.rtrim(F.col("text"), F.lit(_SPACES))
    fault = (F.when(~F.col("present"), "absent").when(F.length(tail) == 0, "blank")
             .when(~F.right(tail, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise(""))
    plain = materialize(rows.select(
        "conv_id", "turn", "role", F.substring("role", 1, 1).alias("initial"), _key().alias("key"),
        fault.alias("fault"), F.monotonically_increasing_id().alias("row")), "turn-facts")
    # only keys that occur again are looked at; equal rows before the first one are none
    order = F.struct(F.col("turn").isNotNull(), "turn", "role", "key", "row")
    repeated = (plain.where("fault <> 'absent'").groupBy("conv_id", "key")
                .agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
                .select(F.col("conv_id").alias("c"), F.col("key").alias("k"), F.col("first.row").alias("first")))
    out = plain.join(repeated, plain["conv_id"].eqNullSafe(repeated["c"]) & (plain["key"] == repeated["k"]), "left")
    again = F.col("fault").isin("", "truncated") & (F.col("first") != F.col("row"))
    return out.select(*[plain[c] for c in plain.columns if c != "fault"],
                      F.when(again, "duplicate").otherwise(F.col("fault")).alias("fault"))


def _key():
    return F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))


#: Initials of neighbouring roles that may follow each other.
LEGAL = ("su", "ua", "au")
_SHARED: dict[tuple, tuple] = {}


class _Run:
    """What one partition holds of a conversation, row by row."""

    def __init__(self, conv, part: int, first: bool):
        self.conv, self.part, self.first = conv, part, first
        self.rows: list[tuple[str, bool, bool]] = []
        self.count = dict.fromkeys(FAULTS, 0)
        self.illegal, self.head, self.foot = 0, None, None
        self.low = self.high = None
        self.turns = 0

    def add(self, initial: str, fault: str, turn) -> None:
        if fault == "absent":
            return
        if fault:
            self.count[fault] += 1
        row = (initial, fault in ("blank", "duplicate"), fault == "truncated")
        self.rows.append(_SHARED.setdefault(row, row))      # few different ones: eight bytes a row
        if self.head is None:
            self.head = initial
        elif self.foot + initial not in LEGAL:
            self.illegal += 1
        self.foot = initial
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn

    def solutions(self, last: bool) -> Iterator[dict]:
        """One row for a whole conversation, one per entry and end for a run that may be a part."""
        common = {"conv_id": self.conv, "part": self.part, **self.count, "illegal": self.illegal, "head": self.head,
                  "foot": self.foot, "low": self.low, "high": self.high, "turns": self.turns}
        whole, entries = not (self.first or last), STATES if self.first else (START,)
        found = {end: solve(self.rows, entries, end) for end in ((*STATES, END) if last else (END,))}
        for entry in entries:
            ranked = sorted((f[entry][1], e) for e, f in found.items() if entry in f and e != END)
            place = {e: k for k, (_, e) in enumerate(ranked)}
            for end, best in found.items():
                if entry in best:
                    yield {**common, "whole": whole, "entry": entry, "finish": end, "cost": best[entry][0],
                           "audit": best[entry][1], "place": place.get(end, 0)}


def solved_runs(known: DataFrame) -> DataFrame:
    """Solutions of every run, in a table."""
    n = shuffle_partitions(known.sparkSession)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "key", "row"]
    frame = (known.repartitionByRange(n, *order).sortWithinPartitions(*order)
             .select("conv_id", "turn", "initial", "fault", F.spark_partition_id().alias("part")))
    conv, turn = known.schema["conv_id"].dataType, known.schema["turn"].dataType
    schema = T.StructType(
        [T.StructField("conv_id", conv), T.StructField("part", T.IntegerType()), T.StructField("whole", T.BooleanType())]
        + [T.StructField(c, T.IntegerType()) for c in ("entry", "finish", "place")]
        + [T.StructField(c, T.LongType()) for c in ("cost", *FAULTS, "illegal", "turns")]
        + [T.StructField(c, T.StringType()) for c in ("audit", "head", "foot")]
        + [T.StructField("low", turn), T.StructField("high", turn)])
    shape = to_arrow_schema(schema)

    def run(batches):
        current, first, out = None, True, []
        for batch in batches:
            for conv_id, turn, initial, fault, part in zip(*[c.to_pylist() for c in batch.columns]):
                if current is None or conv_id != current.conv:
                    if current is not None:
                        out += current.solutions(False)
                        first = False
                        if len(out) >= 1024:
                            yield pa.RecordBatch.from_pylist(out, shape)
                            out = []
                    current = _Run(conv_id, part, first)
                current.add(initial, fault, turn)
        if current is not None:
            out += current.solutions(True)
        if out:
            yield pa.RecordBatch.from_pylist(out, shape)

    return materialize(frame.mapInArrow(run, schema), "turn-runs")


def chain(parts: list[dict]) -> list[dict]:
    """The runs of one conversation, each with all its solutions -> one chosen solution per run.

    The chosen rows' counts add up over the conversation: what only shows between two runs (an illegal
    pair, a turn in both) is put on the later one.
    """
    runs: dict[int, list[dict]] = {}
    for p in parts:
        runs.setdefault(p["part"], []).append(p)
    order = sorted(runs)
    after, tails = (0, 0, 0, 0), {}
    for number in reversed(order):
        tails[number] = after
        last = number == order[-1]
        costs = [INF] * 4
        for p in runs[number]:
            if (p["finish"] == END) == last:
                costs[p["entry"]] = min(costs[p["entry"]], p["cost"] + (0 if last else after[p["finish"]]))
        after = tuple(costs)
    state, chosen, before = START, [], None
    for number in order:
        last = number == order[-1]
        options = [p for p in runs[number] if p["entry"] == state and (p["finish"] == END) == last]
        best = dict(min(options, key=lambda p: (p["cost"] + (0 if last else tails[number][p["finish"]]), p["place"])))
        state = best["finish"]
        if before is not None and best["head"] is not None:
            best["illegal"] += before["foot"] + best["head"] not in LEGAL if before["foot"] is not None else 0
            best["turns"] -= best["low"] is not None and best["low"] == before["high"]
        if best["head"] is not None:
            before = {"foot": best["foot"], "high": best["high"] if best["high"] is not None
                      else before and before["high"]}
        chosen.append(best)
    return chosen


def audits(rows: DataFrame) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    spark = rows.sparkSession
    runs = solved_runs(facts(rows))
    # rows of the two edge runs of each partition: bounded by the partitions, not by the table
    edges: dict = {}
    for r in runs.where("NOT whole").drop("audit").toLocalIterator():
        edges.setdefault(r["conv_id"], []).append(r.asDict())
    picked = [p for parts in edges.values() for p in chain(parts)]
    columns = ["conv_id", "part", "entry", "finish", "illegal", "turns"]
    schema = ", ".join(f"{c} {runs.schema[c].dataType.simpleString()}" for c in columns)
    table = spark.createDataFrame([tuple(p[c] for c in columns) for p in picked], schema)
    some, mine = runs.where("NOT whole"), table.alias("mine")
    meets = F.col("mine.conv_id").eqNullSafe(some["conv_id"])
    for c in ("part", "entry", "finish"):
        meets &= F.col(f"mine.{c}") == some[c]
    edge = some.join(F.broadcast(mine), meets).select(
        *[some[c] for c in runs.columns if c not in ("illegal", "turns")], "mine.illegal", "mine.turns")
    whole = runs.where("whole")
    pieces = F.sort_array(F.collect_list(F.struct("part", "audit")))
    span = F.max("high") - F.min("low") + 1 - F.sum("turns")
    return whole.unionByName(edge).groupBy("conv_id").agg(
        F.coalesce(span, F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(c).alias(c) for c in (*FAULTS, "illegal", "cost")],
        F.concat_ws("", F.transform(pieces, lambda p: p["audit"])).alias("audit"))


def _streams(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The header of every conversation, then its rows in order; one exchange on the conversation."""
    heads = found.select("conv_id", F.lit(0).alias("kind"), F.struct(*[c for c in found.columns if c != "conv_id"])
                         .alias("head"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("turn", "role", "text")],
                         F.lit(None).cast("binary").alias("key"))
    body = rows.where("present").select("conv_id", F.lit(1).alias("kind"),
                                        F.lit(None).cast(heads.schema["head"].dataType).alias("head"),
                                        "turn", "role", "text", _key().alias("key"))
    return (heads.unionByName(body).repartition("conv_id")
            .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "kind", F.col("turn").asc_nulls_first(),
                                  "role", "key")
            .select("conv_id", "head", "role", "text"))


def _replay(batches) -> Iterator[tuple]:
    """The edits of each conversation walked past its rows: (conv_id, head) opens a conversation,
    (role, text, edit) is a repaired row, () closes it."""
    audit, k, state = None, 0, START

    def inserts():
        nonlocal k, state
        while k < len(audit) and audit[k] == "I":
            yield WANTED[state], "", "I"
            state, k = FORWARD[state], k + 1

    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            for conv, head, role, text in zip(*[c.to_pylist() for c in part.columns]):
                if head is not None:
                    if audit is not None:
                        yield from inserts()
                        yield ()
                    audit, k, state = head["audit"], 0, START
                    yield conv, head
                    continue
                yield from inserts()
                letter, k = audit[k], k + 1
                if letter == "D":
                    continue
                role, state = (role, keeps(state, role[:1])) if letter == "K" else (WANTED[state], FORWARD[state])
                yield role, text, letter
    if audit is not None:
        yield from inserts()
        yield ()


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    out = []
    for row in rows:
        out.append(row)
        if len(out) == size:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), role, text, edit (K, R or I)."""
    schema = T.StructType([rows.schema["conv_id"], T.StructField("position", T.LongType())]
                          + [T.StructField(c, T.StringType()) for c in ("role", "text", "edit")])
    shape = to_arrow_schema(schema)

    def run(batches):
        def turns():
            conv, n = None, 0
            for event in _replay(batches):
                if len(event) == 2:
                    conv, n = event[0], 0
                elif event:
                    yield conv, n, *event
                    n += 1
        yield from _batches(turns(), shape, 256)

    return _streams(rows, audits(rows)).mapInArrow(run, schema)


def report(rows: DataFrame) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256
    (of the repaired ``role:text`` joined by newlines)."""
    found = audits(rows)
    schema = T.StructType([*found.schema.fields, T.StructField("repaired_sha256", T.StringType())])
    shape, names = to_arrow_schema(schema), found.columns[1:]

    def run(batches):
        def lines():
            conv = head = digest = None
            for event in _replay(batches):
                if len(event) == 2:
                    (conv, head), digest, lead = event, hashlib.sha256(), ""
                elif event:
                    digest.update(f"{lead}{event[0]}:{event[1]}".encode())
                    lead = "\n"
                else:
                    yield conv, *[head[c] for c in names], digest.hexdigest()
        yield from _batches(lines(), shape, 1024)

    return _streams(rows, found).mapInArrow(run, schema)


# ------------------------------------------------------------------ DuckDB ---
def _add(value: str, cost: str, letter: str, line: str) -> str:
    """A suffix solution {k: cost and audit, t: text} with one edit in front of it."""
    return (f"{{'k': lpad(CAST(CAST(substr({value}.k, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || '{letter}' "
            f"|| substr({value}.k, 10), 't': {line} || {value}.t}}")


def _sql() -> str:
    """The same result worked out from the last row to the first: per state the least (cost, audit)."""
    none = "{'k': '999999999~', 't': ''}"
    old = [f"b.v{s}" for s in STATES]
    crossed = []
    for s in STATES:
        ahead = old[FORWARD[s]]
        rerole = _add(ahead, "1 + r.extra", "R", f"'{WANTED[s]}:' || r.text || chr(10)")
        kept = "CASE r.initial " + " ".join(
            f"WHEN '{c}' THEN {_add(old[keeps(s, c)], 'r.extra', 'K', 'r.role || chr(58) || r.text || chr(10)')}"
            for c in "sua" if keeps(s, c) is not None) + f" ELSE {none} END"
        crossed.append(f"list_min([{_add(old[s], '2', 'D', repr(''))}, CASE WHEN r.bad THEN {none} ELSE {rerole} END, "
                       f"CASE WHEN r.bad THEN {none} ELSE {kept} END]) AS w{s}")
    inserted = []
    for s in STATES:
        one = _add(f"w{FORWARD[s]}", "5", "I", f"'{WANTED[s]}:' || chr(10)")
        after = FORWARD[FORWARD[s]]
        two = _add(f"w{after}", "10", "II", f"'{WANTED[s]}:' || chr(10) || '{WANTED[FORWARD[s]]}:' || chr(10)")
        inserted.append(f"list_min([w{s}, {one}, {two}]) AS v{s}")
    return rf"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)
              ORDER BY n) AS tab FROM (SELECT unnest(range(256)) AS n)),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
kinds AS (SELECT src.*, xor(list_reduce(list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT)),
            lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS kind FROM src, crc_table),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM kinds WHERE kind <> 0),
ordered AS (SELECT conv_id, turn, role, text, substr(role, 1, 1) AS initial,
                   rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS tail,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role,
                                      sha256(strlen(role) || ':' || role || text), copy) AS i FROM hurt),
faults AS (SELECT *, CASE WHEN tail = '' THEN 'blank'
                          WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                          WHEN right(tail, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                  lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM ordered),
rows_ AS (SELECT *, fault IN ('blank', 'duplicate') AS bad, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra
          FROM faults),
counts AS (SELECT conv_id, max(i) AS n,
                  coalesce(CAST(max(turn) - min(turn) + 1 - count(DISTINCT turn) AS BIGINT), 0) AS gaps,
                  count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                  count(*) FILTER (fault = 'truncated') AS truncated,
                  count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
           FROM rows_ GROUP BY conv_id),
best AS (
  SELECT conv_id, n AS i, {{'k': '000000000', 't': ''}} AS v0,
         {{'k': '000000010II', 't': 'user:' || chr(10) || 'assistant:' || chr(10)}} AS v1,
         {{'k': '000000005I', 't': 'assistant:' || chr(10)}} AS v2, {{'k': '000000000', 't': ''}} AS v3 FROM counts
  UNION ALL
  SELECT conv_id, i, {", ".join(inserted)} FROM (
    SELECT b.conv_id, b.i - 1 AS i, {", ".join(crossed)}
    FROM best b JOIN rows_ r ON b.conv_id IS NOT DISTINCT FROM r.conv_id AND b.i = r.i)),
solved AS (SELECT conv_id, v0 FROM best WHERE i = 0)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(CAST(substr(v0.k, 1, 9) AS BIGINT), 0) AS cost, coalesce(substr(v0.k, 10), '') AS audit,
       sha256(coalesce(substr(v0.t, 1, length(v0.t) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN solved s ON o.conv_id IS NOT DISTINCT FROM s.conv_id
"""


ORACLE_SQL = _sql()

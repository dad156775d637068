"""MinHash near-dedup with tensored banding.

* A document's set: 64-bit hashes of its distinct five-word shingles.
* Two small collections of ``SIDE`` hashes each are computed per distinct set,
  every one the combination of ``WIDTH`` minhashes.  Table (i, j) is keyed by
  the pair (left i, right j), so 2 * SIDE * WIDTH minhashes serve SIDE^2 tables
  of 2 * WIDTH minhashes each.  A pair at similarity s meets in some table with
  probability (1 - (1 - s^WIDTH)^SIDE)^2: 0.99998 at s = 0.85, 0.9998 at s = 0.8.
* A set can only meet another in a table if it shares a left hash, so right
  halves are attached only where a left hash is shared.
* Sets that meet form candidate groups (connected over table keys, each key as
  a star around its best connected member, never all pairs).  Groups of up to
  ``BLOCK`` sets are verified in one task; larger ones are cut into blocks, and
  every pair of blocks is a task, so all pairs of a group are decided exactly
  on full sets while no task holds more than two blocks.
* Verified links leave the tasks as spanning forests and are joined into
  classes by distributed connected components.

Exact copies (equal sets) are collapsed first, with partial aggregation, and
only one of them is compared.

Defined results: null, empty and wordless texts have no shingles and link with
nothing; texts under five words have their whole word sequence as one shingle;
rows with a null identifier take part in classes but cannot be kept; repeated
rows fall into one class; rows with one identifier and different texts are
different documents, each in the class of its own text; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txsentinel.llm.arrow_text import mix, slices, word_hashes
from txsentinel.llm.components import connected_components
from txsentinel.session import materialize

SHINGLE = 5
WIDTH, SIDE = 4, 18
#: Sets in one verification block.
BLOCK = 512

_U64 = np.uint64
_STEP = _U64(0xC2B2AE3D27D4EB4F)
_MULTIPLIERS = mix(np.arange(1, 2 * WIDTH * SIDE + 1).astype(_U64) * _U64(0x9E3779B97F4A7C15)) | _U64(1)


def shingle_sets(words: np.ndarray, doc: np.ndarray, rows: int,
                 size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, sorted inside each document; offsets of length rows + 1)."""
    n = len(words)
    counts = np.bincount(doc, minlength=rows)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    rolled = words.copy()
    full = np.zeros(n, bool)
    if n >= size:
        for k in range(1, size):
            rolled[:n - k] = rolled[:n - k] * _STEP + words[k:]
        full[:n - size + 1] = doc[:n - size + 1] == doc[size - 1:]
    values, owner = mix(rolled[full]), doc[full]
    short = np.flatnonzero((counts > 0) & (counts < size))
    whole = np.zeros(len(short), _U64)
    for at, d in enumerate(short.tolist()):
        h = _U64(int(counts[d]))
        with np.errstate(over="ignore"):
            for w in words[first[d]:first[d] + counts[d]]:
                h = h * _STEP + w
        whole[at] = h
    values = np.concatenate([values, mix(whole + _U64(0x51ED270B))])
    owner = np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(rows + 1))


def set_keys(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Two independent 64-bit hashes of every (non-empty) set, shape (sets, 2)."""
    out = np.zeros((len(off) - 1, 2), _U64)
    some = np.flatnonzero(off[1:] > off[:-1])
    if len(some):
        starts = off[some]
        out[some, 0] = mix(np.add.reduceat(mix(values ^ _U64(0xA5A5A5A5)), starts))
        out[some, 1] = mix(np.add.reduceat(mix(values * _STEP), starts))
    return out


def tensor_sketch(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Left and right collections of every set, shape (sets, 2 * SIDE); rows of empty sets are 0."""
    out = np.zeros((len(off) - 1, 2 * SIDE), _U64)
    some = np.flatnonzero(off[1:] > off[:-1])
    if not len(some):
        return out
    starts = off[some]
    for c in range(2 * SIDE):
        combined = np.zeros(len(some), _U64)
        for w in range(WIDTH):
            least = np.minimum.reduceat(values * _MULTIPLIERS[c * WIDTH + w], starts)
            combined = combined * _STEP + mix(least)
        out[some, c] = mix(combined)
    return out


def _rows(data: np.ndarray) -> pa.Array:
    """One list<int64> per row of a 2-d array."""
    flat = np.ascontiguousarray(data).view(np.int64)
    return pa.FixedSizeListArray.from_arrays(pa.array(flat.reshape(-1)), flat.shape[1]).cast(
        pa.list_(pa.int64()))


def text_hash(text: Column) -> Column:
    """What tells rows of one identifier apart."""
    return F.xxhash64(text.cast("string"))


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, text_hash, n_shingles, key (two longs), sketch (2 * SIDE longs) of every row."""
    body = F.col(f"`{text}`")
    frame = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), text_hash(body).alias("text_hash"),
                        body.cast("string").alias("body"))

    def run(batches):
        for batch in batches:
            for rows, buf, off in slices(batch, "body"):
                words, doc = word_hashes(buf, off)
                values, at = shingle_sets(words, doc, rows.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(np.diff(at), pa.int64()),
                     _rows(set_keys(values, at)), _rows(tensor_sketch(values, at))],
                    names=["id", "text_hash", "n_shingles", "key", "sketch"])

    return frame.mapInArrow(run, "id long, text_hash long, n_shingles long, key array<long>, sketch array<long>")


def candidate_edges(classes: DataFrame) -> DataFrame:
    """(a, b): every set that shares a table with others, with the centre of that table.

    The centre is the member that shares left hashes with the most sets; sets of one family then
    have few centres between them and the edges stay few.  ``classes``: node, sketch.
    """
    left = classes.select("node", F.posexplode(F.slice("sketch", 1, SIDE)).alias("i", "left"))
    shared = materialize(left.groupBy("i", "left").agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
                         "left-shared")
    hits = materialize(left.join(shared, ["i", "left"]), "left-hits")
    degree = hits.groupBy("node").agg(F.sum("n").alias("degree"))
    right = degree.join(classes, "node").select(
        "node", "degree", F.slice("sketch", SIDE + 1, SIDE).alias("rights"))
    tables = hits.select("node", "i", "left").join(right, "node").select(
        "node", "degree", F.posexplode("rights").alias("j", "right"), "i", "left")
    keyed = materialize(tables.select(
        "node", "degree", F.xxhash64("i", "j", "left", "right").alias("table")), "table-keys")
    centre = F.max(F.struct("degree", (-F.col("node")).alias("order"))).alias("c")
    stars = materialize(keyed.groupBy("table").agg(centre, F.count(F.lit(1)).alias("n"))
                        .where("n > 1").select("table", (-F.col("c.order")).alias("centre")), "table-stars")
    return (keyed.join(stars, "table").where("node <> centre")
            .select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct())


def linked_pairs(sets: list[np.ndarray], side: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Index pairs with 100 * intersection >= percent * union; across sides 0/1 only, or all pairs
    if there is one side.  Intersections are counted exactly with matrix products over the
    shingles that at least two of the sets hold."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    unique, column, held = np.unique(values, return_inverse=True, return_counts=True)
    use = held[column] > 1
    owner, column = owner[use], (np.cumsum(held > 1) - 1)[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    first = np.flatnonzero(side == 0)
    second = np.flatnonzero(side == 1) if side.any() else first
    where_first, where_second = np.full(n, -1), np.full(n, -1)
    where_first[first] = np.arange(len(first))
    where_second[second] = np.arange(len(second))
    common = np.zeros((len(first), len(second)), np.float32)
    total, step = int((held > 1).sum()), 4096
    for low in range(0, total, step):
        a, b = np.searchsorted(column, [low, low + step])
        o, c = owner[a:b], column[a:b] - low
        x = np.zeros((len(first), step), np.float32)
        own = where_first[o] >= 0
        x[where_first[o[own]], c[own]] = 1
        if second is first:
            common += x @ x.T
        else:
            y = np.zeros((len(second), step), np.float32)
            own = where_second[o] >= 0
            y[where_second[o[own]], c[own]] = 1
            common += x @ y.T
    inter = np.rint(common).astype(np.int64)
    union = sizes[first][:, None] + sizes[second][None, :] - inter
    for i, j in np.argwhere(100 * inter >= percent * union):
        if first[i] != second[j]:
            yield int(first[i]), int(second[j])


def forest(ids: list[int], pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Every linked id with the smallest id of its component (itself left out)."""
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            if ids[b] < ids[a]:
                a, b = b, a
            root[b] = a
    return [(ids[k], ids[find(k)]) for k in range(len(ids)) if find(k) != k]


def verified_links(docs: DataFrame, members: DataFrame, percent: int, doc_id: str, text: str,
                   block: int = BLOCK) -> DataFrame:
    """(a, b) spanning links of the truly similar sets inside each candidate group.

    ``members``: node, rep and text_hash (a row that holds the set), key, grp (group), n_group (its size).
    """
    blocks = F.ceil(F.col("n_group") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(F.lit(7), F.col("node")), F.col("blocks")).cast("int")
    dealt = (members.withColumn("blocks", blocks).withColumn("own", own)
             .select("node", "rep", "text_hash", F.col("key").alias("want"), "grp", "own", "blocks"))
    body = F.col(f"`{text}`")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), text_hash(body).alias("seen"),
                       body.cast("string").alias("body"))
    # the same exchange of the texts at every size, not a broadcast while there are few candidates
    rows = rows.join(dealt.hint("merge"), (rows["id"] == dealt["rep"]) & (rows["seen"] == dealt["text_hash"])).select(
        "node", "want", "grp", "own", "blocks", "body")

    def to_sets(batches):
        for batch in batches:
            for part, buf, off in slices(batch, "body"):
                words, doc = word_hashes(buf, off)
                values, at = shingle_sets(words, doc, part.num_rows)
                want = np.array(part.column(1).to_pylist(), np.int64).view(_U64).reshape(-1, 2)
                same = pa.array((set_keys(values, at) == want).all(1))
                out = pa.RecordBatch.from_arrays(
                    [part.column(0), *part.columns[2:5],
                     pa.array([values[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())],
                    names=["node", "grp", "own", "blocks", "shingles"])
                yield out.filter(same)

    sets = rows.mapInArrow(to_sets, "node long, grp long, own int, blocks int, shingles binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tasks = (sets.withColumn("other", other)
             .select("grp", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"),
                     "node", "own", "shingles")
             .repartition("grp", "p", "q").sortWithinPartitions("grp", "p", "q", "node"))

    def decide(held: list[dict]) -> list[tuple[int, int]]:
        nodes = {r["node"]: r for r in held}          # repeated rows of a document count once
        held = list(nodes.values())
        if len(held) < 2:
            return []
        side = np.array([int(r["own"] != r["p"]) for r in held])
        if held[0]["p"] != held[0]["q"] and (side.all() or not side.any()):
            return []
        return forest([r["node"] for r in held],
                      linked_pairs([np.frombuffer(r["shingles"], _U64) for r in held], side, percent))

    def verify(batches):
        key, held = None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                now = (row["grp"], row["p"], row["q"])
                if now != key and held:
                    out += decide(held)
                    held = []
                key = now
                held.append(row)
            if out:
                yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in out], _EDGE)
        if out := decide(held):
            yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in out], _EDGE)

    return tasks.mapInArrow(verify, "a long, b long")


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def near_duplicates(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text",
                    block: int = BLOCK) -> DataFrame:
    """``doc_id``, n_shingles, component_id (smallest identifier reachable over links of at least
    ``percent`` similarity), kept (the document is that one) and text_hash, one row per input row."""
    found = materialize(sketches(docs, doc_id, text), "sketches")
    holder = F.when(F.col("id").isNotNull(), F.struct("id", "text_hash"))
    # a node is a set, whatever rows and identifiers hold it
    classes = materialize(found.where("n_shingles > 0").groupBy("key", "n_shingles")
                          .agg(F.min(holder).alias("holder"), F.first("sketch").alias("sketch"))
                          .where("holder IS NOT NULL")
                          .select(F.monotonically_increasing_id().alias("node"), F.col("holder.id").alias("rep"),
                                  "holder.text_hash", "key", "n_shingles", "sketch"), "classes")
    edges = candidate_edges(classes)
    groups = connected_components(edges)
    sizes = materialize(groups.groupBy("component").agg(F.count(F.lit(1)).alias("n_group")), "group-sizes")
    members = materialize(
        groups.join(sizes, "component").join(classes.select("node", "rep", "text_hash", "key"), "node")
        .select("node", "rep", "text_hash", "key", F.col("component").alias("grp"), "n_group"), "members")
    links = materialize(verified_links(docs, members, percent, doc_id, text, block), "links")
    final = connected_components(links)
    joined = materialize(classes.select("key", "n_shingles", "rep", "node").join(final, "node", "left")
                         .withColumn("component", F.coalesce("component", "node")), "class-components")
    names = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = materialize(joined.join(names, "component").select("key", "n_shingles", "component_id"), "class-names")
    out = found.join(named, ["key", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(doc_id), "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"), "text_hash")

"""Removal of repeated long byte strings with external induced sorting.

A byte goes if a ``length``-byte string that covers it also starts anywhere
else, in any document.  Strings are judged on the input.

1. Every text is cut into runs of string starts that share a minimizer (the
   left-most occurrence of the smallest hash of a ``GRAM``-byte gram inside the
   string).  Equal strings have equal minimizers at equal places, so only runs
   with the same minimizer hash can hold equal strings.  A run and the region
   its strings cover are bounded by 2 * ``length`` bytes.
2. Regions with equal minimizer and equal content are counted first (partial
   aggregation): from two on, all their strings repeat, and one of them stands
   for all.
3. Where a minimizer has several different regions, one of each goes to a shard
   chosen by the minimizer.  Shards are sorted with ``induced_sort`` (suffix and
   LCP arrays, disk-backed queues); neighbours among the string starts whose
   common prefix reaches ``length`` are repeats.
4. Minimizers with more than ``HOT_REGIONS`` different regions do not fit a
   shard; their strings are counted by content hash instead (a window per string),
   which spreads one passage over all tasks.
5. Spans go back to their documents, which return what is left.

Joins are sort-merge joins at every size (skewed keys are split by AQE); the two
joins with the documents (three, if step 4 has work) read one exchange of the texts.

Content is compared through 64-bit hashes in steps 1, 2 and 4 and byte by byte
in the sort of step 3.  Defined results: null text counts as empty; texts
shorter than ``length`` are never touched; repeated rows repeat each other's
strings like any two documents; extra columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txsentinel.llm.arrow_text import prefix_hash, range_hash, slices
from txsentinel.llm.induced_sort import suffix_array
from txsentinel.session import materialize

LENGTH = 400
GRAM = 32
#: Text of one shard, on average.
SHARD_BYTES = 4 << 20
#: Different regions of one minimizer that still go to a shard together.
HOT_REGIONS = 4096

_U64 = np.uint64
_PLACE = _U64((1 << 24) - 1)
_SEGMENT = 1 << 23
#: Never part of UTF-8.
_SEPARATOR = 0xFF


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values (blockwise running minima)."""
    n = len(values)
    grid = np.concatenate([values, np.full(-n % width, ~_U64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, 1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def minimizer_runs(grams: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, minimizer hash) of the runs of one text with at least
    ``length`` bytes; ``grams``: hashes of all its grams."""
    width = length - gram + 1
    starts, counts, hashes = [], [], []
    windows = len(grams) - width + 1
    for low in range(0, windows, _SEGMENT):
        part = grams[low:min(low + _SEGMENT, windows) + width - 1]
        place = np.arange(len(part), dtype=np.uint64)
        least = _window_minima((part & ~_PLACE) | place, width)
        at = (least & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        starts.append(first + low)
        counts.append(np.diff(np.append(first, len(at))))
        hashes.append(part[at[first]])
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(hashes)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """rk (a key of identifier and content, alike for repeated rows), the identifier, bytes."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select(F.xxhash64(F.col(f"`{doc_id}`"), body).alias("rk"),
                       F.col(f"`{doc_id}`").alias("id"), body.cast("binary").alias("body"))


def _document_regions(start, n, h, g, length: int):
    """The distinct (h, g) of one text: first start, starts, hashes, times, and for those met
    several times (periodic texts) the union of their regions."""
    order = np.lexsort((start, g, h))
    start, n, h, g = start[order], n[order], h[order], g[order]
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])))
    times = np.diff(np.append(first, len(h)))
    more = [None] * len(first)
    for k in np.flatnonzero(times > 1).tolist():
        a, b = first[k], first[k] + times[k]
        end = start[a:b] + n[a:b] - 1 + length
        cut = np.flatnonzero(start[a + 1:b] > end[:-1])
        more[k] = [{"s": int(s), "e": int(e)} for s, e in
                   zip(start[a:b][np.append(0, cut + 1)], end[np.append(cut, b - a - 1)])]
    return start[first], n[first], h[first], g[first], times, more


def region_runs(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """Distinct regions of every text: rk, start (the first), n (string starts), h (minimizer
    hash), g (region hash), times it occurs, more (their union, if it occurs several times)."""
    def run(batches):
        for batch in batches:
            for rows, buf, off in slices(batch, "body"):
                if len(buf) < length:
                    continue
                prefix = prefix_hash(buf)
                at = np.arange(len(buf) - gram + 1)
                grams = range_hash(prefix, at, at + gram)
                keys = rows.column(0).to_numpy(zero_copy_only=False)
                out, more = [], []
                for d in np.flatnonzero(np.diff(off) >= length).tolist():
                    low, high = int(off[d]), int(off[d + 1])
                    start, n, h = minimizer_runs(grams[low:high - gram + 1], length, gram)
                    g = range_hash(prefix, low + start, low + start + n - 1 + length)
                    *own, spans = _document_regions(start, n, h, g, length)
                    out.append((np.full(len(own[0]), keys[d]), *own))
                    more += spans
                if out:
                    rk, start, n, h, g, times = (np.concatenate(p) for p in zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rk), pa.array(start), pa.array(n.astype(np.int32)),
                         pa.array(h.view(np.int64)), pa.array(g.view(np.int64)),
                         pa.array(times.astype(np.int32)), pa.array(more, _MORE)],
                        names=["rk", "start", "n", "h", "g", "times", "more"])

    return keyed.select("rk", "body").mapInArrow(
        run, "rk long, start long, n int, h long, g long, times int, more array<struct<s:bigint,e:bigint>>")


def shard_repeats(regions: list[bytes], starts: list[int], length: int) -> list[np.ndarray]:
    """For every region (its first ``starts`` positions count) the starts whose string repeats."""
    separator = bytes([_SEPARATOR])
    text = np.frombuffer(separator.join(regions) + separator, np.uint8)
    size = np.array([len(r) + 1 for r in regions])
    base = np.cumsum(size) - size
    order, lcp = suffix_array(text, cap=length)
    region = np.searchsorted(base, order, side="right") - 1
    counts = order - base[region] < np.array(starts)[region]
    # neighbours among the counted suffixes: the least common prefix over what lies between
    kept = np.flatnonzero(counts)
    if not len(kept):
        return [np.zeros(0, np.int64) for _ in regions]
    # (not over what lies behind the last of them, where the separators' suffixes begin)
    low = np.minimum.reduceat(lcp[:kept[-1] + 1], np.append(0, kept[:-1] + 1))
    repeat = np.zeros(len(kept), bool)
    same = low[1:] >= length
    repeat[1:] |= same
    repeat[:-1] |= same
    found = np.sort(order[kept[repeat]])
    cuts = np.searchsorted(found, np.append(base, len(text)))
    return [found[a:b] - s for a, b, s in zip(cuts, cuts[1:], base)]


def _ranges(values: np.ndarray) -> list[tuple[int, int]]:
    """[first, last] of the runs of consecutive values."""
    if not len(values):
        return []
    cut = np.flatnonzero(np.diff(values) > 1)
    return list(zip(values[np.append(0, cut + 1)].tolist(), values[np.append(cut, len(values) - 1)].tolist()))


_MORE = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
_SPANS = "rk long, s long, e long"


def _spans(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)],
                                      names=["rk", "s", "e"])


def sorted_spans(regions: DataFrame, shards: int, length: int) -> DataFrame:
    """Repeats inside regions (rk, start, n, h, region, single): one induced sort per shard."""
    dealt = (regions.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int"))
             .repartition(shards, "shard").sortWithinPartitions("shard")
             .select("shard", "rk", "id", "start", "n", "single", "region"))

    def decide(held: list[dict]):
        found = shard_repeats([r["region"] for r in held], [r["n"] for r in held], length)
        return [(r["rk"], r["start"] + a, r["start"] + b + length)
                for r, f in zip(held, found) if r["single"] for a, b in _ranges(f)]

    def run(batches):
        shard, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard and held:
                    yield _spans(decide(held))
                    held = []
                shard = row["shard"]
                held.append(row)
        if held:
            yield _spans(decide(held))

    return dealt.mapInArrow(run, _SPANS)


def counted_spans(regions: DataFrame, length: int) -> DataFrame:
    """Repeats inside the regions of very common minimizers, by counting string hashes."""
    def explode(batches):
        for batch in batches:
            for rows, buf, off in slices(batch, "region"):
                prefix = prefix_hash(buf)
                n = np.array(rows.column(2).to_pylist(), np.int64)
                owner = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                at = off[owner] + place
                w = range_hash(prefix, at, at + length)
                rk = rows.column(0).to_numpy(zero_copy_only=False)[owner]
                start = rows.column(1).to_numpy(zero_copy_only=False)[owner] + place
                single = np.array(rows.column(3).to_pylist(), bool)[owner]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w.view(np.int64)), pa.array(rk), pa.array(start), pa.array(single)],
                    names=["w", "rk", "start", "single"])

    # one pass over the strings, in the same query as the joins with the documents: written ones would
    # be a query of their own, with its own exchange of all texts
    strings = regions.select("rk", "start", "n", "single", "region", "id").mapInArrow(
        explode, "w long, rk long, start long, single boolean")
    times = F.sum(F.when(F.col("single"), 1).otherwise(2)).over(Window.partitionBy("w"))
    return (strings.withColumn("k", times).where("single AND k > 1")
            .select("rk", F.col("start").alias("s"), (F.col("start") + length).alias("e")))


def repeated_spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM,
                   hot_regions: int = HOT_REGIONS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """rk, s, e: byte ranges to remove (they may overlap)."""
    runs = materialize(region_runs(keyed, length, gram), "regions")
    groups = materialize(runs.groupBy("h").agg(F.sum("times").alias("k"), F.min("g").alias("a"),
                                               F.max("g").alias("b"))
                         .where("k > 1").select("h", (F.col("a") != F.col("b")).alias("mixed")), "shared-grams")
    shared = materialize(runs.join(groups.hint("merge"), "h"), "shared-regions")
    first = F.min(F.struct("rk", "start", "n")).alias("first")
    classes = materialize(shared.groupBy("h", "g").agg(first, F.sum("times").alias("k"),
                                                       F.first("mixed").alias("mixed")), "region-classes")
    # two equal regions: all of their strings repeat
    copies = classes.where("k > 1").select("h", "g")
    own = F.array(F.struct(F.col("start").alias("s"), (F.col("start") + F.col("n") - 1 + length).alias("e")))
    whole = shared.join(copies.hint("merge"), ["h", "g"], "left_semi").select(
        "rk", F.inline(F.coalesce("more", own)))
    # several different regions of a minimizer: one of each is compared
    mixed = classes.where("mixed").select("h", "first.*", (F.col("k") == 1).alias("single"))
    hot = materialize(mixed.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > hot_regions)
                      .select("h"), "hot-grams")
    total, any_hot = (mixed.agg(F.coalesce(F.sum(F.col("n") + length), F.lit(0))).first()[0],
                      hot.limit(1).count() > 0)
    asked = materialize(mixed.join(hot.withColumn("hot", F.lit(True)), "h", "left")
                        .withColumn("hot", F.coalesce("hot", F.lit(False))), "asked-regions")

    def text_of(rows: DataFrame) -> DataFrame:
        place = F.substring(F.col("body"), (F.col("start") + 1).cast("int"), F.col("n") - 1 + length)
        # rows that repeat a document answer once; the identifier goes along so that this join and
        # the last one read one and the same exchange of the documents
        return (keyed.join(rows.hint("merge"), "rk")
                .select("rk", "id", "start", "n", "h", "single", place.alias("region"))
                .dropDuplicates(["rk", "start"]))

    shards = max(1, -(-total // shard_bytes))
    found = whole.unionByName(sorted_spans(text_of(asked.where("NOT hot")), shards, length))
    if any_hot:
        found = found.unionByName(counted_spans(text_of(asked.where("hot")), length))
    return found


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
                   gram: int = GRAM, hot_regions: int = HOT_REGIONS,
                   shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``doc_id``, n_bytes, spans (start, end of maximal removed runs), kept (remaining bytes)."""
    keyed = _keyed(docs, doc_id, text)
    found = repeated_spans(keyed, length, gram, hot_regions, shard_bytes)
    spans = found.groupBy("rk").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("spans"))
    together = keyed.join(spans.hint("merge"), "rk", "left").select(
        F.col("id"), F.coalesce("spans", F.array().cast("array<struct<s:bigint,e:bigint>>")).alias("spans"),
        "body")

    def cut(batches):
        for batch in batches:
            spans, bodies = batch.column(1).to_pylist(), batch.column(2)
            merged, kept, size = [], [], []
            for i, own in enumerate(spans):
                body = bodies[i].as_buffer().to_pybytes()
                runs: list[dict] = []
                for span in own:
                    if runs and span["s"] <= runs[-1]["e"]:
                        runs[-1]["e"] = max(runs[-1]["e"], span["e"])
                    else:
                        runs.append(dict(span))
                at, parts = 0, []
                for r in runs:
                    parts.append(body[at:r["s"]])
                    at = r["e"]
                kept.append(b"".join([*parts, body[at:]]))
                merged.append(runs)
                size.append(len(body))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()),
                 pa.array(merged, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
                 pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    kind = docs.schema[doc_id].dataType.simpleString()
    out = together.mapInArrow(cut, f"id {kind}, n_bytes bigint, spans array<struct<s:bigint,e:bigint>>, kept binary")
    return out.withColumnRenamed("id", doc_id)

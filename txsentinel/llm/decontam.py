"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are read as words (runs of letters and digits after
lower-casing; punctuation and white space separate).  An item of n words has an
error budget k = floor(``ERROR_SHARE`` * n) word insertions, deletions or
substitutions.  It is split into k + 1 pieces: whatever the k errors do, one
piece occurs unchanged in a text that holds the item within budget.  Piece hits
are found with rolling word hashes against sorted piece tables, and every place
they point at is verified with Myers' bit-parallel edit distance (semi-global:
the item anywhere inside the text).

Items are a stated query set: they are read to the driver in blocks of at most
``BLOCK_BYTES`` of text, and the documents are scanned once per block without
any shuffle.

Defined results: null or wordless texts and items match nothing; identical item
rows count once; items below ``1 / ERROR_SHARE`` words must occur exactly;
repeated documents give repeated rows; extra columns are not read (or pass
through, in ``flag_contaminated``); no items or no documents give no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txsentinel.llm.arrow_text import fresh_names, give_back, mix, span_hashes, word_spans

#: Share of an item's words that may differ.
ERROR_SHARE = 0.2
#: Text of the items that one scan of the documents carries.
BLOCK_BYTES = 16 << 20
SLICE_CHARS = 1 << 20

_U64 = np.uint64
_STEP = _U64(0xC2B2AE3D27D4EB4F)
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit word hash, text index) of all words of ``texts``."""
    raw = [(t or "").lower().encode() for t in texts]
    off = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=off[1:])
    buf = np.frombuffer(b"".join(raw), np.uint8)
    separator = _SEPARATOR[buf]
    # general punctuation U+2000-203F, CJK punctuation U+3000-303F, Latin-1 symbols U+0080-00BF
    for lead, second in ((0xE2, 0x80), (0xE3, 0x80)):
        at = np.flatnonzero((buf[:-1] == lead) & (buf[1:] == second)) if len(buf) > 2 else []
        for k in range(3):
            separator[np.asarray(at, np.int64) + k] = True
    at = np.flatnonzero(buf == 0xC2)
    separator[at] = True
    separator[at + 1] = True
    start, end, doc = word_spans(buf, off, separator)
    return span_hashes(buf, start, end), doc


def pieces_of(n: int, budget: int) -> list[tuple[int, int]]:
    """budget + 1 nearly equal, non-empty (offset, length) pieces of n words."""
    cuts = [n * i // (budget + 1) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a]


def myers_best(peq: dict[int, int], m: int, text: list[int]) -> tuple[int, int]:
    """Least edit distance of the pattern to a substring of ``text``, and the first end of one."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def _peq(words: list[int]) -> dict[int, int]:
    table: dict[int, int] = defaultdict(int)
    for i, w in enumerate(words):
        table[w] |= 1 << i
    return dict(table)


class ItemTable:
    """Pieces of a block of items, by length, with what verification needs."""

    def __init__(self, items: list[tuple[int, str]], error_share: float = ERROR_SHARE):
        codes, owner = word_codes([text for _, text in items])
        cuts = np.searchsorted(owner, np.arange(len(items) + 1))
        self.items = []
        by_length: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for (item_id, _), a, b in zip(items, cuts, cuts[1:]):
            words = codes[a:b]
            if not len(words):
                continue
            budget = int(error_share * len(words))
            k = len(self.items)
            forward = words.tolist()
            self.items.append((item_id, len(words), budget, _peq(forward), _peq(forward[::-1])))
            for offset, length in pieces_of(len(words), budget):
                key = int(rolling(words[offset:offset + length], length)[0])
                by_length[length][key].append((k, offset))
        self.pieces = {}
        for length, table in sorted(by_length.items()):
            keys = np.array(sorted(table), _U64)
            # most places of a text are ruled out by a bitmap of 64 cells a key (4 MB at most)
            seen = np.zeros(1 << min(22, 6 + len(keys).bit_length()), bool)
            seen[keys & _U64(len(seen) - 1)] = True
            self.pieces[length] = (keys, seen, [table[int(x)] for x in keys])

    def matches(self, codes: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, tuple]]:
        """(text index, (item, distance, item words, start word, end word)), one per text and item."""
        places: dict[tuple[int, int], list[int]] = defaultdict(list)
        for length, (keys, seen, users) in self.pieces.items():
            if len(codes) < length:
                continue
            rolled = rolling(codes, length)
            at = np.flatnonzero(seen[rolled & _U64(len(seen) - 1)])
            at = at[owner[at] == owner[at + length - 1]]
            slot = np.searchsorted(keys, rolled[at])
            hit = slot < len(keys)
            hit[hit] = keys[slot[hit]] == rolled[at[hit]]
            for i, s in zip(at[hit].tolist(), slot[hit].tolist()):
                for k, offset in users[s]:
                    places[int(owner[i]), k].append(i - offset)
        if not places:
            return
        bounds = np.searchsorted(owner, np.arange(int(owner[-1]) + 2))
        for (doc, k), starts in sorted(places.items()):
            item_id, n, budget, peq, reverse = self.items[k]
            low, high = int(bounds[doc]), int(bounds[doc + 1])
            best = (budget + 1, 0, 0)
            for a, b in _windows(starts, n, budget, low, high):
                text = codes[a:b].tolist()
                distance, end = myers_best(peq, n, text)
                if distance < best[0]:
                    # the same distance on the reversed prefix gives the start
                    _, back = myers_best(reverse, n, text[:end][::-1][:n + budget])
                    best = (distance, a + end - back - low, a + end - low)
            if best[0] <= budget:
                yield doc, (item_id, best[0], n, best[1], best[2])


def rolling(codes: np.ndarray, length: int) -> np.ndarray:
    """64-bit hash of every run of ``length`` consecutive words."""
    n = len(codes) - length + 1
    out = codes[:n].copy()
    for j in range(1, length):
        out *= _STEP
        out += codes[j:j + n]
    return mix(out)


def _windows(starts: list[int], n: int, budget: int, low: int, high: int):
    """Merged word ranges in which an item that a piece places at ``starts`` can lie."""
    a = b = None
    for s in sorted(starts):
        x, y = max(low, s - budget), min(high, s + n + budget)
        if b is not None and x <= b:
            b = max(b, y)
            continue
        if b is not None:
            yield a, b
        a, b = x, y
    if b is not None:
        yield a, b


def item_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text",
                block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The distinct items in blocks of bounded text, read one partition at a time."""
    rows = (items.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{text}`").alias("body"))
            .where(F.col("body").isNotNull()).distinct())
    block, held = [], 0
    for row in rows.toLocalIterator():
        block.append((row["item"], row["body"]))
        held += len(row["body"])
        if held >= block_bytes:
            yield block
            block, held = [], 0
    if block:
        yield block


_FOUND = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("distance", T.LongType()),
    T.StructField("item_words", T.LongType()), T.StructField("start_word", T.LongType()),
    T.StructField("end_word", T.LongType())]))
_FOUND_ARROW = pa.list_(pa.struct([(f.name, pa.int64()) for f in _FOUND.elementType.fields]))


def _text_slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list]]:
    texts = batch.column(batch.num_columns - 1).to_pylist()
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= SLICE_CHARS or i + 1 == len(texts):
            yield batch.slice(start, i + 1 - start), texts[start:i + 1]
            start, held = i + 1, 0
    give_back()


def _scan(docs: DataFrame, block: list[tuple[int, str]], carried: list[T.StructField], text: str,
          error_share: float, found_col: str) -> DataFrame:
    """``carried`` columns plus ``found_col``: the items of the block that each row holds."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    body = fresh_names([f.name for f in carried], "body")[0]
    frame = docs.select(*[F.col(f"`{f.name}`") for f in carried],
                        F.col(f"`{text}`").cast("string").alias(body))

    def scan(batches):
        table = ItemTable(shared.value, error_share)
        for batch in batches:
            for rows, texts in _text_slices(batch):
                found: list[list] = [[] for _ in texts]
                codes, owner = word_codes(texts)
                names = [f.name for f in _FOUND.elementType.fields]
                for doc, match in table.matches(codes, owner):
                    found[doc].append(dict(zip(names, match)))
                yield pa.RecordBatch.from_arrays(rows.columns[:-1] + [pa.array(found, _FOUND_ARROW)],
                                                 names=rows.schema.names[:-1] + [found_col])

    return frame.mapInArrow(scan, T.StructType([*carried, T.StructField(found_col, _FOUND)]))


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text",
                 error_share: float = ERROR_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and item it holds: ``doc_id``, item_id, distance (word errors),
    item_words, start_word, end_word (best place, in words of the document)."""
    carried = [f for f in docs.schema.fields if f.name == doc_id]
    hits = fresh_names([doc_id], "found")[0]
    out = None
    for block in item_blocks(items, item_id, item_text, block_bytes):
        found = _scan(docs, block, carried, text, error_share, hits)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame(
            [], T.StructType([*carried, T.StructField(hits, _FOUND)]))
    return out.select(F.col(f"`{doc_id}`"), F.inline(hits))


def flag_contaminated(docs: DataFrame, items: DataFrame, flag: str, text: str = "text",
                      item_id: str = "item_id", item_text: str = "text",
                      error_share: float = ERROR_SHARE) -> DataFrame:
    """All columns of ``docs`` plus boolean ``flag`` (a column of that name is replaced); every row once."""
    out = docs.withColumn(flag, F.lit(False))
    hits = fresh_names(out.columns, "found")[0]
    for block in item_blocks(items, item_id, item_text):
        found = _scan(out, block, out.schema.fields, text, error_share, hits)
        out = found.withColumn(flag, F.col(f"`{flag}`") | (F.size(hits) > 0)).drop(hits)
    return out

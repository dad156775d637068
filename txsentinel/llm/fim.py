"""Fill-in-middle transformation by in-place block rotation.

A text of n code points is cut into prefix, middle and suffix at two hash-drawn places.  Its UTF-8
bytes lie in one ``bytearray``: the cuts are found by scanning for code-point heads, the sentinels
are inserted at them, and neighbouring blocks change places by three reversals (each block, then
both together), which need no second copy of the text.  Two rotations or fewer give either form:

* psm: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
* spm: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle

``restore`` reads nothing but output and form: it finds the sentinels, turns the blocks back by the
inverse rotation and takes the sentinels out.

Defined results: a null text counts as empty; empty texts and texts that hold a sentinel stay plain;
a null identifier draws its numbers from the empty string; rows that repeat an identifier draw the
same numbers, and the same text then gives the same output; texts of any length are handled whole;
other columns pass through untouched, except that n, form, prefix_chars, middle_chars and output
(restored, in ``restore``) are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txsentinel.llm.arrow_text import fresh_names, slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Per cent of the texts that are transformed, and of these in spm form.
FIM_PERCENT, SPM_PERCENT = 90, 20
SEED = 1
#: Bytes that one step of a scan or reversal touches beside the text itself.
BLOCK = 1 << 16


def draws(doc_id: str, seed: int = SEED) -> tuple[int, int, int, int]:
    """The four numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return tuple(int(digest[k:k + 8], 16) for k in range(0, 32, 8))


def code_points(view: np.ndarray) -> int:
    """Number of code points of UTF-8 bytes."""
    return sum(int(np.count_nonzero((view[k:k + BLOCK] & 0xC0) != 0x80)) for k in range(0, len(view), BLOCK))


def byte_offset(view: np.ndarray, chars: int) -> int:
    """Where code point number ``chars`` starts (the length, if there is none)."""
    for k in range(0, len(view), BLOCK):
        heads = np.flatnonzero((view[k:k + BLOCK] & 0xC0) != 0x80)
        if chars < len(heads):
            return k + int(heads[chars])
        chars -= len(heads)
    return len(view)


def reverse(data: bytearray, start: int, end: int) -> None:
    """Reverse data[start:end] in place, a block from either end at a time."""
    while end - start > 1:
        step = min(BLOCK, (end - start) // 2)
        left, right = data[start:start + step], data[end - step:end]
        left.reverse()
        right.reverse()
        data[start:start + step], data[end - step:end] = right, left
        start, end = start + step, end - step


def rotate(data: bytearray, start: int, cut: int, end: int) -> None:
    """Exchange the blocks [start, cut) and [cut, end) by three reversals."""
    if start < cut < end:
        reverse(data, start, cut)
        reverse(data, cut, end)
        reverse(data, start, end)


def rearrange(data: bytearray, first: int, second: int, form: str) -> None:
    """``data`` (a text) becomes its psm or spm output; the cuts are byte offsets."""
    if form == "psm":       # <P>prefix <M>middle <S>suffix, then the last two change places
        data[second:second] = SUFFIX
        data[first:first] = MIDDLE
        data[0:0] = PREFIX
        rotate(data, len(PREFIX) + first, len(PREFIX) + len(MIDDLE) + second, len(data))
    else:                   # <P>prefix<M>middle <S>suffix, then both change places
        data[second:second] = SUFFIX
        data[first:first] = MIDDLE
        data[0:0] = PREFIX
        rotate(data, 0, len(PREFIX) + len(MIDDLE) + second, len(data))


def bring_back(data: bytearray, form: str) -> None:
    """Inverse of ``rearrange``, from the output alone."""
    if form == "psm":
        start, cut = data.index(SUFFIX), data.index(MIDDLE)
    else:
        start, cut = 0, data.index(PREFIX)
    rotate(data, start, cut, len(data))
    for mark in (SUFFIX, MIDDLE, PREFIX):
        at = data.index(mark)
        del data[at:at + len(mark)]


def choose(data: bytes, numbers: tuple[int, int, int, int], fim_percent: int, spm_percent: int) -> str:
    if not data or PREFIX in data or SUFFIX in data or MIDDLE in data or numbers[2] % 100 >= fim_percent:
        return "plain"
    return "spm" if numbers[3] % 100 < spm_percent else "psm"


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).view(pa.string())


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fim_percent: int = FIM_PERCENT,
              spm_percent: int = SPM_PERCENT, seed: int = SEED) -> DataFrame:
    """Replace ``text`` by n (code points), form, prefix_chars, middle_chars (null if plain) and output."""
    made = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()),
            ("middle_chars", T.LongType()), ("output", T.StringType())]
    kept = [f for f in docs.schema.fields if f.name not in (text, *[k for k, _ in made])]
    extra = fresh_names([f.name for f in kept], "name", "body")
    frame = docs.select(*[F.col(f"`{f.name}`") for f in kept],
                        F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias(extra[0]),
                        F.col(f"`{text}`").cast("string").alias(extra[1]))

    def run(batches):
        for batch in batches:
            at = batch.num_columns - 1
            for rows, buf, off in slices(batch, extra[1]):
                out = [[], [], [], [], []]
                for name, a, b in zip(rows.column(at - 1).to_pylist(), off.tolist(), off[1:].tolist()):
                    data, numbers = bytearray(buf[a:b]), draws(name, seed)
                    n, form = code_points(buf[a:b]), choose(data, numbers, fim_percent, spm_percent)
                    cuts = sorted((numbers[0] % (n + 1), numbers[1] % (n + 1)))
                    if form != "plain":
                        rearrange(data, *[byte_offset(buf[a:b], c) for c in cuts], form)
                    plain = form == "plain"
                    for column, value in zip(out, (n, form, None if plain else cuts[0],
                                                   None if plain else cuts[1] - cuts[0], bytes(data))):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:-2], pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()),
                     pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), _strings(out[4])],
                    names=[*[f.name for f in kept], *[k for k, _ in made]])

    return frame.mapInArrow(run, T.StructType(kept + [T.StructField(k, t) for k, t in made]))


def restore(moved: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """Add ``restored``: the exact text, rebuilt from output and form (a null output counts as empty)."""
    kept = [f for f in moved.schema.fields if f.name != "restored"]
    extra = fresh_names([f.name for f in kept], "kind", "body")
    frame = moved.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{form}`").alias(extra[0]),
                         F.col(f"`{output}`").cast("string").alias(extra[1]))

    def run(batches):
        for batch in batches:
            at = batch.num_columns - 1
            for rows, buf, off in slices(batch, extra[1]):
                texts = []
                for kind, a, b in zip(rows.column(at - 1).to_pylist(), off.tolist(), off[1:].tolist()):
                    data = bytearray(buf[a:b])
                    if kind in ("psm", "spm"):
                        bring_back(data, kind)
                    texts.append(bytes(data))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-2], _strings(texts)],
                                                 names=[*[f.name for f in kept], "restored"])

    return frame.mapInArrow(run, T.StructType(kept + [T.StructField("restored", T.StringType())]))


ORACLE_SQL = f"""
WITH src AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
                    sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
drawn AS (SELECT *, CAST('0x' || substr(d, 1, 8) AS BIGINT) % (n + 1) AS a,
                 CAST('0x' || substr(d, 9, 8) AS BIGINT) % (n + 1) AS b,
                 CAST('0x' || substr(d, 17, 8) AS BIGINT) % 100 AS h3,
                 CAST('0x' || substr(d, 25, 8) AS BIGINT) % 100 AS h4 FROM src),
formed AS (SELECT *, least(a, b) AS p, abs(a - b) AS m,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= {FIM_PERCENT}
       THEN 'plain' WHEN h4 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
cut AS (SELECT *, '<P>' || substr(t, 1, p) AS px, '<M>' || substr(t, p + 1, m) AS mx,
               '<S>' || substr(t, p + m + 1) AS sx FROM formed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(p AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(m AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN px || sx || mx WHEN 'spm' THEN sx || px || mx ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut
"""

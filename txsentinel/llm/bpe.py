"""Byte-level BPE encoding and decoding with the tiktoken library.

* ``encode_texts``: text -> token ids, kept as little-endian unsigned 32-bit
  integers in one binary value per row.
* ``decode_ids``: such a value -> the raw bytes it stands for.

The rank file is local to the driver; its bytes travel in a broadcast whose
size is checked.  Long texts are cut before the library sees them, at places
where every match of the split pattern ends anyway, so that one call never
holds more than about ``CHUNK_CHARS`` characters of ordinary text.

Defined results: a null text counts as empty (no ids); a null id value decodes
to empty bytes; repeated rows give repeated rows; other columns pass through
untouched whatever their names, except that ``n_tokens``, ``ids`` and
``decoded`` are replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_CHARS = 1 << 16
#: Largest rank file that is broadcast.
MAX_RANK_BYTES = 64 << 20
#: Rows are handed over in groups of about this many characters.
GROUP_CHARS = 2 << 20

# A match of the pattern cannot cross these places: no match holds a non-space
# followed by a space, or both a letter and a digit.
_SAFE = regex.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \n])|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")


def safe_chunks(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """Cut ``text`` at safe places, each piece as short as possible above ``size`` characters."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None or cut.start() >= len(text):
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank)
            for token, rank in (line.split() for line in data.splitlines() if line)}


@lru_cache(maxsize=4)
def _encoding(digest: str, pattern: str, data: bytes):
    import tiktoken

    return tiktoken.Encoding(digest, pat_str=pattern, mergeable_ranks=read_ranks(data),
                             special_tokens={})


def encode_one(encoding, text: str, size: int = CHUNK_CHARS) -> np.ndarray:
    parts = [np.asarray(encoding.encode_ordinary(part), dtype="<u4")
             for part in safe_chunks(text, size) if part]
    if not parts:
        return np.zeros(0, "<u4")
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def default_rank_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _ranks(df: DataFrame, rank_file: str | None):
    with open(rank_file or default_rank_file(), "rb") as fh:
        data = fh.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"rank file above {MAX_RANK_BYTES} bytes")
    return hashlib.sha256(data).hexdigest(), df.sparkSession.sparkContext.broadcast(data)


def _groups(batch: pa.RecordBatch, name: str, values: list) -> Iterator[tuple[pa.RecordBatch, list]]:
    start, held = 0, 0
    for i, value in enumerate(values):
        held += len(value or "")
        if held >= GROUP_CHARS or i + 1 == len(values):
            yield batch.slice(start, i + 1 - start), values[start:i + 1]
            start, held = i + 1, 0


def encode_texts(docs: DataFrame, text: str = "text", rank_file: str | None = None,
                 pattern: str | None = None, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Replace ``text`` by ``n_tokens`` long and ``ids`` binary (little-endian u32); no shuffle."""
    digest, ranks = _ranks(docs, rank_file)
    pattern = pattern or default_pattern()
    kept = [f for f in docs.schema.fields if f.name not in (text, "n_tokens", "ids")]
    frame = docs.select(*[F.col(f"`{f.name}`") for f in kept],
                        F.col(text).cast("string").alias("ids"))
    schema = T.StructType(kept + [T.StructField("n_tokens", T.LongType()),
                                  T.StructField("ids", T.BinaryType())])

    def encode(batches):
        encoding = _encoding(digest, pattern, ranks.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for rows, part in _groups(batch, "ids", texts):
                ids = [encode_one(encoding, t or "", chunk_chars) for t in part]
                yield pa.RecordBatch.from_arrays(
                    rows.columns[:-1] + [pa.array([len(i) for i in ids], pa.int64()),
                                         pa.array([i.tobytes() for i in ids], pa.binary())],
                    names=rows.schema.names[:-1] + ["n_tokens", "ids"])

    return frame.mapInArrow(encode, schema)


def decode_ids(encoded: DataFrame, ids: str = "ids", rank_file: str | None = None,
               pattern: str | None = None) -> DataFrame:
    """Add ``decoded`` binary: the raw bytes of ``ids``, valid UTF-8 or not."""
    digest, ranks = _ranks(encoded, rank_file)
    pattern = pattern or default_pattern()
    kept = [f for f in encoded.schema.fields if f.name not in (ids, "decoded")]
    frame = encoded.select(*[F.col(f"`{f.name}`") for f in kept], F.col(ids).alias("ids"))
    schema = T.StructType(kept + [T.StructField("ids", T.BinaryType()),
                                  T.StructField("decoded", T.BinaryType())])

    def decode(batches):
        encoding = _encoding(digest, pattern, ranks.value)
        for batch in batches:
            values = batch.column(batch.num_columns - 1).to_pylist()
            for rows, part in _groups(batch, "ids", values):
                raw = [encoding.decode_bytes(np.frombuffer(v or b"", "<u4").tolist())
                       for v in part]
                yield pa.RecordBatch.from_arrays(rows.columns + [pa.array(raw, pa.binary())],
                                                 names=rows.schema.names[:-1] + ["ids", "decoded"])

    return frame.mapInArrow(decode, schema)

"""Vectorised text helpers used inside Arrow tasks.

Texts are handled as one byte buffer with document offsets.  Batches are cut
into slices of a few MB so that the numpy temporaries of a task stay small
whatever the Arrow batch holds; a single longer text is one slice.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 20

_U64 = np.uint64
_BASE = _U64(0x9E3779B97F4A7C15 | 1)          # odd, so it has an inverse mod 2^64
_BASE_INV = _U64(pow(int(_BASE), -1, 1 << 64))

# The white space of [^\x20\x09-\x0D]+
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# A-Z to a-z, other bytes unchanged (UTF-8 continuation bytes are above 0x7F)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes as uint8, offsets as int64 of length rows + 1); null reads as empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type)
                                  or pa.types.is_large_binary(column.type) else "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, width)[column.offset:column.offset + len(column) + 1]
    off = off.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def _trimmer():
    """glibc's malloc_trim, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


_TRIM = _trimmer()


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks and stages, and what an
    earlier one needed at its peak would stay with them."""
    pa.default_memory_pool().release_unused()
    _TRIM(0)


def slices(batch: pa.RecordBatch, text: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut ``batch`` into row ranges of about ``limit`` text bytes: (rows, bytes, offsets)."""
    buf, off = text_buffer(batch.column(batch.schema.get_field_index(text)))
    start, rows = 0, batch.num_rows
    while start < rows:
        stop = int(np.searchsorted(off, off[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), rows)
        yield (batch.slice(start, stop - start), buf[off[start]:off[stop]],
               off[start:stop + 1] - off[start])
        start = stop
    give_back()


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    x = x.astype(_U64, copy=True)
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


_POWERS = [np.ones(1, _U64), np.ones(1, _U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i mod 2^64 for i < n, grown by doubling and kept per worker."""
    for which, base in ((0, _BASE), (1, _BASE_INV)):
        table = _POWERS[which]
        while len(table) < n:
            table = np.concatenate([table, table * _U64(pow(int(base), len(table), 1 << 64))])
        _POWERS[which] = table
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of byte * base^position (mod 2^64), length n + 1."""
    n = len(buf)
    up, _ = _powers(n + 1)
    out = np.zeros(n + 1, _U64)
    np.cumsum((buf.astype(_U64) + _U64(1)) * up[:n], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes [start, end): equal strings have equal hashes wherever they are."""
    _, down = _powers(len(prefix))
    body = (prefix[end] - prefix[start]) * down[start]
    return mix(body + (end - start).astype(_U64) * _U64(0xD6E8FEB86659FD93))


def word_spans(buf: np.ndarray, off: np.ndarray,
               separator: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of non-separator bytes inside documents: (start, end, document index)."""
    inside = ~(SPACE[buf] if separator is None else separator)
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    first[inner] = inside[inner]
    last[inner - 1] = inside[inner - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    doc = np.searchsorted(off, start, side="right") - 1
    return start, end, doc


#: Spans beyond this many bytes are hashed one by one.
LONG_SPAN = 1 << 10


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes [start, end) of every span, eight bytes at a time.

    Every step mixes the state (a permutation), so spans of up to eight bytes and equal length never
    collide, and no arithmetic structure of longer ones carries through, as it does in polynomials
    modulo 2^64.  Very long spans go through xxhash.
    """
    size = end - start
    state = mix((size + 1).astype(_U64) * _U64(0xD6E8FEB86659FD93))
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[:len(buf)] = buf
    eights = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))     # the eight bytes from every place on
    live, done = np.flatnonzero((size > 0) & (size <= LONG_SPAN)), 0
    while len(live):
        left = size[live] - done
        word = eights[start[live] + done]
        short = left < 8
        word[short] &= (_U64(1) << (left[short] * 8).astype(_U64)) - _U64(1)
        state[live] = mix((state[live] ^ word) * _BASE)
        live, done = live[left > 8], done + 8
    for k in np.flatnonzero(size > LONG_SPAN).tolist():
        state[k] = xxhash.xxh3_64_intdigest(buf[start[k]:end[k]].tobytes(), 0x5EED)
    return state


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, document index) of every word [^\\x20\\x09-\\x0D]+ after lower-casing A-Z."""
    low = LOWER[buf]
    start, end, doc = word_spans(low, off)
    return span_hashes(low, start, end), doc


def fresh_names(taken: list[str], *wanted: str) -> list[str]:
    """``wanted`` with underscores added until no name of ``taken`` is met (in any case)."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out

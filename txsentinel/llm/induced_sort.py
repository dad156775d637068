"""Suffix and LCP arrays by external induced sorting.

The S* suffixes (left-most of every ascending stretch) are ordered by naming
their substrings and sorting the string of names, recursively; all others are
induced from them: a suffix is placed when the one behind it is taken from the
queue, first the descending (L) suffixes in ascending order, then the ascending
(S) ones in descending order.  Tuples travel through ``DiskQueue``, a priority
queue over (first symbol, order of arrival): induction inserts in order, so one
first-in-first-out stream per symbol is enough, and streams are written to
scratch files whenever the queue holds more than its memory allows.  Each tuple
carries the common-prefix length with its predecessor, derived from the minimum
over the stretch taken from the queue since then.

All steps are numpy operations over whole buckets of one first symbol.  The
scratch files are unnamed and belong to the task alone; a lost task starts again.
"""

from __future__ import annotations

import tempfile

import numpy as np

from txsentinel.llm.arrow_text import mix

#: Reduced strings up to this length are ordered in memory by prefix doubling.
BASE_SYMBOLS = 6_000_000
#: Bytes of queued tuples held in memory.
QUEUE_BYTES = 64 << 20

_NONE = np.iinfo(np.int32).max


class DiskQueue:
    """One stream of (position, lcp) per symbol; spills to a scratch file above ``memory`` bytes."""

    def __init__(self, memory: int = QUEUE_BYTES):
        self.memory, self.held, self.file = memory, 0, None
        self.streams: dict[int, list] = {}

    def put(self, symbol: int, positions: np.ndarray, lcp: np.ndarray):
        data = np.stack([positions.astype(np.int64), lcp.astype(np.int64)])
        self.streams.setdefault(symbol, []).append(data)
        self.held += data.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self):
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for parts in self.streams.values():
            for k, part in enumerate(parts):
                if isinstance(part, np.ndarray):
                    parts[k] = (self.file.tell(), part.shape[1])
                    self.file.write(np.ascontiguousarray(part).tobytes())
        self.held = 0

    def take(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All tuples of ``symbol`` that arrived since the last call."""
        parts = self.streams.pop(symbol, None)
        if not parts:
            return None
        out = []
        for part in parts:
            if isinstance(part, np.ndarray):
                self.held -= part.nbytes
            else:
                self.file.seek(part[0])
                part = np.frombuffer(self.file.read(16 * part[1]), np.int64).reshape(2, -1)
            out.append(part)
        data = out[0] if len(out) == 1 else np.concatenate(out, axis=1)
        return data[0], data[1]

    def close(self):
        if self.file is not None:
            self.file.close()


def range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of values[low..high] for every query (low <= high), by doubling."""
    out = np.empty(len(low), values.dtype)
    level = np.frexp((high - low + 1).astype(float))[1] - 1
    table, k = values, 0
    order = np.argsort(level, kind="stable")
    cuts = np.searchsorted(level[order], np.arange(int(level.max()) + 2)) if len(low) else [0]
    for k in range(len(cuts) - 1):
        own = order[cuts[k]:cuts[k + 1]]
        if len(own):
            out[own] = np.minimum(table[low[own]], table[high[own] - (1 << k) + 1])
        if k + 2 < len(cuts):
            table = np.minimum(table[:-(1 << k)], table[1 << k:])
    return out


def ascending(text: np.ndarray) -> np.ndarray:
    """True for S-type suffixes; the end counts as smaller than any symbol, so the last is L."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1].astype(np.int64))
    step[-1] = -1
    # equal neighbours take the type of the next change
    change = np.where(step != 0, np.arange(n), n)
    following = np.minimum.accumulate(change[::-1])[::-1]
    return step[following] > 0


def names_of(text: np.ndarray, kind: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """Rank of every S* substring (up to and with the next S* symbol) among the distinct ones."""
    n, m = len(text), len(stars)
    ends = np.append(stars[1:], n - 1)
    wide = int(text.max()) >= 256
    bits, per = (32, 1) if wide else (9, 7)
    group = np.zeros(m, np.int64)
    open_ = np.arange(m)
    offset = 0
    while len(open_):
        key = np.zeros(len(open_), np.uint64)
        for k in range(per):
            at = stars[open_] + offset + k
            inside = at <= ends[open_]
            at = np.minimum(at, n - 1)
            symbol = (2 * (text[at].astype(np.int64) + 1) + kind[at]).astype(np.uint64)
            key = key << np.uint64(bits) if per > 1 else key
            key |= np.where(inside, symbol, np.uint64(0))
        order = np.lexsort((key, group[open_]))
        g, k = group[open_][order], key[order]
        new = np.ones(len(order), bool)
        new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
        # new ranks inside old groups: the place of the first equal member
        first = np.flatnonzero(new)
        start_of_group = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        base = np.repeat(start_of_group, np.diff(np.append(start_of_group, len(g))))
        leader = np.repeat(first, np.diff(np.append(first, len(g))))
        group[open_[order]] = g + (leader - base)
        offset += per
        size = np.diff(np.append(first, len(g)))
        alone = np.repeat(size == 1, size)
        rest = open_[order][~alone]
        open_ = rest[stars[rest] + offset <= ends[rest]]
    return np.unique(group, return_inverse=True)[1]


def prefix_doubling(text: np.ndarray) -> np.ndarray:
    """Suffix array of an integer string in memory."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    step = 1
    # only members of groups that are not yet single are sorted again
    while True:
        sizes = np.bincount(rank, minlength=n)
        first = np.cumsum(sizes) - sizes
        rank = first[rank]                    # rank = place of the first of the group
        many = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        if not len(many):
            break
        behind = np.where(many + step < n, rank[np.minimum(many + step, n - 1)] + 1, 0)
        inner = np.lexsort((behind, rank[many]))
        p, r, b = many[inner], rank[many][inner], behind[inner]
        new = np.ones(len(p), bool)
        new[1:] = (r[1:] != r[:-1]) | (b[1:] != b[:-1])
        start = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        base = np.repeat(start, np.diff(np.append(start, len(p))))
        place = np.flatnonzero(new)
        leader = np.repeat(place, np.diff(np.append(place, len(p))))
        rank[p] = r + leader - base
        step *= 2
        # compress to dense group numbers for bincount of sizes
        rank = np.unique(rank, return_inverse=True)[1]
    order[rank] = np.arange(n)
    return order


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common-prefix length of the suffixes a and b, at most ``cap``, by symbols."""
    n = len(text)
    out = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    x, y = a.astype(np.int64), b.astype(np.int64)
    while len(open_):
        inside = (x < n) & (y < n) & (out[open_] < cap)
        open_, x, y = open_[inside], x[inside], y[inside]
        same = text[x] == text[y]
        open_, x, y = open_[same], x[same] + 1, y[same] + 1
        out[open_] += 1
    return out


def _name_lcp(names: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """LCP (in names) of neighbours in ``order``, by binary descent over hashed powers of two."""
    n = len(names)
    tables = [mix(names.astype(np.uint64))]
    while (1 << len(tables)) <= min(cap, n):
        h, k = tables[-1], 1 << (len(tables) - 1)
        tables.append(mix(h[:-k] * np.uint64(0xC2B2AE3D27D4EB4F) + h[k:]) if len(h) > k else h[:0])
    out = np.zeros(n, np.int64)
    x, y = order[1:].astype(np.int64), order[:-1].astype(np.int64)
    got = np.zeros(n - 1, np.int64)
    for k in range(len(tables) - 1, -1, -1):
        h = tables[k]
        if not len(h):
            continue
        p, q = x + got, y + got
        fits = (p < len(h)) & (q < len(h))
        same = fits & (h[np.minimum(p, len(h) - 1)] == h[np.minimum(q, len(h) - 1)])
        got[same] += 1 << k
    out[1:] = got
    return out


class _Pass:
    """One direction of induction; ``wanted`` tells which preceding suffixes it places."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, memory: int, cap: int):
        self.text, self.wanted, self.cap = text, wanted, cap
        self.queue = DiskQueue(memory)
        self.least: dict[int, int] = {}       # minimum since the last tuple of a symbol

    def feed(self, positions: np.ndarray, lcp: np.ndarray):
        """Take suffixes in order (lcp: with the one taken before) and place those before them."""
        before = positions - 1
        ok = before >= 0
        ok[ok] = self.wanted[before[ok]]
        at = np.flatnonzero(ok)
        overall = int(lcp.min())
        if len(at):
            symbols = self.text[before[at]]
            order = np.argsort(symbols, kind="stable")
            at, symbols = at[order], symbols[order]
            first = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
            low = np.empty(len(at), np.int64)
            low[1:] = at[:-1] + 1
            low[first] = 0
            found = range_minima(lcp, low, at)
            last = np.append(first[1:], len(at)) - 1
            rest = np.where(at[last] + 1 < len(lcp), 0, -1)
            tail = np.full(len(last), _NONE)
            some = rest == 0
            if some.any():
                tail[some] = range_minima(lcp, at[last[some]] + 1, np.full(some.sum(), len(lcp) - 1))
        else:
            first = last = np.zeros(0, np.int64)
            symbols = tail = first
        seen = symbols[first].tolist()
        told = dict.fromkeys(seen)
        for symbol in self.least:
            if symbol not in told and self.least[symbol] > overall:
                self.least[symbol] = overall
        for k, symbol in enumerate(seen):
            a, b = first[k], last[k] + 1
            value = np.minimum(found[a:b] + 1, self.cap)
            known = self.least.get(symbol)
            value[0] = 0 if known is None else min(known + 1, int(value[0]), self.cap)
            self.queue.put(symbol, before[at[a:b]], value)
            self.least[symbol] = int(tail[k])


def suffix_array(text: np.ndarray, cap: int = 1 << 30, base: int = BASE_SYMBOLS,
                 memory: int = QUEUE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, LCP with the suffix before, at most ``cap``) of an integer string."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = ascending(text)
    star = np.zeros(n, bool)
    star[1:] = kind[1:] & ~kind[:-1]
    stars = np.flatnonzero(star)
    star_order, star_lcp = _order_stars(text, kind, stars, cap, base, memory)

    symbols = np.unique(text)
    star_symbol = text[star_order]
    star_cuts = np.searchsorted(star_symbol, symbols), np.searchsorted(star_symbol, symbols, "right")
    descending = ~kind
    one = np.ones(1, np.int64)

    # L suffixes in ascending order, from the end mark, themselves, and the S* suffixes
    left = _Pass(text, descending, memory, cap)
    left.queue.put(int(text[n - 1]), one * (n - 1), 0 * one)
    left.least[int(text[n - 1])] = 0
    blocks: dict[int, tuple] = {}
    for k, symbol in enumerate(symbols.tolist()):
        taken = []
        while (got := left.queue.take(symbol)) is not None:
            taken.append(got)
            left.feed(*_first_zero(got, len(taken) == 1))
        own = _join(taken)
        blocks[symbol] = own
        a, b = int(star_cuts[0][k]), int(star_cuts[1][k])
        if b > a:
            lcp = star_lcp[a:b].copy()
            lcp[0] = 0
            if len(own[0]):
                lcp[0] = common_prefix(text, own[0][-1:], star_order[a:a + 1], cap)[0]
            left.feed(star_order[a:b], lcp)
    left.queue.close()

    # S suffixes in descending order, from themselves and the L suffixes
    right = _Pass(text, kind, memory, cap)
    out, out_lcp = [], []
    for symbol in symbols[::-1].tolist():
        taken = []
        while (got := right.queue.take(symbol)) is not None:
            taken.append(got)
            right.feed(*_first_zero(got, len(taken) == 1))
        down, down_lcp = _join(taken)
        up, up_lcp = blocks.pop(symbol)
        border = 0
        if len(up) and len(down):
            border = int(common_prefix(text, up[-1:], down[-1:], cap)[0])
        # lcp of a descending stream is with the larger neighbour: shift it by one when reversed
        rising, rising_lcp = down[::-1], np.empty(len(down), np.int64)
        if len(down):
            rising_lcp[0] = border
            rising_lcp[1:] = down_lcp[1:][::-1]
        out.append(np.concatenate([up, rising]))
        both = np.concatenate([up_lcp, rising_lcp])
        both[0] = 0
        out_lcp.append(both)
        if len(up):
            falling = np.empty(len(up), np.int64)
            falling[0] = border if len(down) else 0
            falling[1:] = up_lcp[1:][::-1]
            right.feed(up[::-1], falling)
    right.queue.close()
    return np.concatenate(out[::-1]), np.concatenate(out_lcp[::-1])


def _first_zero(got: tuple, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """The first tuple taken from a symbol shares nothing with the symbol before."""
    positions, lcp = got
    lcp = lcp.copy()
    if first:
        lcp[0] = 0
    return positions, lcp


def _join(taken: list) -> tuple[np.ndarray, np.ndarray]:
    if not taken:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([t[0] for t in taken]), np.concatenate([t[1] for t in taken])


def _order_stars(text, kind, stars, cap, base, memory):
    """S* suffixes in order with their LCP (in symbols of ``text``)."""
    m = len(stars)
    if m == 0:
        return stars, np.zeros(0, np.int64)
    names = names_of(text, kind, stars)
    if m <= base:
        order = prefix_doubling(names)
        name_lcp = _name_lcp(names, order, cap)
    else:
        order, name_lcp = suffix_array(names, cap, base, memory)
    # equal names cover whole substrings; the first different ones are compared by symbols
    a, b = order[:-1], order[1:]
    shared = name_lcp[1:]
    x, y = a + shared, b + shared
    end = np.append(stars, len(text))
    whole = end[np.minimum(x, m)] - stars[a]
    more = common_prefix(text, end[np.minimum(x, m)], end[np.minimum(y, m)], cap)
    lcp = np.zeros(m, np.int64)
    lcp[1:] = np.minimum(whole + more, cap)
    return stars[order], lcp

"""Hierarchical Pitman-Yor language model: training by Gibbs seating, scoring of all texts.

Model (order 3).  The restaurant of context (x, v) has the restaurant of (v) as
its parent, which it shares with all contexts that end in v; those share the
root, whose base is uniform over the training vocabulary and one unknown word.
Every table of a child is a customer of its parent.  A restaurant predicts

    P(w) = (c_w - d t_w + (theta + d T) P_parent(w)) / (theta + C).

Seating is sampled by blocked Gibbs steps: the customers of one dish in one
restaurant leave and are seated again one after the other given everyone else
(their number and tables decide the seats' probabilities), corrected by a
Metropolis-Hastings ratio because the block's normaliser depends on the path.
Dishes of a restaurant are updated in two random halves.  Probabilities are
averaged over several seatings before their logarithm is taken.

Spark plan.
* ``vocabulary``: exact counts of all training words, dealt by word hash.  The
  ``DICTIONARY`` most frequent words (bounded) get short codes and travel in
  broadcasts; other words travel as 64-bit hashes.
* Tokens are dealt by context word v, so a restaurant (v) and all its children
  lie in one bucket.  Contexts with more tokens than a share of a bucket are cut
  into sections by the word before them (and, where both words are that
  frequent, by the word that follows, so a trigram's count is never cut).  The
  sections of v share the restaurant (v), and the parts of (x, v) its totals.
* Epoch one seats the training trigram counts of each bucket; its tables are
  the root's customers.  The sections' tables are the customers of the shared
  restaurants, which are seated dealt by (v, word) and whose tables go to the
  root.  The root is seated, dealt by word.
* Epoch two deals all tokens with their documents to the same buckets, together
  with the root's answers for the words that have no code and the seating of the
  shared restaurants (done again under the sampled root), seats again under
  both, and averages; buckets return one partial sum per document.

Hashes stand for words; two words are confused with a probability of about
V^2 / 2^65.  No driver collect grows with the data: only dictionary-sized
vectors and scalars get there.

Defined results: null text counts as empty (one end token); a null ``held_out``
counts as training; repeated rows are documents of their own; extra columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txsentinel.llm.arrow_text import mix, slices, word_hashes
from txsentinel.session import materialize, shuffle_partitions

#: Words with a short code, at most (a broadcast of 8 bytes each).
DICTIONARY = (1 << 20) - 2
#: Tokens that one bucket holds on average, and that a mapper gathers before it deals them out.
BUCKET_TOKENS, CHUNK_TOKENS = 1_000_000, 700_000
BURN_IN, SAMPLES = 3, 4
#: A trigram met that often in a chunk is sent once, with its count.
OFTEN = 8
#: Codes of one root part.
CODES = 1 << 12
THETA, THETA_ROOT = 1.0, 10.0

_U64 = np.uint64
BEGIN, END = _U64(0xB0B0B0B0B0B0B0B1), _U64(0xE0E0E0E0E0E0E0E3)
_BEGIN_CODE, _RARE = (1 << 20) - 2, (1 << 20) - 1
_ONE, _TWO, _THREE = (_U64(k) for k in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93))


def _pack(data: dict) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(data, protocol=5))


def _unpack(blob: bytes) -> dict:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def group(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a member of each distinct key, in key order; number of the key of every member)."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    order = np.argsort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    number = np.empty(len(keys), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return order[new], number


# ---------------------------------------------------------------- tokens


class Tokens:
    """Tokens of some documents: word hashes with one end token each, and their document."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        rows = len(off) - 1
        words, owner = word_hashes(buf, off)
        size = np.bincount(owner, minlength=rows) + 1
        last = np.cumsum(size) - 1
        self.doc = np.repeat(np.arange(rows), size)
        self.word = np.empty(int(size.sum()), _U64)
        is_word = np.ones(len(self.word), bool)
        is_word[last] = False
        self.word[is_word] = words
        self.word[last] = END
        self.size = size


def _hash_slots(words: np.ndarray) -> np.ndarray:
    """Open-addressing table, a quarter full at most: the code of the word in each slot, or -1."""
    slots = np.full(1 << (4 * len(words) + 1).bit_length(), -1, np.int32)
    mask = _U64(len(slots) - 1)
    code = np.arange(len(words), dtype=np.int32)
    at = words & mask
    while len(code):
        free = slots[at] < 0
        slots[at[free]] = code[free]            # of several words for one slot, one gets it
        left = slots[at] != code
        code, at = code[left], (at[left] + _U64(1)) & mask
    return slots


class Dictionary:
    """Codes of the most frequent words, their training counts, and sections of hot contexts."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, hot: float):
        self.hashes, self.counts, self.hot = words, counts, hot   # by code, most frequent first
        self.slots = _hash_slots(words)
        self.sections = np.maximum(1, np.ceil(counts / hot)).astype(np.int64)
        end = np.flatnonzero(words == END)                      # as many as documents, that is, as BEGIN
        self.begin_sections = int(self.sections[end[0]]) if len(end) else 1
        self.shared = int((self.sections > 1).sum())            # codes below it have sections

    def __reduce__(self):                         # the rest is built again by whoever reads it
        return Dictionary, (self.hashes, self.counts, self.hot)

    def codes(self, word: np.ndarray) -> np.ndarray:
        out = np.full(len(word), _RARE, np.int32)
        if not len(self.hashes):
            return out
        mask = _U64(len(self.slots) - 1)
        at, rows = word & mask, None            # all words at first, then those that met another one
        while True:
            code = self.slots[at]
            mine = word if rows is None else word[rows]
            hit = (code >= 0) & (self.hashes[code] == mine)
            if rows is None:
                out[hit] = code[hit]
            else:
                out[rows[hit]] = code[hit]
            again = np.flatnonzero((code >= 0) & ~hit)
            if not len(again):
                return out
            rows, at = again if rows is None else rows[again], (at[again] + _U64(1)) & mask

    def words(self, codes: np.ndarray, rare: np.ndarray) -> np.ndarray:
        out = np.empty(len(codes), _U64)
        out[codes == _RARE] = rare
        out[codes == _BEGIN_CODE] = BEGIN
        known = codes < _BEGIN_CODE
        out[known] = self.hashes[codes[known]]
        return out

    def section_counts(self, codes: np.ndarray) -> np.ndarray:
        out = np.ones(len(codes), np.int64)
        known = codes < _BEGIN_CODE
        out[known] = self.sections[codes[known]]
        out[codes == _BEGIN_CODE] = self.begin_sections
        return out

    def context_codes(self, word: np.ndarray) -> np.ndarray:
        return np.where(word == BEGIN, _BEGIN_CODE, self.codes(word))

    def spread(self, vc: np.ndarray, xc: np.ndarray) -> np.ndarray:
        """Parts of the restaurants (x, v): above 1 where both words have sections."""
        return np.minimum(self.section_counts(xc), self.section_counts(vc))

    def shared_number(self, codes: np.ndarray) -> np.ndarray:
        """Number of the shared restaurant of context words, -1 without sections."""
        return np.where(self.section_counts(codes) > 1, np.where(codes == _BEGIN_CODE, self.shared, codes), -1)


def _shifted(values: np.ndarray, starts: np.ndarray, by: int, fill) -> np.ndarray:
    """Values ``by`` places earlier in the same document, ``fill`` where there is none."""
    out = np.empty_like(values)
    out[by:] = values[:-by] if by else values
    out[:by] = fill
    for k in range(by):
        at = starts + k
        out[at[at < len(out)]] = fill
    return out


def context_hash(v: np.ndarray, section: np.ndarray) -> np.ndarray:
    return mix(v * _ONE + section.astype(_U64))


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a.astype(_U64) * _ONE + mix(b * _THREE))


def bucket_of(context: np.ndarray, buckets: int) -> np.ndarray:
    return ((context >> _U64(32)) * _U64(buckets) >> _U64(32)).astype(np.int64)


def _planes(codes: np.ndarray) -> np.ndarray:
    """Three byte planes; rare and frequent codes compress well apart."""
    return np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T)


def _codes(planes: np.ndarray) -> np.ndarray:
    raw = np.zeros((planes.shape[1], 4), np.uint8)
    raw[:, :3] = planes.T
    return raw.view("<u4").reshape(-1).astype(np.int32)


class Chunk:
    """Gathers the tokens of a mapper and deals them to buckets."""

    def __init__(self, dictionary: Dictionary, buckets: int):
        self.dictionary, self.buckets = dictionary, buckets
        self.clear()

    def clear(self):
        self.parts, self.docs, self.held, self.tokens, self.often = [], 0, [], 0, None

    def add(self, tokens: Tokens, code: np.ndarray, held: np.ndarray):
        """``held``: held-out documents."""
        d = self.dictionary
        first = np.cumsum(tokens.size) - tokens.size
        v, x = _shifted(tokens.word, first, 1, BEGIN), _shifted(tokens.word, first, 2, BEGIN)
        vc, xc = _shifted(code, first, 1, _BEGIN_CODE), _shifted(code, first, 2, _BEGIN_CODE)
        m = d.section_counts(vc)
        section = np.zeros(len(v), np.int32)
        hot = np.flatnonzero(m > 1)
        if len(hot):
            # the parts of (x, v) are cut by the word that follows: all of a trigram is in one
            spread = mix(tokens.word[hot] * _TWO) % d.spread(vc[hot], xc[hot]).astype(_U64)
            section[hot] = ((mix(x[hot]) + spread) % m[hot].astype(_U64)).astype(np.int32)
        self.parts.append((v, x, tokens.word, vc, xc, code, section,
                           (tokens.doc + self.docs).astype(np.int32), held[tokens.doc]))
        self.docs += len(tokens.size)
        self.tokens += len(code)

    def deal(self, counts_only: bool) -> Iterator[tuple[int, bytes]]:
        """(bucket, packed tokens); ``counts_only``: distinct training trigrams with counts, and
        with count 0 those held-out ones whose word has no code or whose context has sections.
        Otherwise a trigram met ``OFTEN`` times goes once, as a document of its own behind the
        others with a training count; ``often`` says which documents hold it how many times."""
        if not self.parts:
            return
        columns = [list(p) for p in zip(*self.parts)]
        self.parts = []
        for k, parts in enumerate(columns):   # one column at a time is in memory twice
            columns[k] = np.concatenate(parts)
            del parts
        v, x, w, vc, xc, wc, section, doc, held = columns
        del columns
        context = context_hash(v, section)
        extra = 2 * doc + held
        if counts_only:
            key = mix(context + mix(x * _TWO + mix(w * _THREE)))
            use = np.flatnonzero(~held | (wc == _RARE) | (self.dictionary.section_counts(vc) > 1))
            first, inverse = group(key[use])
            extra = np.bincount(inverse, ~held[use], len(first)).astype(np.int64)
            pick = use[first]
            v, x, w, vc, xc, wc, section, context = (
                a[pick] for a in (v, x, w, vc, xc, wc, section, context))
        else:
            first, inverse = group(mix(context + mix(x * _TWO + mix(w * _THREE))))
            many = np.bincount(inverse, minlength=len(first)) >= OFTEN
            frequent = np.flatnonzero(many)
            number = np.cumsum(many) - 1
            own = many[inverse]
            train = np.bincount(inverse, ~held, len(first)).astype(np.int64)[frequent]
            cell = doc[own].astype(np.int64) * max(len(frequent), 1) + number[inverse[own]]
            cell, times = np.unique(cell, return_counts=True)
            self.often = {"od": cell // max(len(frequent), 1), "ok": cell % max(len(frequent), 1), "on": times}
            rest = np.flatnonzero(~own)
            pick = np.concatenate([rest, first[frequent]])
            extra = np.concatenate([extra[rest], 2 * (self.docs + np.arange(len(frequent)))])
            weight = np.concatenate([np.zeros(len(rest), np.int64), train])
            v, x, w, vc, xc, wc, section, context = (
                a[pick] for a in (v, x, w, vc, xc, wc, section, context))
        bucket = bucket_of(context, self.buckets)
        order = np.argsort(bucket.astype(np.uint16) if self.buckets < 65536 else bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for b in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            at = order[cuts[b]:cuts[b + 1]]
            data = {"s": section[at].astype(np.uint32 if section[at].max() > 255 else np.uint8),
                    "e": _smallest(np.diff(extra[at], prepend=0) if not counts_only else extra[at])}
            if not counts_only:
                data["d"], data["n"] = self.docs, _smallest(weight[at[extra[at] >= 2 * self.docs]])
            for name, codes, words in (("v", vc, v), ("x", xc, x), ("w", wc, w)):
                c = codes[at]
                data[name] = _planes(c)
                data[name + "r"] = words[at][c == _RARE]
            yield b, _pack(data)


def _smallest(a: np.ndarray) -> np.ndarray:
    for kind in (np.uint8, np.uint16, np.uint32):
        if not len(a) or (a.min() >= 0 and a.max() <= np.iinfo(kind).max):
            return a.astype(kind)
    return a.astype(np.int64)


# ---------------------------------------------------------------- restaurants


def seat(c: np.ndarray, others: np.ndarray, parent: np.ndarray, theta: float, d: float,
         rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Seat c customers of each dish one after the other (from 16 on in growing groups).

    ``others``: tables of the restaurant's other dishes.  Returns tables and the log of the
    product of normalisers, which the Metropolis-Hastings ratio needs.
    """
    order = np.argsort(-c, kind="stable")
    c, others, parent = c[order], others[order], parent[order]
    t, log_z = np.minimum(c, 1), np.zeros(len(c))
    seated = 1
    while True:
        k = int(np.searchsorted(-c, -seated, side="left"))  # dishes with more customers than that
        if not k:
            break
        group = 1 if seated < 16 else seated // 4
        a = (theta + d * (others[:k] + t[:k])) * parent[:k]
        z = a + (seated - d * t[:k])
        if group == 1:
            log_z[:k] += np.log(z)
            t[:k] += rng.random(k) < a / z
        else:
            more = np.minimum(group, c[:k] - seated)
            log_z[:k] += more * np.log(z)
            t[:k] += rng.binomial(more, a / z)
        seated += group
    out_t, out_z = np.empty_like(t), np.empty_like(log_z)
    out_t[order], out_z[order] = t, log_z
    return out_t, out_z


def discount(c: np.ndarray) -> float:
    """n1 / (n1 + 2 n2), kept inside (0.05, 0.95)."""
    n1, n2 = float((c == 1).sum()), float((c == 2).sum())
    return float(np.clip(n1 / (n1 + 2 * n2), 0.05, 0.95)) if n1 + n2 else 0.5


class Level:
    """Dishes of all restaurants of one level: customers, tables, and Gibbs updates.

    Dishes with at most one customer have as many tables as customers; the others (``many``) are
    the ones that Gibbs steps move."""

    def __init__(self, restaurant: np.ndarray, theta: float):
        self.restaurant, self.theta = restaurant, theta

    def start(self, customers: np.ndarray, many: np.ndarray):
        """One table per dish; ``many``: dishes that can come to have several customers."""
        restaurants = int(self.restaurant.max()) + 1
        self.c, self.many = customers, many
        self.t = np.minimum(customers, 1)
        self.log_z = np.full(len(many), -np.inf)
        self.d = discount(customers)
        self.own_d = np.full(restaurants, self.d)
        self.tables = np.bincount(self.restaurant, self.t, restaurants)
        self.people = np.bincount(self.restaurant, self.c, restaurants)

    def predict(self, parent: np.ndarray, at=slice(None)) -> np.ndarray:
        """P(dish) in its restaurant, for the dishes ``at``, given the parent's P(dish)."""
        r = self.restaurant[at]
        d = self.own_d[r]
        return ((self.c[at] - d * self.t[at] + (self.theta + d * self.tables[r]) * parent)
                / (self.theta + self.people[r]))

    def reseat(self, half: np.ndarray, customers: np.ndarray, parent: np.ndarray,
               rng: np.random.Generator) -> np.ndarray:
        """Blocked Gibbs step of the dishes ``many[half]``; returns the change of their tables."""
        which = self.many[half]
        r, old_c, old_t = self.restaurant[which], self.c[which], self.t[which]
        t, log_z = seat(customers, np.maximum(self.tables[r] - old_t, 0), parent, self.theta, self.d, rng)
        moved = customers != old_c
        take = moved | (np.log(rng.random(len(which))) < log_z - self.log_z[half])
        t = np.where(take, t, old_t)
        self.log_z[half] = np.where(take, log_z, self.log_z[half])
        self.c[which], self.t[which] = customers, t
        np.add.at(self.tables, r, t - old_t)
        np.add.at(self.people, r[moved], (customers - old_c)[moved])
        return t - old_t


class Bucket:
    """All restaurants of a bucket under given root probabilities."""

    def __init__(self, v, section, x, w, train: np.ndarray, seed: int):
        context = context_hash(v, section)
        inner = mix(context + mix(x * _TWO))
        first, self.inverse = group(mix(inner * _THREE + mix(w * _ONE)))
        self.count = np.bincount(self.inverse, train, len(first)).astype(np.int64)
        context, inner, v, x, w = context[first], inner[first], v[first], x[first], w[first]
        at, self.inner = group(inner)
        self.leaf_v, self.leaf_x, self.leaf_key, self.share = v[at], x[at], inner[at], None
        first, self.pair = group(mix(context * _TWO + mix(w * _THREE)))
        at, outer = group(context[first])
        self.middle_v = v[first][at]
        w = w[first]
        at, self.pair_word = group(w)
        self.words = w[at]
        self.leaf, self.middle = Level(self.inner, THETA), Level(outer, THETA)
        self.rng = np.random.default_rng([seed, len(v)])

    def start(self, root: np.ndarray):
        """``root``: P0 of ``self.words``.  One table per dish before the first sweep."""
        self.root = root[self.pair_word]
        self.leaf.start(self.count, np.flatnonzero(self.count > 1))
        tokens = np.bincount(self.pair, self.count, len(self.pair_word))
        tables = np.bincount(self.pair, self.leaf.t, len(self.pair_word)).astype(np.int64)
        self.customers = tables
        self.middle.start(tables.copy(), np.flatnonzero(tokens > 1))

    def share_middle(self, pairs, c, t, restaurants, d, tables, people):
        """After ``start``: the state of shared restaurants, which are seated elsewhere."""
        middle = self.middle
        middle.c[pairs], middle.t[pairs] = c, t
        middle.own_d[restaurants], middle.tables[restaurants], middle.people[restaurants] = d, tables, people
        keep = ~np.isin(middle.restaurant[middle.many], restaurants)
        middle.many, middle.log_z = middle.many[keep], middle.log_z[keep]

    def share_leaf(self, restaurants, tables, people):
        """After ``start``: what other parts of the same (x, v) hold."""
        self.leaf.tables[restaurants] += tables
        self.leaf.people[restaurants] += people

    def own_leaf(self) -> tuple[np.ndarray, np.ndarray]:
        """(tables, customers) in the restaurants (x, v), of this part alone."""
        n = len(self.leaf_v)
        return (np.bincount(self.inner, self.leaf.t, n).astype(np.int64),
                np.bincount(self.inner, self.count, n).astype(np.int64))

    def sweep(self):
        """One Gibbs sweep, children before parents; each level in two random halves."""
        leaf, middle = self.leaf, self.middle
        if self.share is not None:   # the other parts are not known yet: as many tables as here
            leaf.tables = self.own_leaf()[0] * self.share
        for half in self._halves(len(leaf.many)):
            dish = leaf.many[half]
            pair = self.pair[dish]
            # the parent as it is without the tables of the dish itself
            c = np.maximum(middle.c[pair] - leaf.t[dish], 0)
            t = np.minimum(middle.t[pair], c)
            r = middle.restaurant[pair]
            d = middle.own_d[r]
            parent = ((c - d * t + (middle.theta + d * middle.tables[r]) * self.root[pair])
                      / (middle.theta + middle.people[r]))
            change = leaf.reseat(half, self.count[dish], parent, self.rng)
            np.add.at(self.customers, pair, change)
        for half in self._halves(len(middle.many)):
            dish = middle.many[half]
            middle.reseat(half, self.customers[dish], self.root[dish], self.rng)

    def _halves(self, n: int):
        side = self.rng.random(n) < 0.5
        return np.flatnonzero(side), np.flatnonzero(~side)

    def predict(self) -> np.ndarray:
        """Probability of every distinct trigram under the present seating."""
        return self.leaf.predict(self.middle.predict(self.root)[self.pair])


# ---------------------------------------------------------------- Spark


def _frame(docs: DataFrame, doc_id: str, text: str, held_out) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"),
                       F.coalesce(held_out, F.lit(False)).alias("held"),
                       F.col(f"`{text}`").cast("string").alias("body"))


def vocabulary(frame: DataFrame, parts: int) -> DataFrame:
    """part, words (sorted u64), counts (u64): all training words, one row per part."""
    def count(batches):
        words, counts, held = [], [], 0

        def merged():
            u, inverse = np.unique(np.concatenate(words), return_inverse=True)
            return u, np.bincount(inverse, np.concatenate(counts), len(u)).astype(np.uint64)

        def flush():
            u, c = merged()
            part = (u % _U64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            rows = [(p, _pack({"w": u[order[a:b]], "c": _smallest(c[order[a:b]].astype(np.int64))}))
                    for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            return pa.RecordBatch.from_pydict({"part": pa.array([p for p, _ in rows], pa.int32()),
                                               "body": pa.array([r for _, r in rows], pa.binary())})

        for batch in batches:
            for rows, buf, off in slices(batch, "body"):
                tokens = Tokens(buf, off)
                train = ~np.array(rows.column(1).to_pylist(), bool)[tokens.doc]
                u, c = np.unique(tokens.word[train], return_counts=True)
                words.append(u)
                counts.append(c)
                held += len(u)
                if held > CHUNK_TOKENS:
                    u, c = merged()
                    words, counts, held = [u], [c], len(u)
                    if held > CHUNK_TOKENS // 2:
                        yield flush()
                        words, counts, held = [], [], 0
        if held:
            yield flush()

    def merge(batches):
        for part, bodies in _groups(batches):
            data = [_unpack(b) for b in bodies["body"]]
            u, inverse = np.unique(np.concatenate([x["w"] for x in data]), return_inverse=True)
            c = np.bincount(inverse, np.concatenate([x["c"].astype(float) for x in data]), len(u))
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "types": pa.array([len(u)], pa.int64()),
                "tokens": pa.array([int(c.sum())], pa.int64()),
                "words": pa.array([u.tobytes()], pa.binary()),
                "counts": pa.array([c.astype("<u8").tobytes()], pa.binary())})

    dealt = frame.mapInArrow(count, "part int, body binary").repartition(parts, "part")
    return dealt.sortWithinPartitions("part").mapInArrow(
        merge, "part int, types long, tokens long, words binary, counts binary")


def _groups(batches) -> Iterator[tuple[int, dict[str, list]]]:
    """Rows of a sorted partition by their first column."""
    key, held = None, None
    for batch in batches:
        names = batch.schema.names
        columns = [c.to_pylist() for c in batch.columns]
        for values in zip(*columns):
            if values[0] != key:
                if held:
                    yield key, held
                key, held = values[0], {n: [] for n in names[1:]}
            for n, value in zip(names[1:], values[1:]):
                held[n].append(value)
    if held:
        yield key, held


def most_frequent(vocab: DataFrame, size: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``size`` frequent words (bounded collect: each part offers about twice its share)."""
    offer = 2 * size // parts + 64

    def pick(batches):
        for batch in batches:
            for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w, c = np.frombuffer(w, _U64), np.frombuffer(c, "<u8")
                at = np.argsort(c)[::-1][:offer]
                yield pa.RecordBatch.from_pydict({"w": pa.array([w[at].tobytes()], pa.binary()),
                                                  "c": pa.array([c[at].tobytes()], pa.binary())})

    rows = vocab.select("words", "counts").mapInArrow(pick, "w binary, c binary").collect()
    w = np.concatenate([np.zeros(0, _U64)] + [np.frombuffer(r["w"], _U64) for r in rows])
    c = np.concatenate([np.zeros(0, np.uint64)] + [np.frombuffer(r["c"], "<u8") for r in rows])
    order = np.lexsort((w, np.iinfo(np.int64).max - c.astype(np.int64)))[:size]
    return w[order], c[order].astype(np.int64)


def _token_rows(shared, counts_only: bool):
    """Mapper: (target bucket, kind 0, chunk, packed tokens); with documents also one row of
    kind 1 per chunk: identifiers, sizes and what the dictionary knows of base scores."""
    def run(batches):
        dictionary, buckets, log_base = shared.value
        chunk, number = Chunk(dictionary, buckets), 0
        partition = TaskContext.get().partitionId()
        docs: list[dict] = []

        def deal():
            nonlocal number
            name = partition * (1 << 32) + number
            rows = [(b, 0, body) for b, body in chunk.deal(counts_only)]
            if not counts_only:
                table = {k: np.concatenate([d[k] for d in docs]) for k in docs[0]} | chunk.often
                rows.append((name % buckets, 1, _pack(table)))
            chunk.clear()
            docs.clear()
            number += 1
            if rows:
                yield pa.RecordBatch.from_pydict({
                    "target": pa.array([r[0] for r in rows], pa.int32()),
                    "kind": pa.array([r[1] for r in rows], pa.int32()),
                    "chunk": pa.array([name] * len(rows), pa.int64()),
                    "body": pa.array([r[2] for r in rows], pa.binary())})

        for batch in batches:
            for rows, buf, off in slices(batch, "body"):
                tokens = Tokens(buf, off)
                held = np.array(rows.column(1).to_pylist(), bool)
                ids = rows.column(0)
                plain = np.asarray(ids.fill_null(-1).to_numpy(zero_copy_only=False), np.int64)
                code = dictionary.codes(tokens.word)
                chunk.add(tokens, code, held)
                if not counts_only:
                    known = code < _BEGIN_CODE
                    n = len(tokens.size)
                    docs.append({
                        "id": plain, "null": np.asarray(ids.is_null().to_numpy(zero_copy_only=False)),
                        "held": held, "n": tokens.size.astype(np.int64),
                        "known": np.bincount(tokens.doc[known], minlength=n),
                        "base": np.bincount(tokens.doc[known], log_base[code[known]], n)})
                if chunk.tokens >= CHUNK_TOKENS:
                    yield from deal()
        if chunk.parts:
            yield from deal()

    return run


def _load(bodies: list[bytes], dictionary: Dictionary):
    """v, section, x, w, extra (count or document), whether w has no code, of packed token rows;
    for documents also their number in the chunk and the counts of the trigrams sent once."""
    out = []
    for body in bodies:
        data = _unpack(body)
        v, x, w = (dictionary.words(_codes(data[n]), data[n + "r"]) for n in "vxw")
        out.append((v, data["s"], x, w, data["e"], _codes(data["w"]) == _RARE, data.get("d"), data.get("n")))
    return out


def _first_epoch(shared, parts: int, total: int, types: int):
    """Bucket task: seat the training trigrams, send the tables of (context, word) to the root.

    Rows of kind 0: part, bucket, packed {code/hash, customers, tokens}; part < 0 for words with a
    code.  Kind 1: customers of the shared restaurants.  Kind 2: totals of the parts of (x, v)."""
    def run(batches):
        dictionary = shared.value[0]
        for bucket, rows in _groups(batches):
            loaded = _load(rows["body"], dictionary)
            v, s, x, w, count = (np.concatenate([p[k] for p in loaded]) for k in range(5))
            del loaded
            model = Bucket(v, s, x, w, count, bucket)
            code = dictionary.codes(model.words)
            known = code < _BEGIN_CODE
            # the root is not known yet: the sweeps of this epoch start from the unigrams
            unigram = np.full(len(code), 1.0 / (total + types + 1))
            unigram[known] = (dictionary.counts[code[known]] + 1.0) / (total + types + 1)
            model.start(unigram)
            number = dictionary.shared_number(dictionary.context_codes(model.middle_v))
            parts_of = dictionary.spread(dictionary.context_codes(model.leaf_v),
                                         dictionary.context_codes(model.leaf_x))
            if (parts_of > 1).any():
                model.share = parts_of
            for _ in range(BURN_IN):
                model.sweep()
            number = number[model.middle.restaurant]
            people = np.bincount(model.pair_word, np.where(number < 0, model.middle.t, 0),
                                 len(code)).astype(np.int64)
            tokens = np.bincount(model.pair_word[model.pair], model.count, len(code)).astype(np.int64)
            out = [(p, 0, b) for p, b in _to_root(code, model.words, people, tokens, parts)]
            pairs = np.flatnonzero(number >= 0)
            word = model.pair_word[pairs]
            key = pair_key(number[pairs], model.words[word])
            for p, at in _split((key % _U64(parts)).astype(np.int64)):
                own = code[word[at]]
                out.append((p, 1, _pack({
                    "v": _smallest(number[pairs[at]]), "w": _planes(own),
                    "wr": model.words[word[at]][own == _RARE], "c": _smallest(model.customers[pairs[at]])})))
            cut = np.flatnonzero(parts_of > 1)
            key = pair_key(model.leaf_v[cut], model.leaf_x[cut])
            tables, own = model.own_leaf()
            for p, at in _split((key % _U64(parts)).astype(np.int64)):
                out.append((p, 2, _pack({"k": key[at], "i": model.leaf_key[cut[at]], "t": tables[cut[at]],
                                        "c": own[cut[at]]})))
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([p for p, _, _ in out], pa.int32()),
                "kind": pa.array([k for _, k, _ in out], pa.int32()),
                "bucket": pa.array([bucket] * len(out), pa.int32()),
                "body": pa.array([b for _, _, b in out], pa.binary())})

    return run


def _to_root(code, words, people, tokens, parts: int) -> Iterator[tuple[int, bytes]]:
    known = code < _BEGIN_CODE
    for p, at in _split(np.where(known, -1 - code // CODES, (words % _U64(parts)).astype(np.int64))):
        yield p, _pack({"w": code[at] if p < 0 else words[at],
                        "c": _smallest(people[at]), "n": _smallest(tokens[at])})


# ---------------------------------------------------------------- shared restaurants


def _merged_pairs(bodies: list[bytes], dictionary: Dictionary):
    """(restaurant, word, code, customers) of the distinct pairs of a part; the requests' pairs."""
    data = [_unpack(b) for b in bodies]
    number = np.concatenate([x["v"].astype(np.int64) for x in data])
    code = np.concatenate([_codes(x["w"]) for x in data])
    word = dictionary.words(code, np.concatenate([x["wr"] for x in data]))
    first, inverse = group(pair_key(number, word))
    people = np.bincount(inverse, np.concatenate([x["c"].astype(float) for x in data]), len(first))
    cuts = np.cumsum([len(x["v"]) for x in data])[:-1]
    return number[first], word[first], code[first], people.astype(np.int64), np.split(inverse, cuts)


def _pair_tables(part: int, number, people, parent, state, draw: int):
    rng = np.random.default_rng([draw, part, 7])
    t, some = np.minimum(people, 1), np.flatnonzero(people > 1)
    for r, at in _split(number[some]):
        at = some[at]
        t[at] = seat(people[at], np.full(len(at), max(state["t"][r] - 1, 0.0)), parent[at], THETA,
                     state["d"][r], rng)[0]
    return t


def _unigram(dictionary: Dictionary, code: np.ndarray, total: int, types: int) -> np.ndarray:
    out = np.full(len(code), 1.0 / (total + types + 1))
    known = code < _BEGIN_CODE
    out[known] = (dictionary.counts[code[known]] + 1.0) / (total + types + 1)
    return out


def _shared_state(rows: DataFrame, shared, state, total: int, types: int) -> dict[str, np.ndarray]:
    """Customers, tables and discount of every shared restaurant (one table per dish without
    ``state``, else after a Gibbs pass); there are at most 4 * buckets of them."""
    def run(batches):
        dictionary = shared.value[0]
        for part, held in _groups(batches):
            number, _, code, c, _ = _merged_pairs(held["body"], dictionary)
            t = np.minimum(c, 1) if state is None else _pair_tables(
                part, number, c, _unigram(dictionary, code, total, types), state, 0)
            u, inverse = np.unique(number, return_inverse=True)
            yield pa.RecordBatch.from_pydict({"v": pa.array(u, pa.int64())} | {
                k: pa.array(np.bincount(inverse, n, len(u)).astype(np.int64), pa.int64())
                for k, n in (("c", c), ("t", t), ("n1", c == 1), ("n2", c == 2))})

    sums = _by_part(rows.select("part", "body")).mapInArrow(run, "v long, c long, t long, n1 long, n2 long")
    found = sums.groupBy("v").agg(*[F.sum(k).alias(k) for k in ("c", "t", "n1", "n2")]).collect()
    size = shared.value[0].shared + 1
    out = {"c": np.zeros(size), "t": np.zeros(size), "d": np.full(size, 0.5)}
    for r in found:
        out["c"][r["v"]], out["t"][r["v"]] = r["c"], r["t"]
        if r["n1"] + r["n2"]:
            out["d"][r["v"]] = np.clip(r["n1"] / (r["n1"] + 2 * r["n2"]), 0.05, 0.95)
    return out


def _by_part(rows: DataFrame) -> DataFrame:
    return rows.repartition("part").sortWithinPartitions("part")


def _shared_to_root(shared, state, parts: int, buckets: int, total: int, types: int):
    """Part task: tables of the shared restaurants as customers of the root.  The root answers
    part p as bucket ``buckets`` + p."""
    def run(batches):
        dictionary = shared.value[0]
        for part, held in _groups(batches):
            number, word, code, c, _ = _merged_pairs(held["body"], dictionary)
            t = _pair_tables(part, number, c, _unigram(dictionary, code, total, types), state, 1)
            at, inverse = group(word)
            people = np.bincount(inverse, t, len(at)).astype(np.int64)
            out = list(_to_root(code[at], word[at], people, np.zeros(len(at), np.int64), parts))
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([p for p, _ in out], pa.int32()),
                "bucket": pa.array([buckets + part] * len(out), pa.int32()),
                "body": pa.array([b for _, b in out], pa.binary())})

    return run


def _shared_answers(shared, root_shared, unseen: float, state):
    """Part task: seat the shared restaurants under the root.  Kind 4 rows for buckets: customers
    and tables of their pairs; kind 5 (target -1): tables of every restaurant."""
    def run(batches):
        dictionary, root = shared.value[0], root_shared.value
        for part, held in _groups(batches):
            asked = [(b, x) for k, b, x in zip(held["kind"], held["bucket"], held["body"]) if k == 1]
            if not asked:
                continue
            number, word, code, c, wanted = _merged_pairs([x for _, x in asked], dictionary)
            p0, known = np.full(len(code), unseen), code < _BEGIN_CODE
            p0[known] = root[code[known]]
            for kind, body in zip(held["kind"], held["body"]):
                if kind == 2:
                    answer = _unpack(body)
                    order = np.argsort(answer["w"])
                    names = answer["w"][order]
                    at = np.minimum(np.searchsorted(names, word), len(names) - 1)
                    hit = names[at] == word
                    p0[hit] = answer["p"][order][at[hit]]
            t = _pair_tables(part, number, c, p0, state, 2)
            out = []
            for (bucket, body), at in zip(asked, wanted):
                data = _unpack(body)
                out.append((bucket, 4, {"v": data["v"], "w": data["w"], "wr": data["wr"],
                                        "c": _smallest(c[at]), "t": _smallest(t[at])}))
            sums = np.bincount(number, t, len(state["t"]))
            out.append((-1, 5, {"t": sums}))
            yield _answer_rows(out)

    return run


_ANSWER = "target int, kind int, chunk long, body binary"


def _answer_rows(out: list[tuple[int, int, dict]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "target": pa.array([o[0] for o in out], pa.int32()),
        "kind": pa.array([o[1] for o in out], pa.int32()),
        "chunk": pa.array([-1] * len(out), pa.int64()),
        "body": pa.array([_pack(o[2]) for o in out], pa.binary())})


def _part_totals(batches):
    """Part task: kind 6 rows for buckets, what the other parts of their (x, v) hold."""
    for _, held in _groups(batches):
        data = [_unpack(b) for b in held["body"]]
        u, inverse = np.unique(np.concatenate([x["k"] for x in data]), return_inverse=True)
        tables, people = (np.bincount(inverse, np.concatenate([x[k] for x in data]), len(u)).astype(np.int64)
                          for k in "tc")
        out, low = [], 0
        for bucket, x in zip(held["bucket"], data):
            at = inverse[low:low + len(x["k"])]
            low += len(at)
            out.append((bucket, 6, {"i": x["i"], "t": tables[at] - x["t"], "c": people[at] - x["c"]}))
        yield _answer_rows(out)


def _split(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(key, kind="stable")
    if len(order):
        cuts = np.flatnonzero(np.diff(key[order], prepend=key[order[0]] - 1))
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            yield int(key[order[a]]), order[a:b]


def _merged(bodies: list[bytes]):
    """(words, customers, tokens, the requests' words) of a part."""
    data = [_unpack(b) for b in bodies]
    wanted = [x["w"] for x in data]
    words, inverse = np.unique(np.concatenate(wanted), return_inverse=True)
    people = np.bincount(inverse, np.concatenate([x["c"].astype(float) for x in data]), len(words))
    tokens = np.bincount(inverse, np.concatenate([x["n"].astype(float) for x in data]), len(words))
    return words, people.astype(np.int64), tokens.astype(np.int64), wanted


def _few_requests(requests: DataFrame, buckets: int) -> DataFrame:
    """Requests for words with a code (which are not answered by bucket) added up over groups of
    about the square root of the buckets, so that a part's task meets no more rows than that."""
    groups = max(1, int(np.ceil(np.sqrt(buckets))))

    def add(batches):
        for lot, rows in _groups(batches):
            words, people, tokens, _ = _merged(rows["body"])
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([-1 - lot // groups], pa.int32()), "bucket": pa.array([-1], pa.int32()),
                "body": pa.array([_pack({"w": words, "c": _smallest(people), "n": _smallest(tokens)})],
                                 pa.binary())})

    lot = (F.lit(-1) - F.col("part")) * groups + F.pmod("bucket", F.lit(groups))
    coded = requests.where("part < 0").select(lot.alias("lot"), "body")
    coded = coded.repartition("lot").sortWithinPartitions("lot").mapInArrow(add, "part int, bucket int, body binary")
    return requests.where("part >= 0").unionByName(materialize(coded, "lm-root-sums"))


def _root_tables(part: int, people: np.ndarray, tables: float, types: int, d: float, draw: int):
    rng = np.random.default_rng([draw, abs(part), int(part < 0)])
    some = people > 1
    t = np.minimum(people, 1)
    base = np.full(int(some.sum()), 1.0 / (types + 1))
    t[some] = seat(people[some], np.full(len(base), max(tables - 1, 0.0)), base, THETA_ROOT, d, rng)[0]
    return t


def _root_totals(requests: DataFrame, d: float, tables: float, types: int):
    """One Gibbs pass over the root: (customers, tables, dishes with 1 and with 2 customers)."""
    def run(batches):
        for part, rows in _groups(batches):
            _, people, _, _ = _merged(rows["body"])
            t = _root_tables(part, people, tables, types, d, 0)
            yield pa.RecordBatch.from_pydict({
                k: pa.array([int(n)], pa.int64()) for k, n in
                (("c", people.sum()), ("t", t.sum()), ("n1", (people == 1).sum()),
                 ("n2", (people == 2).sum()))})

    dealt = requests.select("part", "body").repartition("part").sortWithinPartitions("part")
    sums = dealt.mapInArrow(run, "c long, t long, n1 long, n2 long").agg(
        *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("c", "t", "n1", "n2")]).first()
    return tuple(sums)


def _root_answers(requests: DataFrame, d: float, people_all: int, tables: float, types: int):
    """P0 averaged over several root seatings: kind 2 rows for buckets (words without a code),
    kind 3 rows (target -1) with the coded words."""
    def run(batches):
        for part, rows in _groups(batches):
            words, people, tokens, wanted = _merged(rows["body"])
            p0 = np.zeros(len(words))
            for draw in range(SAMPLES):
                t = _root_tables(part, people, tables, types, d, 1 + draw)
                p0 += (people - d * t + (THETA_ROOT + d * tables) / (types + 1)) / (THETA_ROOT + people_all)
            p0 /= SAMPLES
            if part < 0:
                out = [(-1, 3, {"w": words, "p": p0})]
            else:
                out = []
                for bucket, w in zip(rows["bucket"], wanted):
                    at = np.searchsorted(words, w)
                    out.append((bucket, 2, {"w": w, "p": p0[at], "n": _smallest(tokens[at])}))
            yield _answer_rows(out)

    dealt = requests.repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, "target int, kind int, chunk long, body binary")


def _second_epoch(shared, root_shared, unseen: float, total: int, types: int, state):
    """Bucket task: seat again under the root, average predictions, sum them by document."""
    def run(batches):
        dictionary, root = shared.value[0], root_shared.value
        for bucket, rows in _groups(batches):
            posts = [(c, b) for k, c, b in zip(rows["kind"], rows["chunk"], rows["body"]) if k == 0]
            answers = {n: [_unpack(b) for k, b in zip(rows["kind"], rows["body"]) if k == n] for n in (2, 4, 6)}
            out = [(c, 1, b) for k, c, b in zip(rows["kind"], rows["chunk"], rows["body"]) if k == 1]
            if posts:
                out += _score_bucket(bucket, posts, answers, dictionary, root, unseen, total, types,
                                     state)
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array([o[0] for o in out], pa.int64()),
                "kind": pa.array([o[1] for o in out], pa.int32()),
                "body": pa.array([o[2] for o in out], pa.binary())})

    return run


def _score_bucket(bucket, posts, answers, dictionary, root, unseen, total, types, state):
    loaded = _load([b for _, b in posts], dictionary)
    size = [len(p[0]) for p in loaded]
    documents = [np.cumsum(p[4], dtype=np.int64) for p in loaded]
    v, s, x, w, rare = (np.concatenate([p[k] for p in loaded]) for k in (0, 1, 2, 3, 5))
    train = []
    for p, d in zip(loaded, documents):
        n = 1 - (d & 1)
        n[(d >> 1) >= p[6]] = p[7]
        train.append(n)
    del loaded
    model = Bucket(v, s, x, w, np.concatenate(train), bucket)
    del v, s, x
    code = dictionary.codes(model.words)
    known = code < _BEGIN_CODE
    p0, tokens = np.full(len(code), unseen), np.zeros(len(code), np.int64)
    p0[known] = root[code[known]]
    for answer in answers[2]:
        at = np.searchsorted(model.words, answer["w"])
        hit = at < len(model.words)
        hit[hit] = model.words[at[hit]] == answer["w"][hit]
        p0[at[hit]], tokens[at[hit]] = answer["p"][hit], answer["n"][hit]
    model.start(p0)
    _share(model, answers, dictionary, state)
    for _ in range(BURN_IN):
        model.sweep()
    mean = np.zeros(len(model.count))
    for _ in range(SAMPLES):
        model.sweep()
        mean += model.predict()
    logs = np.log10(mean / SAMPLES)[model.inverse]
    n = tokens[np.searchsorted(model.words, w[rare])]
    base = np.log10((n + 1.0) / (total + types + 1))
    out, low, low_rare = [], 0, 0
    for (name, _), rows, doc in zip(posts, size, documents):
        doc = doc >> 1
        own = rare[low:low + rows]
        rare_doc = doc[own]
        high_rare = low_rare + len(rare_doc)
        ids, inverse = np.unique(doc, return_inverse=True)
        rare_ids, rare_inverse = np.unique(rare_doc, return_inverse=True)
        out.append((name, 0, _pack({
            "doc": _smallest(np.diff(ids, prepend=0)),
            "score": np.bincount(inverse, logs[low:low + rows], len(ids)).astype(np.float32),
            "rare": _smallest(np.diff(rare_ids, prepend=0)),
            "known": _smallest(np.bincount(rare_inverse, n[low_rare:high_rare] > 0,
                                           len(rare_ids)).astype(np.int64)),
            "base": np.bincount(rare_inverse, base[low_rare:high_rare], len(rare_ids))})))
        low, low_rare = low + rows, high_rare
    return out


def _share(model: Bucket, answers, dictionary: Dictionary, state) -> None:
    """Give a started bucket what the shared restaurants and other parts of its contexts hold."""
    number = dictionary.shared_number(dictionary.context_codes(model.middle_v))
    restaurants = np.flatnonzero(number >= 0)
    if not len(restaurants):
        return
    of_pair = number[model.middle.restaurant]
    pairs = np.flatnonzero(of_pair >= 0)
    key = pair_key(of_pair[pairs], model.words[model.pair_word[pairs]])
    c, t = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    if answers[4]:
        data = answers[4]
        told = pair_key(np.concatenate([x["v"] for x in data]),
                        np.concatenate([dictionary.words(_codes(x["w"]), x["wr"]) for x in data]))
        at, hit = _found(told, key)
        c[hit], t[hit] = (np.concatenate([x[k] for x in data])[at[hit]] for k in "ct")
    own = number[restaurants]
    model.share_middle(pairs, c, t, restaurants, state["d"][own], state["t"][own], state["c"][own])
    # two sections of one context can share a bucket: each part has an answer of its own
    if answers[6]:
        data = answers[6]
        at, hit = _found(np.concatenate([x["i"] for x in data]), model.leaf_key)
        tables, people = (np.concatenate([x[k] for x in data])[at[hit]] for k in "tc")
        model.share_leaf(np.flatnonzero(hit), tables, people)


def _found(names: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``names``, whether it is there) of every wanted key."""
    order = np.argsort(names)
    at = order[np.minimum(np.searchsorted(names[order], wanted), len(names) - 1)]
    return at, names[at] == wanted


def _finish(total: int):
    """Chunk task: add the buckets' partial sums to the documents."""
    def run(batches):
        for _, rows in _groups(batches):
            table = next(_unpack(b) for k, b in zip(rows["kind"], rows["body"]) if k == 1)
            size, once = len(table["n"]), int(table["ok"].max()) + 1 if len(table["ok"]) else 0
            score = np.zeros(size + once)     # behind the documents: trigrams that were sent once
            base, known = (np.append(table[k], np.zeros(once)) for k in ("base", "known"))
            for kind, body in zip(rows["kind"], rows["body"]):
                if kind == 0:
                    part = _unpack(body)
                    score[np.cumsum(part["doc"].astype(np.int64))] += part["score"]
                    at = np.cumsum(part["rare"].astype(np.int64))
                    base[at] += part["base"]
                    known[at] += part["known"]
            score, base, known = (
                a[:size] + np.bincount(table["od"], table["on"] * a[size + table["ok"]], size)
                for a in (score, base, known))
            known = known.astype(np.int64)
            yield pa.RecordBatch.from_pydict({
                "id": pa.array(table["id"], pa.int64(), mask=table["null"].astype(bool)),
                "held_out": pa.array(table["held"], pa.bool_()),
                "n_tokens": pa.array(table["n"], pa.int64()),
                "n_known": pa.array(known, pa.int64()),
                "train_tokens": pa.array([total] * len(score), pa.int64()),
                "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64())})

    return run


def score_corpus(docs: DataFrame, held_out, doc_id: str = "doc_id", text: str = "text",
                 bucket_tokens: int = BUCKET_TOKENS, dictionary_size: int = DICTIONARY) -> DataFrame:
    """Learn from the rows where ``held_out`` is not true, score every row.

    Returns ``doc_id``, held_out, n_tokens, n_known, train_tokens, base_score (smoothed unigram)
    and score (log10 probability under the model).
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    frame = _frame(docs, doc_id, text, held_out)
    parts = 2 * shuffle_partitions(spark)
    vocab = materialize(vocabulary(frame, parts), "lm-vocabulary")
    total, types = vocab.agg(F.coalesce(F.sum("tokens"), F.lit(0)),
                             F.coalesce(F.sum("types"), F.lit(0))).first()
    words, counts = most_frequent(vocab, min(dictionary_size, DICTIONARY), parts)
    buckets = max(1, -(-total // bucket_tokens))
    dictionary = Dictionary(words, counts, bucket_tokens / 4)
    log_base = np.log10((counts + 1.0) / (total + types + 1))

    mapper = sc.broadcast((dictionary, buckets, log_base))
    first = frame.mapInArrow(_token_rows(mapper, True), "target int, kind int, chunk long, body binary")
    first = first.repartition(buckets, "target").sortWithinPartitions("target")
    seated = materialize(first.mapInArrow(
        _first_epoch(mapper, parts, total, types),
        "part int, kind int, bucket int, body binary"), "lm-root-customers")
    requests = seated.where("kind = 0").select("part", "bucket", "body")
    pairs = seated.where("kind = 1")
    state = None
    if dictionary.shared or dictionary.begin_sections > 1:
        state = _shared_state(pairs, mapper, None, total, types)
        state["t"] = _shared_state(pairs, mapper, state, total, types)["t"]
        requests = requests.unionByName(materialize(_by_part(pairs).mapInArrow(
            _shared_to_root(mapper, state, parts, buckets, total, types),
            "part int, bucket int, body binary"), "lm-shared-customers"))

    requests = _few_requests(requests, buckets)
    people, tables, n1, n2 = _root_totals(requests, 0.5, types, types)
    d = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
    _, tables, _, _ = _root_totals(requests, d, tables, types)
    answers = materialize(_root_answers(requests, d, people, tables, types), "lm-root")
    unseen = (THETA_ROOT + d * tables) / (types + 1) / (THETA_ROOT + people)
    root = np.full(len(words), unseen)
    for row in answers.where("kind = 3").select("body").collect():
        data = _unpack(row["body"])
        root[data["w"]] = data["p"]

    root_shared = sc.broadcast(root)
    replies = answers.where(F.col("kind") == 2)
    if dictionary.shared or dictionary.begin_sections > 1:
        # the shared restaurants again, under the root
        told = replies.where(F.col("target") >= buckets).select(
            (F.col("target") - buckets).alias("part"), "kind", F.lit(-1).alias("bucket"), "body")
        seats = materialize(_by_part(pairs.unionByName(told)).mapInArrow(
            _shared_answers(mapper, root_shared, unseen, state), _ANSWER), "lm-shared")
        state["t"] = np.sum([_unpack(r["body"])["t"] for r in
                             seats.where("kind = 5").select("body").toLocalIterator()], axis=0)
        replies = (replies.where(F.col("target") < buckets).unionByName(seats.where("kind = 4"))
                   .unionByName(_by_part(seated.where("kind = 2")).mapInArrow(_part_totals, _ANSWER)))

    posts = frame.mapInArrow(_token_rows(mapper, False), "target int, kind int, chunk long, body binary")
    dealt = (posts.unionByName(replies)
             .repartition(buckets, "target").sortWithinPartitions("target"))
    sums = dealt.mapInArrow(_second_epoch(mapper, root_shared, unseen, total, types, state),
                            "chunk long, kind int, body binary")
    out = (sums.repartition("chunk").sortWithinPartitions("chunk")
           .mapInArrow(_finish(total), "id long, held_out boolean, n_tokens long, n_known long, "
                       "train_tokens long, base_score double, score double"))
    return out.withColumnRenamed("id", doc_id)

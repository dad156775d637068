"""URL rules in a sorted digest array.

Rules (host, path, verdict) are written to one file: the sorted 64-bit xxhash
keys of ``host + path``, the strings themselves, and their verdicts.  Tasks
memory-map that file, probe all of a batch's candidate strings with one
vectorised binary search, and confirm every key hit against the stored string,
so a colliding key never decides.

A rule fits its host and all subdomains of it if the URL's path starts with
the rule's path; of the fitting rules the longest string wins (then the longer
host).  URLs that no rule fits get ``default``.

Rule sets above ``MAX_FILE_RULES`` are cut into several files, probed one after
the other with the best rule so far carried along; no shuffle in either case.

Defined results: a null URL or one without ``://`` has empty host and path and
fits no rule; repeated rows give repeated rows; other columns pass through,
except that ``host``, ``path``, ``rule`` and ``verdict`` are replaced; no rules
at all leaves every row at ``default``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txsentinel.session import write_shared_file

MAX_FILE_RULES = 2_000_000
PROBE_ROWS = 20_000

Rule = tuple[str, str, str]  # host, path, verdict


def split_url(url: str | None) -> tuple[str, str]:
    """Host after the first ``://`` up to ``/ ? #``; path from there up to ``?`` or ``#``."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    found = _URL.match(url, at + 3)
    return found[1].translate(_ASCII_LOWER), found[2]


_URL = re.compile(r"([^/?#]*)([^?#]*)", re.S)
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def keys_of(strings: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s) for s in strings), np.uint64, len(strings))


def write_array(rules: list[Rule]) -> bytes:
    """File image: sizes, sorted keys, string offsets, host lengths, verdict numbers, path
    lengths in use, verdict names, strings."""
    strings = [(h + p).encode() for h, p, _ in rules]
    keys = keys_of(strings)
    order = np.argsort(keys, kind="stable")
    names = sorted({v for _, _, v in rules})
    lengths = np.array(sorted({len(p.encode()) for _, p, _ in rules}), np.uint64)
    blob = b"".join(strings[i] for i in order)
    offsets = np.zeros(len(rules) + 1, np.uint64)
    np.cumsum([len(strings[i]) for i in order], out=offsets[1:])
    hosts = np.array([len(rules[i][0].encode()) for i in order], np.uint64)
    verdict = np.array([names.index(rules[i][2]) for i in order], np.uint64)
    head = "\n".join(names).encode()
    sizes = np.array([len(rules), len(lengths), len(head)], np.uint64)
    return b"".join([sizes.tobytes(), keys[order].tobytes(), offsets.tobytes(), hosts.tobytes(),
                     verdict.tobytes(), lengths.tobytes(), head, blob])


class DigestArray:
    """Read side of ``write_array`` over a memory map."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n, k, head = (int(x) for x in raw[:24].view(np.uint64))
        at = 24

        def numbers(count):
            nonlocal at
            out = raw[at:at + 8 * count].view(np.uint64)
            at += 8 * count
            return out

        self.keys, self.offsets = numbers(n), numbers(n + 1)
        self.hosts, self.verdicts = numbers(n), numbers(n)
        self.lengths = numbers(k).tolist()
        self.names = bytes(raw[at:at + head]).decode().split("\n")
        self.blob = raw[at + head:]

    def probe(self, hosts: list[str], paths: list[str]) -> list[tuple[str, str] | None]:
        """Longest fitting rule of each (host, path): (rule string, verdict) or None."""
        strings, owner, cut = [], [], []
        for i, (host, path) in enumerate(zip(hosts, paths)):
            h, p = host.encode(), path.encode()
            heads = [p[:n] for n in self.lengths if n <= len(p)]
            if not h or not heads:
                continue
            at = 0
            while True:
                suffix = h[at:]
                for head in heads:
                    strings.append(suffix + head)
                    owner.append(i)
                    cut.append(len(suffix))
                dot = h.find(b".", at)
                if dot < 0:
                    break
                at = dot + 1
        best: list[tuple[int, int, int] | None] = [None] * len(hosts)
        keys = keys_of(strings)
        first = np.searchsorted(self.keys, keys, "left")
        after = np.searchsorted(self.keys, keys, "right")
        for c in np.flatnonzero(after > first):
            for r in range(int(first[c]), int(after[c])):
                stored = bytes(self.blob[int(self.offsets[r]):int(self.offsets[r + 1])])
                if stored != strings[c] or int(self.hosts[r]) != cut[c]:
                    continue
                rank = (len(stored), cut[c], r)
                if best[owner[c]] is None or rank > best[owner[c]]:
                    best[owner[c]] = rank
        out = []
        for found in best:
            if found is None:
                out.append(None)
            else:
                r = found[2]
                out.append((bytes(self.blob[int(self.offsets[r]):int(self.offsets[r + 1])]).decode(),
                            self.names[int(self.verdicts[r])], found[1]))
        return out


_OPEN: dict[str, DigestArray] = {}


def _array(name: str) -> DigestArray:
    if name not in _OPEN:
        _OPEN[name] = DigestArray(SparkFiles.get(name))
    return _OPEN[name]


def ship_rules(spark: SparkSession, rules: Iterable[Rule],
               max_rules: int = MAX_FILE_RULES) -> list[str]:
    """Write the rules as digest-array files, add them to the session, return their names."""
    unique = sorted({(h, p): v for h, p, v in rules}.items())
    rows = [(h, p, v) for (h, p), v in unique]
    names = []
    for at in range(0, len(rows), max_rules):
        name = f"url-rules-{uuid.uuid4().hex}.bin"
        spark.sparkContext.addFile(write_shared_file(spark, name, write_array(rows[at:at + max_rules])))
        names.append(name)
    return names


def judge_urls(pages: DataFrame, rules: Iterable[Rule], url: str = "url", default: str = "allow",
               max_rules: int = MAX_FILE_RULES) -> DataFrame:
    """All columns of ``pages`` plus host, path, rule (null if none fits), verdict."""
    files = ship_rules(pages.sparkSession, rules, max_rules)
    added = ("host", "path", "rule", "verdict")
    kept = [f for f in pages.schema.fields if f.name not in added]
    frame = pages.select(*[F.col(f"`{f.name}`") for f in kept],
                         F.col(f"`{url}`").cast("string").alias("host"))
    schema = T.StructType(kept + [T.StructField(n, T.StringType()) for n in added])

    def judge(batches):
        arrays = [_array(name) for name in files]
        for whole in batches:
            for at in range(0, whole.num_rows, PROBE_ROWS):
                batch = whole.slice(at, PROBE_ROWS)
                parts = [split_url(u) for u in batch.column(batch.num_columns - 1).to_pylist()]
                hosts, paths = [h for h, _ in parts], [p for _, p in parts]
                best = [None] * len(parts)
                for array in arrays:
                    for i, found in enumerate(array.probe(hosts, paths)):
                        if found and (best[i] is None
                                      or (len(found[0].encode()), found[2])
                                      > (len(best[i][0].encode()), best[i][2])):
                            best[i] = found
                yield pa.RecordBatch.from_arrays(
                    batch.columns[:-1] + [
                        pa.array(hosts, pa.string()), pa.array(paths, pa.string()),
                        pa.array([b and b[0] for b in best], pa.string()),
                        pa.array([b[1] if b else default for b in best], pa.string())],
                    names=batch.schema.names[:-1] + list(added))

    return frame.mapInArrow(judge, schema)

"""Keyed pseudo-random numbers as pure column expressions.

U(id, salt) = (first 32 bits of md5("<id>:<salt>") + 0.5) / 2^32, in (0, 1).
The value depends only on the key and the salt, so it is the same on every
executor, after any recomputation, and in any SQL engine with md5.
"""

from __future__ import annotations

import math
from hashlib import md5

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed_uniform(key: Column | str, salt: str) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(k.cast("string"), F.lit(":" + salt)))
    bits = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(4294967296.0)


def keyed_normal(key: Column | str, salt1: str, salt2: str) -> Column:
    """Standard normal via Box-Muller on two keyed uniforms."""
    u1 = keyed_uniform(key, salt1)
    u2 = keyed_uniform(key, salt2)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def keyed_normal_pair(key: Column | str, salt1: str, salt2: str) -> tuple[Column, Column]:
    """Two independent standard normals from the same two keyed uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.log(keyed_uniform(key, salt1)))
    angle = F.lit(2.0 * math.pi) * keyed_uniform(key, salt2)
    return radius * F.cos(angle), radius * F.sin(angle)


def keyed_uniforms(keys: list[bytes], salt: str) -> np.ndarray:
    """``keyed_uniform`` of the keys (their text as bytes) inside a task: the same numbers."""
    tail = f":{salt}".encode()
    digests = b"".join([md5(k + tail, usedforsecurity=False).digest()[:4] for k in keys])
    return (np.frombuffer(digests, dtype=">u4").astype(float) + 0.5) / 4294967296.0

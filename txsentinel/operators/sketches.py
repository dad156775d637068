"""Mergeable summaries (A8, A13 at scale): quantiles and distinct counts without a second pass.

A sketch table has one row and one binary column of bounded size per slice (a
day, a model and class, a file).  Slices are summarised once, written, and
merged in any grouping later; rows are never read again and never shuffled.

* KLL (``score_sketches``): the rank of a returned quantile is off by at most
  ``kll_rank_error(k)`` of n, with 99 % confidence.
* HyperLogLog (``distinct_sketches``): relative standard error
  ``hll_relative_error(lg_k)``; exact for few values.

NULL and NaN values are not counted; a group without values has a NULL
quantile and a distinct count of 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size parameter of the quantile sketches (about 3 k doubles at any n).
KLL_K = 1024
#: Log2 of the registers of the distinct sketches (one register is 4 bits to a byte).
HLL_LG_K = 14


def kll_rank_error(k: int = KLL_K) -> float:
    """Rank error of one quantile, 99 % confidence: the published fit 2.296 / k^0.9021."""
    return 2.296 / k ** 0.9021


def hll_relative_error(lg_k: int = HLL_LG_K) -> float:
    return 1.04 / 2 ** (lg_k / 2)


def score_sketches(rows: DataFrame, by: Sequence[str], value: str = "score", k: int = KLL_K) -> DataFrame:
    """(by..., sketch): one KLL sketch of ``value`` per slice; partial sketches merge map-side."""
    v = F.col(value).cast("double")
    return rows.groupBy(*by).agg(F.kll_sketch_agg_double(F.when(~F.isnan(v), v), k).alias("sketch"))


def merge_score_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Slices of a coarser grouping become one sketch each."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(sketches: DataFrame, by: Sequence[str], quantiles: dict[str, float]) -> DataFrame:
    """(by..., n, one column per quantile) from merged sketches."""
    n = F.kll_sketch_get_n_double("sketch")
    return sketches.select(*by, n.alias("n"), *[
        F.when(n > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(q)))).alias(name)
        for name, q in quantiles.items()])


def distinct_sketches(rows: DataFrame, by: Sequence, value: str = "customer_id", lg_k: int = HLL_LG_K) -> DataFrame:
    """(by..., sketch): one HyperLogLog sketch of ``value`` per slice."""
    return rows.groupBy(*by).agg(F.hll_sketch_agg(value, F.lit(lg_k)).alias("sketch"))


def distinct_from_sketches(sketches: DataFrame, by: Sequence[str] = (), name: str = "n_customers") -> DataFrame:
    """Distinct values of any union of slices."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(name))

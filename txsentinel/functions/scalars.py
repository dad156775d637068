"""Column expressions (all JVM-side, codegen friendly).

Null model: every missing or undefined value is SQL NULL.  Readers turn NaN
into NULL so Spark's skip-NULL aggregates behave like pandas' skip-NaN ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nan_to_null(x: ColumnOrName) -> Column:
    """NaN -> NULL (doubles only)."""
    return F.nanvl(_c(x), F.lit(None).cast("double"))


def safe_divide(num: ColumnOrName, den: ColumnOrName) -> Column:
    """num / den, NULL when den is 0 or NULL (ANSI `/` would raise)."""
    return F.try_divide(_c(num), _c(den))


def amount_deviation(amount: ColumnOrName = "transaction_amount",
                     mean: ColumnOrName = "cust_mean") -> Column:
    return _c(amount) - _c(mean)


def amount_zscore(amount: ColumnOrName = "transaction_amount",
                  mean: ColumnOrName = "cust_mean",
                  std: ColumnOrName = "cust_std") -> Column:
    """(amount - mean) / std; std 0 gives NULL (pandas gives NaN/Inf)."""
    return safe_divide(_c(amount) - _c(mean), _c(std))


def amount_to_median_ratio(amount: ColumnOrName = "transaction_amount",
                           median: ColumnOrName = "cust_median") -> Column:
    """amount / median with a median of 0 replaced by 1."""
    med = _c(median)
    return _c(amount) / F.when(med == 0, F.lit(1.0)).otherwise(med)


def cyclical(x: ColumnOrName, period: float) -> tuple[Column, Column]:
    """(sin, cos) of 2*pi*x/period."""
    angle = F.lit(2.0 * math.pi) * _c(x) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def clean_value(x: ColumnOrName) -> Column:
    """NULL, NaN and +-Inf -> 0.0; everything else cast to double."""
    v = _c(x).cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(v)


def clip(x: ColumnOrName, bound: float) -> Column:
    return F.least(F.greatest(_c(x), F.lit(-float(bound))), F.lit(float(bound)))


def flag(score: ColumnOrName, threshold: float | Column, strict: bool = True) -> Column:
    """1 if score > threshold (strict) or score >= threshold, else 0."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    cond = _c(score) > t if strict else _c(score) >= t
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def iforest_flag(raw_label: ColumnOrName) -> Column:
    """-1 (outlier) / 1 (inlier) -> 1 / 0."""
    return F.when(_c(raw_label) == -1, F.lit(1)).otherwise(F.lit(0))


def planar_distance_km(lat: ColumnOrName, lon: ColumnOrName,
                       home_lat: ColumnOrName, home_lon: ColumnOrName) -> Column:
    """sqrt(dlat^2 + dlon^2) * 111 (planar degrees, not haversine)."""
    dlat = _c(lat) - _c(home_lat)
    dlon = _c(lon) - _c(home_lon)
    return F.sqrt(dlat * dlat + dlon * dlon) * F.lit(111.0)


def clock_hour(hour: ColumnOrName) -> Column:
    """floor(hour) mod 24, never negative."""
    return F.pmod(F.floor(_c(hour)).cast("int"), F.lit(24))


def round_money(x: ColumnOrName) -> Column:
    """Round to cents, half away from zero for positive values: floor(x*100+0.5)/100."""
    return F.floor(_c(x) * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)


def timestamp_from_hours(hours: ColumnOrName, base: str = "2026-03-01 00:00:00") -> Column:
    """base + floor(hours) whole hours, as timestamp_ntz."""
    base_ts = F.lit(base).cast("timestamp_ntz")
    return F.timestamp_add("HOUR", F.floor(_c(hours)).cast("long"), base_ts)


def vector_mse(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Mean squared difference of two equal-length array<double> columns."""
    diffs = F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))
    total = F.aggregate(diffs, F.lit(0.0), lambda acc, x: acc + x)
    return total / F.size(_c(a))


def key_expr(col: str, dtype) -> Column:
    """A column as a value that survives collect() without time zone shifts:
    timestamp_ntz as its ISO string, timestamp as epoch microseconds."""
    t = dtype.simpleString()
    if t == "timestamp_ntz":
        return F.date_format(F.col(col), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if t == "timestamp":
        return F.unix_micros(F.col(col))
    return F.col(col)


def typed_lit(value, dtype) -> Column:
    """Literal of ``dtype`` from a value produced by ``key_expr`` (or plain)."""
    import datetime as _dt
    t = dtype.simpleString()
    if value is None:
        return F.lit(None).cast(dtype)
    if t == "timestamp_ntz":
        if isinstance(value, _dt.datetime):
            value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
        return F.lit(str(value)).cast("timestamp_ntz")
    if t == "timestamp" and not isinstance(value, _dt.datetime):
        return F.timestamp_micros(F.lit(int(value)))
    return F.lit(value).cast(dtype)

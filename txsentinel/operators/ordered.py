"""Ordered operators without a single partition.

A window with ORDER BY and no PARTITION BY runs in one task.  Everything here
instead range-partitions the rows on the order keys (Spark samples the keys
and picks the boundaries), pins the partition id by materializing the table
under the checkpoint folder, and combines per-partition results through a
table with one row per partition:

* ``running_totals`` -- prefix sums in a global order, optionally restarting
  per group (G1).  A hot group is spread over many range partitions.
* ``global_position`` -- 0-based position in a total order.
* ``exact_quantiles`` -- exact linear-interpolated quantiles per group from
  pre-aggregated (group, value, count) rows, so a hot group never has to fit
  in one task (A8, A1 median).
* ``positional_split`` (W5) and ``purged_kfold`` (W6).
* ``keys_at_ranks`` -- the keys at given ranks by rounds of bounded histograms,
  for splits and folds that need no positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txsentinel.functions.scalars import key_expr, typed_lit
from txsentinel.session import materialize, shuffle_partitions

PID = "_pid"


def _sort_exprs(order: Sequence[Column | str]) -> list[Column]:
    """Ascending sort keys; NULL comes last (as a missing time does in pandas)."""
    return [F.col(o).asc_nulls_last() if isinstance(o, str) else o for o in order]


def range_partition(df: DataFrame, order: Sequence[Column | str],
                    num_partitions: int | None = None, name: str = "ranged") -> DataFrame:
    """Range-partition on ``order`` and persist each row's partition id.

    Equal keys always land in one partition; consecutive partition ids hold
    consecutive key ranges.
    """
    n = num_partitions or shuffle_partitions(df.sparkSession)
    ranged = df.repartitionByRange(n, *_sort_exprs(order)).withColumn(
        PID, F.spark_partition_id())
    return materialize(ranged, name)


def _partition_offsets(ranged: DataFrame, weights: Sequence[str]
                       ) -> tuple[DataFrame, dict[str, float]]:
    """One row per partition id: the sums of ``weights`` in all earlier partitions,
    plus the grand totals.

    The per-partition totals are at most num_partitions rows, so the prefix is
    taken on the driver and the result joined back by broadcast.
    """
    spark = ranged.sparkSession
    totals = (ranged.groupBy(PID)
              .agg(*[F.sum(w).alias(w) for w in weights])
              .collect())
    totals.sort(key=lambda r: r[PID])
    kinds = {w: _sum_type(ranged, w) for w in weights}
    cast = {w: (float if kinds[w] == "double" else int) for w in weights}
    running = {w: cast[w](0) for w in weights}
    rows = []
    for r in totals:
        rows.append((int(r[PID]), *[running[w] for w in weights]))
        for w in weights:
            running[w] += cast[w](r[w] or 0)
    schema = ", ".join([f"{PID} int"] + [f"_off_{w} {kinds[w]}" for w in weights])
    return spark.createDataFrame(rows, schema), running


def _sum_type(df: DataFrame, col: str) -> str:
    t = df.schema[col].dataType.simpleString()
    return "double" if t in ("double", "float") or t.startswith("decimal") else "bigint"


def running_totals(df: DataFrame, order: Sequence[Column | str],
                   sums: dict[str, Column | str],
                   group_cols: Sequence[str] = (),
                   group_totals: bool = False,
                   num_partitions: int | None = None) -> DataFrame:
    """Inclusive prefix sums of ``sums`` in ``order`` (within ``group_cols``).

    The order keys (together with the group keys) should be unique; among
    equal keys the prefix order is arbitrary.  Pre-aggregate duplicates first.
    Adds one column per entry of ``sums``; with ``group_totals`` also
    ``<name>_total`` holding the group's full sum.
    """
    group_cols = list(group_cols)
    weights = {}
    work = df
    all_sums = dict(sums)
    if group_cols:
        all_sums["_seq"] = F.lit(1).cast("long")  # strictly increasing along the order
    for name, expr in all_sums.items():
        wcol = f"_w_{name}"
        e = F.col(expr) if isinstance(expr, str) else expr
        work = work.withColumn(wcol, e)
        weights[name] = wcol
    keys = [F.col(g).asc() for g in group_cols] + _sort_exprs(order)
    ranged = range_partition(work, keys, num_partitions, name="running")
    offsets, grand = _partition_offsets(ranged, list(weights.values()))
    frame = (Window.partitionBy(PID).orderBy(*keys)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = ranged.join(F.broadcast(offsets), PID, "left")
    for name, wcol in weights.items():
        out = out.withColumn(name, F.coalesce(F.col(f"_off_{wcol}"), F.lit(0))
                             + F.sum(wcol).over(frame))
    if group_cols:
        # Global prefix -> per-group prefix: subtract the prefix before the
        # group's first row (located by the running row count, so any sign of
        # weights works).  Partial aggregation keeps a hot group cheap.
        aggs = []
        for name, wcol in weights.items():
            if name == "_seq":
                continue
            aggs.append(F.min_by(F.col(name) - F.col(wcol), F.col("_seq")).alias(f"_start_{name}"))
            if group_totals:
                aggs.append(F.max_by(F.col(name), F.col("_seq")).alias(f"_end_{name}"))
        starts = out.groupBy(*group_cols).agg(*aggs)
        # null-safe join: a NULL group is a group too
        out = out.join(starts.withColumnsRenamed({g: f"_g_{g}" for g in group_cols}),
                       [out[g].eqNullSafe(F.col(f"_g_{g}")) for g in group_cols], "inner"
                       ).drop(*[f"_g_{g}" for g in group_cols])
        for name in sums:
            if group_totals:
                out = out.withColumn(f"{name}_total",
                                     F.col(f"_end_{name}") - F.col(f"_start_{name}"))
            out = out.withColumn(name, F.col(name) - F.col(f"_start_{name}"))
        out = out.drop("_seq")
    elif group_totals:
        for name, wcol in weights.items():
            out = out.withColumn(f"{name}_total", F.lit(grand[wcol]))
    drop = [PID] + [f"_off_{w}" for w in weights.values()] + list(weights.values())
    drop += [c for c in out.columns if c.startswith("_start_") or c.startswith("_end_")]
    return out.drop(*drop)


def global_position(df: DataFrame, order: Sequence[Column | str],
                    name: str = "pos", num_partitions: int | None = None) -> DataFrame:
    """0-based position of every row in ``order`` (keys should be unique)."""
    out = running_totals(df, order, {name: F.lit(1).cast("long")},
                         num_partitions=num_partitions)
    return out.withColumn(name, F.col(name) - 1)


def exact_quantiles(df: DataFrame, value: str, quantiles: dict[str, float],
                    group_cols: Sequence[str] = (),
                    num_partitions: int | None = None, method: str = "ranged") -> DataFrame:
    """Exact quantiles with linear interpolation (numpy 'linear', SQL quantile_cont).

    Rank h = (n - 1) * q; result = v[floor h] + (v[ceil h] - v[floor h]) * (h - floor h).
    NULL values are ignored.

    method='ranged': work on (group, value) -> count rows ranked with
    ``running_totals``; no group is gathered into one task, however large.
    method='builtin': Spark's exact ``percentile`` (partial aggregation of
    value -> count maps; a group's final merge runs in one task).
    """
    group_cols = list(group_cols)
    if method == "builtin":
        g = df.where(F.col(value).isNotNull())
        g = g.groupBy(*group_cols) if group_cols else g.groupBy()
        return g.agg(*[F.percentile(F.col(value).cast("double"), float(q)).alias(name)
                       for name, q in quantiles.items()])
    counts = (df.where(F.col(value).isNotNull())
              .groupBy(*group_cols, value).agg(F.count(F.lit(1)).alias("_cnt")))
    ranked = running_totals(counts, [value], {"_cum": "_cnt"}, group_cols,
                            group_totals=True, num_partitions=num_partitions)
    n = F.col("_cum_total")
    first_rank = F.col("_cum") - F.col("_cnt")          # 0-based rank of first copy
    aggs = []
    post = []
    for name, q in quantiles.items():
        h = (n - 1).cast("double") * F.lit(float(q))
        lo = F.floor(h)
        hi = F.ceil(h)
        hit_lo = (first_rank <= lo) & (lo < F.col("_cum"))
        hit_hi = (first_rank <= hi) & (hi < F.col("_cum"))
        aggs += [F.max(F.when(hit_lo, F.col(value))).alias(f"_lo_{name}"),
                 F.max(F.when(hit_hi, F.col(value))).alias(f"_hi_{name}"),
                 F.max(h - lo).alias(f"_fr_{name}")]
        post.append((F.col(f"_lo_{name}")
                     + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_fr_{name}")
                     ).alias(name))
    grouped = ranked.groupBy(*group_cols).agg(*aggs)
    return grouped.select(*group_cols, *post)


def positional_split(df: DataFrame, order: Sequence[Column | str],
                     train_fraction: float = 0.80, num_partitions: int | None = None
                     ) -> DataFrame:
    """Position in ``order``; train = pos < int(n * train_fraction)."""
    pos = running_totals(df, order, {"pos": F.lit(1).cast("long")}, group_totals=True,
                         num_partitions=num_partitions)
    n = F.col("pos_total")
    cut = F.floor(n.cast("double") * F.lit(float(train_fraction)))
    return (pos.withColumn("pos", F.col("pos") - 1)
            .withColumn("is_train", (F.col("pos") < cut).cast("int"))
            .withColumnRenamed("pos_total", "n_rows"))


def purged_kfold(df_with_pos: DataFrame, n_rows: int, n_splits: int = 5,
                 purge: int = 50, embargo: int = 10, pos_col: str = "pos") -> DataFrame:
    """Purged + embargoed K-fold on a position column.

    fold_size = n // k; fold i validates [i*fold_size, end) with the last fold
    running to n; a row trains fold i if pos < start - purge or
    pos >= end + embargo.  Emits (row..., fold, role) with role 'train'/'val';
    folds without training rows are dropped.  The fold table has k rows and is
    broadcast; each input row fans out to at most k output rows.
    """
    spark = df_with_pos.sparkSession
    fold_size = n_rows // n_splits
    folds = []
    for i in range(n_splits):
        start = i * fold_size
        end = start + fold_size if i < n_splits - 1 else n_rows
        has_train = (start - purge > 0) or (end + embargo < n_rows)
        if has_train:
            folds.append((i, start, end))
    fold_structs = F.array(*[
        F.struct(F.lit(i).alias("fold"), F.lit(s).cast("long").alias("val_start"),
                 F.lit(e).cast("long").alias("val_end")) for i, s, e in folds])
    pos = F.col(pos_col)
    joined = (df_with_pos.withColumn("_fold", F.explode(fold_structs))
              .select("*", "_fold.fold", "_fold.val_start", "_fold.val_end").drop("_fold"))
    role = (F.when((pos >= F.col("val_start")) & (pos < F.col("val_end")), F.lit("val"))
            .when((pos < F.col("val_start") - purge) | (pos >= F.col("val_end") + embargo),
                  F.lit("train")))
    return (joined.withColumn("role", role).where(F.col("role").isNotNull())
            .drop("val_start", "val_end"))


# ------------------------------------------------------ exact rank selection ---
#: Histogram cells of one selection round, shared by the ranks that are still open.
HISTOGRAM_BINS = 4096


def _numeric(column: Column, dtype) -> Column:
    """A number that orders like ``column``: exact long where the type allows, else double."""
    t = dtype.simpleString()
    if t == "timestamp_ntz":
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", epoch, column)
    if t == "timestamp":
        return F.unix_micros(column)
    if t == "date":
        return F.unix_date(column).cast("long")
    if t in ("tinyint", "smallint", "int", "bigint", "boolean"):
        return column.cast("long")
    if t in ("float", "double") or t.startswith("decimal"):
        return column.cast("double")
    raise TypeError(f"rank selection orders numbers and times, not {t}")


def _same(a, b) -> bool:
    return a == b or (a is not None and b is not None and a != a and b != b)      # NaN is one value


class _Span:
    """The rows between two keys (inclusive): what is left of a rank's candidates.

    ``lo`` and ``hi``: per order column (value, number), the value being what ``key_expr`` gives.
    All columns before ``at`` agree; the next histogram is taken over column ``at``."""

    def __init__(self, order: Sequence[str], types: list, row):
        self.order, self.types = order, types
        self.lo, self.hi = ([(row[f"{end}_v{i}"], row[f"{end}_n{i}"]) for i in range(len(order))]
                            for end in ("lo", "hi"))
        differ = [i for i in range(len(order)) if not _same(self.lo[i][0], self.hi[i][0])]
        self.at = differ[0] if differ else None

    def key(self) -> tuple:
        return tuple(v for v, _ in self.lo)

    def holds(self) -> Column:
        column, dtype = F.col(self.order[self.at]), self.types[self.at]
        low = column >= typed_lit(self.lo[self.at][0], dtype)
        inside = (low | column.isNull()) if self.hi[self.at][0] is None else (
            low & (column <= typed_lit(self.hi[self.at][0], dtype)))
        for i in range(self.at):
            inside = F.col(self.order[i]).eqNullSafe(typed_lit(self.lo[i][0], self.types[i])) & inside
        return inside

    def cell(self, bins: int) -> Column:
        """A cell number that never falls along the order; the two ends get different cells."""
        column, dtype = F.col(self.order[self.at]), self.types[self.at]
        (low_value, low), (high_value, high) = self.lo[self.at], self.hi[self.at]
        if high is None:
            return column.isNull().cast("int")
        x, a, b = _numeric(column, dtype), float(low), float(high)
        if a == float("-inf"):
            return (column > typed_lit(low_value, dtype)).cast("int")
        if not b < float("inf"):
            return (column >= typed_lit(high_value, dtype)).cast("int")
        if b - a == float("inf"):
            return (x >= F.lit(a / 2 + b / 2)).cast("int")
        if b > a:
            share = (x.cast("double") - F.lit(a)) / F.lit(b - a)
            return F.least(F.floor(share * F.lit(float(bins))), F.lit(bins - 1)).cast("int")
        # longs that are one double: a short range of exact differences
        return F.floor((x - F.lit(int(low))) * F.lit(bins) / F.lit(int(high) - int(low) + 1)).cast("int")


def keys_at_ranks(df: DataFrame, order: Sequence[str], ranks, bins: int = HISTOGRAM_BINS
                  ) -> tuple[int, dict[int, tuple]]:
    """(number of rows, exact key tuple at each of the 0-based ``ranks`` of ``order``).

    ``ranks``: numbers, or a function from the number of rows to them; ranks outside are left out.
    Order columns are numbers or times; NULL comes last.

    Selection by histograms: every round cuts the rows that a rank can still be among into cells of
    equal width in the first column whose values still differ, and takes count, smallest and largest
    key per cell -- at most ``bins`` rows for all ranks together.  The rank falls into one cell, which
    is the next round's candidates, until its smallest and largest key are one.  A round reads the
    order columns only, with the candidates' range as a filter, and shuffles cells, not rows.  The
    range of a round's column shrinks by the number of cells, whatever the number of rows: 30 days
    in microseconds are one value after four rounds.
    """
    order = list(order)
    types = [df.schema[c].dataType for c in order]
    rows = df.select(*order)
    key = F.struct(*[part for i, c in enumerate(order)
                     for part in (F.col(c).isNull().alias(f"m{i}"), F.col(c).alias(f"k{i}"))])

    def cells(frame: DataFrame, *by: str) -> list:
        found = frame.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))
        ends = [(end, i, F.col(f"{end}.k{i}")) for end in ("lo", "hi") for i in range(len(order))]
        return found.select(*by, "n", *[key_expr(f"{end}.k{i}", types[i]).alias(f"{end}_v{i}") for end, i, _ in ends],
                            *[_numeric(c, types[i]).alias(f"{end}_n{i}") for end, i, c in ends]).collect()

    whole = cells(rows)[0]
    n = whole["n"]
    wanted = sorted({int(r) for r in (ranks(n) if callable(ranks) else ranks) if 0 <= r < n})
    start = _Span(order, types, whole)
    left = {r: (0, start) for r in wanted}      # rank -> (rows before its candidates, candidates)
    out: dict[int, tuple] = {}
    while True:
        out.update({r: span.key() for r, (_, span) in left.items() if span.at is None})
        left = {r: v for r, v in left.items() if r not in out}
        if not left:
            return n, out
        spans = list({id(span): span for _, span in left.values()}.values())     # ranks may share one
        number = {id(span): i for i, span in enumerate(spans)}
        share = max(2, bins // len(spans))
        place = None
        for i, span in enumerate(spans):
            here = F.struct(F.lit(i).alias("span"), span.cell(share).alias("cell"))
            place = F.when(span.holds(), here) if place is None else place.when(span.holds(), here)
        some = spans[0].holds()
        for span in spans[1:]:
            some = some | span.holds()
        found = cells(rows.where(some).select("*", place.alias("place"))
                      .select(*order, "place.span", "place.cell"), "span", "cell")
        by_span: dict[int, list] = {}
        for row in sorted(found, key=lambda r: (r["span"], r["cell"])):
            by_span.setdefault(row["span"], []).append((row, _Span(order, types, row)))
        for r, (below, span) in left.items():
            for row, inner in by_span[number[id(span)]]:
                if r < below + row["n"]:
                    left[r] = (below, inner)
                    break
                below += row["n"]


def exact_quantile(df: DataFrame, value: str, q: float) -> float | None:
    """Quantile of one column with linear interpolation (as ``exact_quantiles``), by rank selection:
    the rows are neither sorted nor written.  NULL is ignored; None without values."""
    some = df.where(F.col(value).isNotNull())
    n, keys = keys_at_ranks(some, [value], lambda n: {int((n - 1) * q), min(int((n - 1) * q) + 1, n - 1)})
    if not n:
        return None
    h = (n - 1) * q
    low = float(keys[int(h)][0])
    return low + (float(keys[min(int(h) + 1, n - 1)][0]) - low) * (h - int(h))


def key_less_than(df: DataFrame, order: Sequence[str], key: tuple | None) -> Column:
    """(order columns) < key, lexicographically with NULL last; key None means +infinity.

    Never NULL: every row is on one side."""
    if key is None:
        return F.lit(True)
    types = [df.schema[c].dataType for c in order]
    lits = [typed_lit(v, t) for v, t in zip(key, types)]
    expr = None
    for i in reversed(range(len(order))):
        c = F.col(order[i])
        less = c.isNotNull() if key[i] is None else F.coalesce(c < lits[i], F.lit(False))
        expr = less if expr is None else less | (c.eqNullSafe(lits[i]) & expr)
    return expr


def positional_split_by_cut(df: DataFrame, order: Sequence[str], train_fraction: float = 0.80,
                            bins: int = HISTOGRAM_BINS) -> DataFrame:
    """W5 without positions: train = the first int(n * fraction) rows in ``order``.

    The row count and the cut key come from one selection (``keys_at_ranks``);
    the split itself is a projection.  Adds ``is_train`` and ``n_rows``.
    """
    n, keys = keys_at_ranks(df, order, lambda n: [int(n * train_fraction)], bins)
    key = keys.get(int(n * train_fraction))
    return df.withColumn("is_train", key_less_than(df, order, key).cast("int")).withColumn(
        "n_rows", F.lit(n).cast("long"))


def purged_kfold_by_keys(df: DataFrame, order: Sequence[str], n_rows: int | None = None, n_splits: int = 5,
                         purge: int = 50, embargo: int = 10, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """W6 on key ranges: the same folds as ``purged_kfold`` without positions.

    Fold i validates ranks [start, end); a row trains fold i if its rank is
    < start - purge or >= end + embargo.  Every rank bound becomes the key at
    that rank (``keys_at_ranks``), so roles are key comparisons.  ``n_rows`` may
    be left out; it is then counted with the first selection round.
    """
    folds = fold_roles(df, order, n_splits, purge, embargo, bins)
    out = df.withColumn("_f", F.explode(F.array(*[F.struct(F.lit(i).alias("fold"), role.alias("role"))
                                                  for i, role in folds]))).select("*", "_f.fold", "_f.role")
    return out.drop("_f").where(F.col("role").isNotNull())


def fold_roles(df: DataFrame, order: Sequence[str], n_splits: int = 5, purge: int = 50, embargo: int = 10,
               bins: int = HISTOGRAM_BINS) -> list[tuple[int, Column]]:
    """W6 as expressions: (fold, role column: 'val', 'train' or NULL); folds without training rows are left out."""
    def bounds(n: int) -> list[tuple[int, int, int]]:
        size = n // n_splits
        ends = [(i, i * size, (i + 1) * size if i < n_splits - 1 else n) for i in range(n_splits)]
        return [(i, s, e) for i, s, e in ends if s - purge > 0 or e + embargo < n]

    n, keys = keys_at_ranks(df, order, lambda n: [
        r for _, s, e in bounds(n) for r in (s, e, s - purge, e + embargo)], bins)

    def below(rank: int) -> Column:  # rank(row) < rank
        if rank <= 0:
            return F.lit(False)
        return F.lit(True) if rank >= n else key_less_than(df, order, keys[rank])

    return [(i, F.when(~below(s) & below(e), F.lit("val"))
             .when(below(s - purge) | ~below(e + embargo), F.lit("train"))) for i, s, e in bounds(n)]

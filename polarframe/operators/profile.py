"""Exploration: shape, summaries, missing ratios, histograms, hexagonal maps, series, quantiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from polarframe.functions.lattice import Lattice
from polarframe.functions.missing import is_missing, numeric_columns, present
from polarframe.functions.projection import cell_of
from polarframe.operators.distribute import settle


def _melt(wide: DataFrame, rows: list[list[Column]], names: list[str], keep: list[str] | None = None) -> DataFrame:
    """Turn the columns of an aggregate into one row per list of columns."""
    structs = [F.struct(*[c.alias(n) for c, n in zip(row, names)]) for row in rows]
    return wide.select(*(keep or []), F.inline(F.array(*structs)))


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(c, v): every present value with the position of its column in ``columns``.

    One expression per column would make generated code too large to be compiled for wide tables;
    grouping the long form by ``c`` costs no shuffle worth naming, as there are few columns.
    """
    values = F.array(*[present(df, c).cast("double") for c in columns])
    return df.select(F.posexplode(values).alias("c", "v")).filter(F.col("v").isNotNull())


def _literals(values: list, kind: str) -> Column:
    """A constant array to be indexed by column position."""
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def _positions(df: DataFrame, columns: list[str]) -> DataFrame:
    """(c, column): one row per column, made by one task."""
    return df.sparkSession.range(0, 1, 1, 1).select(F.posexplode(_literals(columns, "string")).alias("c", "column"))


def shape(df: DataFrame) -> DataFrame:
    """Rows, columns, values and the list of columns, in one counting job."""
    width = len(df.columns)
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(width).cast("bigint").alias("n_columns"),
        (F.col("n_rows") * width).alias("n_values"),
        F.lit(",".join(df.columns)).alias("column_names"),
    )


_WHOLE = (ByteType, ShortType, IntegerType, LongType)


def summarize(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, standard deviation, minimum and maximum per column, in one pass.

    ``min_value`` and ``max_value`` are doubles for all columns; whole-number columns also have their extremes unchanged, beyond 2^53 too, as ``min_whole``
    and ``max_whole`` (NULL for other columns).
    """
    columns = columns or numeric_columns(df)
    whole = lambda c: F.col(c) if isinstance(df.schema[c].dataType, _WHOLE) else F.lit(None)
    values = F.array(*[F.struct(present(df, c).cast("double").alias("v"), whole(c).cast("bigint").alias("w")) for c in columns])
    long = df.select(F.posexplode(values).alias("c", "s")).select("c", "s.v", "s.w").filter(F.col("v").isNotNull())
    measured = long.groupBy("c").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("stddev"),
        F.min("v").alias("min_value"), F.max("v").alias("max_value"), F.min("w").alias("min_whole"), F.max("w").alias("max_whole"),
    )
    # One row per column on either side; columns without values stay.
    return _positions(df, columns).join(F.broadcast(measured), "c", "left").select(
        "column", F.coalesce("n", F.lit(0)).alias("n"), "mean", "stddev", "min_value", "max_value", "min_whole", "max_whole"
    )


def missing_by(df: DataFrame, groups: list[str]) -> DataFrame:
    """Share of missing values of every other column, overall or inside groups."""
    columns = [c for c in df.columns if c not in groups]
    total = F.count(F.lit(1))
    shares = [F.try_divide(F.count_if(is_missing(df, c)), total).alias(c) for c in columns]
    wide = df.groupBy(*groups).agg(*shares)
    return _melt(wide, [[F.lit(c), F.col(c)] for c in columns], ["column", "ratio"], keep=groups)


def missing_ratios(df: DataFrame) -> DataFrame:
    """Share of missing values of every column; row count and null counts share one pass."""
    return missing_by(df, [])


def missing_report(df: DataFrame, threshold: float = 0.01) -> DataFrame:
    return missing_ratios(df).filter(F.col("ratio") > threshold)


def histogram(df: DataFrame, name: str, bins: int = 100) -> DataFrame:
    """Equal-width histogram with empty bins; the top edge belongs to the last bin.

    The limits are taken over present values, so one NaN does not spoil them.
    """
    values = df.select(present(df, name).cast("double").alias("v")).filter(F.col("v").isNotNull())
    low, high = (F.lit(e).cast("double") for e in values.agg(F.min("v"), F.max("v")).first())
    step = (high - low) / F.lit(bins)
    offset = F.coalesce(F.try_divide(F.col("v") - low, step), F.lit(0.0))
    counts = values.groupBy(F.least(F.floor(offset), F.lit(bins - 1)).cast("bigint").alias("bin_id")).count()
    spine = df.sparkSession.range(bins).select(F.col("id").alias("bin_id"))
    # At most ``bins`` rows on either side.
    return spine.join(F.broadcast(counts), "bin_id", "left").select(
        "bin_id",
        (low + F.col("bin_id") * step).alias("lo"),
        (low + (F.col("bin_id") + 1) * step).alias("hi"),
        F.coalesce("count", F.lit(0)).alias("n"),
    )


def _points(df: DataFrame, x: str, y: str, z: str, more: list[Column] = ()) -> DataFrame:
    """Rows with all three numbers; ``more`` columns come along, whatever they hold."""
    cols = [present(df, c).cast("double").alias(a) for c, a in ((x, "px"), (y, "py"), (z, "pz"))]
    return df.select(*cols, *more).na.drop(subset=["px", "py", "pz"])


def _lattice(points: DataFrame, gridsize: int) -> Lattice:
    edges = points.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py")).first()
    return Lattice(*[0.0 if e is None else e for e in edges], gridsize)


def hexbin_mean(
    df: DataFrame, x: str, y: str, z: str, gridsize: int = 200, clip: float | None = None
) -> DataFrame:
    """Mean of ``z`` per hexagon over all rows; ``clip`` limits the displayed mean, not the data."""
    points = _points(df, x, y, z)
    lattice = _lattice(points, gridsize)
    means = lattice.assign(points).groupBy("hx", "hy").agg(F.count(F.lit(1)).alias("n"), F.avg("pz").alias("mean"))
    shown = F.col("mean") if clip is None else F.greatest(F.least("mean", F.lit(clip)), F.lit(-clip))
    cx, cy = lattice.centre()
    return means.select("hx", "hy", cx.alias("cx"), cy.alias("cy"), "n", shown.alias("mean"))


def season_compare(
    df: DataFrame,
    first: int,
    last: int,
    months: tuple[int, ...] = (6, 7, 8),
    x: str = "x",
    y: str = "y",
    z: str = "delta_h",
    gridsize: int = 150,
) -> DataFrame:
    """Two seasons on one lattice: means side by side and their difference, in one aggregation."""
    early_months, late_months = ([year * 12 + m for m in months] for year in (first, last))
    rows = df.filter(F.col("month_idx").isin(*early_months, *late_months))
    points = _points(rows, x, y, z, [F.col("month_idx").isin(*early_months).alias("early")])
    cells = _lattice(points, gridsize).assign(points)
    early, late = F.when(F.col("early"), F.col("pz")), F.when(~F.col("early"), F.col("pz"))
    means = cells.groupBy("hx", "hy").agg(
        F.count(early).alias("n_first"),
        F.count(late).alias("n_last"),
        F.avg(early).alias("mean_first"),
        F.avg(late).alias("mean_last"),
    )
    return means.withColumn("difference", F.col("mean_last") - F.col("mean_first"))


def monthly_mean(df: DataFrame, name: str) -> DataFrame:
    value = present(df, name)
    return df.groupBy("month_idx").agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair over rows where both are present.

    Each Arrow batch contributes its pairwise sums by a few matrix products, each task emits one row
    per pair, and Spark adds them up: one scan for any number of columns. Values are shifted by the
    column means first, so that the sums of squares do not cancel.
    """
    width = len(columns)
    values = df.select(*[present(df, c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    means = values.agg(*[F.avg(c).alias(c) for c in values.columns]).first()
    shift = np.array([0.0 if m is None else m for m in means])
    left, right = np.triu_indices(width)

    def pair_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, width, width))
        for batch in batches:
            x = batch.to_numpy(dtype=float) - shift
            seen = ~np.isnan(x)
            x, m = np.where(seen, x, 0.0), seen.astype(float)
            sums, squares = x.T @ m, (x * x).T @ m
            total += np.stack([m.T @ m, sums, sums.T, squares, squares.T, x.T @ x])
        picked = total[:, left, right]
        yield pd.DataFrame({"a": left, "b": right} | dict(zip(("n", "sx", "sy", "sxx", "syy", "sxy"), picked)))

    schema = "a int, b int, n double, sx double, sy double, sxx double, syy double, sxy double"
    sums = values.mapInPandas(pair_sums, schema).groupBy("a", "b").agg(
        *[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]
    )
    spread = (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")) * (F.col("n") * F.col("syy") - F.col("sy") * F.col("sy"))
    r = F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.sqrt(F.greatest(spread, F.lit(0.0))))
    upper = sums.select("a", "b", F.when(F.col("a") == F.col("b"), F.when(F.col("n") > 0, F.lit(1.0))).otherwise(r).alias("r"))
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    sides = upper.select("r", F.explode(F.array_distinct(both)).alias("p"))
    named = _literals(columns, "string")
    return sides.select(F.get(named, F.col("p.a")).alias("column_a"), F.get(named, F.col("p.b")).alias("column_b"), "r")


#: Bits that one pass of ``quantiles`` decides.
DIGIT = 16
BUFFERED = 1 << 20
_TARGET = {"column": "string", "share": "double", "n": "bigint", "low": "double", "high": "double"}


def _ordered_bits(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers in the order of the values: whole numbers as they are, doubles by their bit patterns."""
    top = np.uint64(1 << 63)
    if values.dtype.kind == "i":
        return values.astype(np.int64).view(np.uint64) ^ top
    bits = (values.astype(np.float64) + 0.0).view(np.uint64)  # one zero
    return np.where(bits & top, ~bits, bits | top)


def _from_bits(bits: int, whole: bool) -> float | int:
    if whole:
        return bits - (1 << 63)
    raw = bits ^ (1 << 63) if bits >> 63 else ~bits & ((1 << 64) - 1)
    return float(np.array([raw], np.uint64).view(np.float64)[0])


def _histograms(values: DataFrame, slots: list[tuple[int, int]], shift: int) -> DataFrame:
    """(slot, digit, n): how many values of a column start with the slot's bits, by the next ``DIGIT`` bits below ``shift + DIGIT``.

    A task keeps a counter per digit that occurs and slot, at most 2^16 of them, and sends them once, at its end. Digits wait in a buffer of
    ``BUFFERED`` per slot, because counting a few of them costs as much as 2^16.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        waiting: dict[int, list[np.ndarray]] = {}

        def count(i: int) -> None:
            parts = waiting.pop(i)
            counts[i] = counts.get(i, 0) + np.bincount(np.concatenate(parts), minlength=1 << DIGIT)

        for batch in batches:
            for c in range(batch.num_columns):
                own = [(i, prefix) for i, (column, prefix) in enumerate(slots) if column == c]
                if not own:
                    continue
                bits = _ordered_bits(batch.column(c).drop_null().to_numpy(zero_copy_only=False))
                for i, prefix in own:
                    inside = bits if shift + DIGIT == 64 else bits[bits >> np.uint64(shift + DIGIT) == np.uint64(prefix)]
                    if len(inside):
                        digits = (inside >> np.uint64(shift)) & np.uint64((1 << DIGIT) - 1)
                        waiting.setdefault(i, []).append(digits.astype(np.uint16))
                        if sum(map(len, waiting[i])) >= BUFFERED:
                            count(i)
        for i in list(waiting):
            count(i)
        for i, counted in counts.items():
            digit = np.flatnonzero(counted)
            yield pa.record_batch([pa.array(np.full(len(digit), i, np.int32)), pa.array(digit.astype(np.int32)), pa.array(counted[digit].astype(np.int64))], ["slot", "digit", "n"])

    return values.mapInArrow(run, "slot int, digit int, n bigint").groupBy("slot", "digit").agg(F.sum("n").alias("n"))


def _select(df: DataFrame, columns: list[str], shares: list[float]) -> list[tuple]:
    """(column, share, n, low, high) of every column and share; without values low and high are None."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    whole = [isinstance(kinds[c], _WHOLE) for c in columns]
    values = df.select(*[present(df, c).cast("bigint" if w else "double").alias(f"v{i}") for i, (c, w) in enumerate(zip(columns, whole))])
    # What is looked for, per column, share and side: the bits known so far and the rank among the values that start with them. In the
    # first pass the rank follows from the column's number of values, which the same job counts.
    totals, wanted, step = [0] * len(columns), {}, {}
    for shift in range(64 - DIGIT, -1, -DIGIT):
        first = shift == 64 - DIGIT
        slots = [(i, 0) for i in range(len(columns))] if first else sorted({(c, prefix) for c, prefix, _ in wanted.values()})
        names = {s: k for k, s in enumerate(slots)}
        if first:
            asked = [(i, float(share), side, None) for i in range(len(columns)) for share in set(shares) for side in (0, 1)]
        else:
            asked = [(slot, None, None, place) for slot, place in sorted({(names[c, prefix], place) for c, prefix, place in wanted.values()})]
        # At most two rows per column and share.
        targets = df.sparkSession.createDataFrame(asked, "slot int, share double, side int, place bigint")
        line = Window.partitionBy("slot").orderBy("digit")  # at most 2^16 rows
        counted = _histograms(values, slots, shift).withColumns({
            "upto": F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, 0)),
            "total": F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        })
        at = (F.col("total") - 1) * F.col("share")
        place = F.coalesce("place", F.when(F.col("side") == 0, F.floor(at)).otherwise(F.ceil(at)))
        reached = counted.join(F.broadcast(targets), "slot").withColumn("place", place)
        reached = reached.where((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("n") <= F.col("place"))).collect()
        if first:
            for r in reached:
                totals[r.slot] = r.total
                wanted |= {(r.slot, j, r.side): (r.slot, r.digit, r.place - (r.upto - r.n)) for j, share in enumerate(shares) if share == r.share}
            continue
        step = {(r.slot, r.place): (r.digit, r.place - (r.upto - r.n)) for r in reached}
        wanted = {k: (c, (prefix << DIGIT) | step[names[c, prefix], place][0], step[names[c, prefix], place][1]) for k, (c, prefix, place) in wanted.items()}
        if not wanted:
            break
    found = lambda i, j, side: float(_from_bits(wanted[i, j, side][1], whole[i])) if totals[i] else None
    return [(name, share, totals[i], found(i, j, 0), found(i, j, 1)) for i, name in enumerate(columns) for j, share in enumerate(shares)]


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """Exact quantiles without sorting or shuffling the table: (column, share, n, low, high, value).

    ``low`` and ``high`` are the order statistics around ``(n - 1) * share`` and ``value`` is
    interpolated between them. Selection by radix histograms: values become 64-bit patterns in their order (whole numbers without a
    detour through doubles), and four passes over the needed columns count, for all shares at once, how the values that share the bits
    decided so far spread over the next 16. Only counters leave a task; rows are never multiplied, sampled or moved.
    """
    rows = [F.struct(*[F.lit(v).cast(t).alias(a) for v, (a, t) in zip(row, _TARGET.items())]) for row in _select(df, columns, shares)]
    # One row per column and share.
    out = df.sparkSession.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))
    place = (F.col("n") - 1) * F.col("share")
    between = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * (place - F.floor(place)))
    return out.withColumn("value", between)


def box_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact quartiles, whiskers at 1.5 interquartile ranges, and the count of outliers."""
    marks: dict[str, dict[float, float]] = {c: {} for c in columns}
    for row in quantiles(df, columns, [0.25, 0.5, 0.75]).collect():  # three rows per column
        marks[row["column"]][row["share"]] = row["value"]
    at = lambda share: F.get(_literals([marks[c][share] for c in columns], "double"), F.col("c"))
    reach = F.lit(1.5) * (at(0.75) - at(0.25))
    inside = F.col("v").between(at(0.25) - reach, at(0.75) + reach)
    kept = F.when(F.col("inside"), F.col("v"))
    measured = _long(df, columns).select("c", "v", inside.alias("inside")).groupBy("c").agg(
        F.count("v").alias("n"), F.min(kept).alias("whisker_low"), F.max(kept).alias("whisker_high"),
        F.count_if(~F.col("inside")).alias("n_outliers"),
    )
    # One row per column on either side; columns without values stay.
    return _positions(df, columns).join(F.broadcast(measured), "c", "left").select(
        "column", F.coalesce("n", F.lit(0)).alias("n"), at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"),
        "whisker_low", "whisker_high", F.coalesce("n_outliers", F.lit(0)).alias("n_outliers"),
    )


def coverage(df: DataFrame, probe: str, by: list[str]) -> DataFrame:
    """Share of rows with a valid probe, per class."""
    valid = ~is_missing(df, probe)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(valid).alias("n_valid"),
        (F.count_if(valid) / F.count(F.lit(1))).alias("coverage"),
    )


def spatial_compare(df: DataFrame, a: str, b: str, cell: float, x: str = "x", y: str = "y") -> DataFrame:
    """Means of two fields on the same coarse cells."""
    return df.groupBy(cell_of(F.col(x), cell).alias("cx"), cell_of(F.col(y), cell).alias("cy")).agg(
        F.avg(present(df, a)).alias("mean_a"), F.avg(present(df, b)).alias("mean_b"), F.count(F.lit(1)).alias("n")
    )


def series_outliers(df: DataFrame, name: str, k: float = 3.5) -> DataFrame:
    """Months whose mean is more than ``k`` robust standard deviations from the median.

    The series has one row per month, so its median is taken on a handful of rows.
    """
    series = settle(monthly_mean(df, name).filter(F.col("mean").isNotNull()))
    median = series.agg(F.median("mean")).scalar()
    away = series.select("*", (F.col("mean") - median).alias("away"))
    spread = away.agg(F.median(F.abs("away"))).scalar()
    score = F.try_divide(F.col("away"), spread * F.lit(1.4826))
    return away.select("month_idx", "mean", "n", score.alias("robust_z")).withColumn(
        "is_outlier", F.coalesce(F.abs("robust_z") > k, F.lit(False))
    )

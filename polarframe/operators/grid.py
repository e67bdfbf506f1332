"""Grid algebra on integer cells: refinement, interpolation, gradients, distances, neighbourhoods.

All joins are equi-joins on cell keys; none grows with the number of rows that share a cell,
because cells are made distinct before neighbours are combined.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polarframe.functions.missing import present
from polarframe.functions.projection import cell_of, snap
from polarframe.operators.distribute import lookup_join, settle

CELL = ["cell_x", "cell_y"]


def master_grid(spark: SparkSession, bounds: tuple[float, float, float, float], cell: float = 500.0) -> DataFrame:
    """All cells of (xmin, ymin, xmax, ymax) with their centres, generated on the executors."""
    xmin, ymin, xmax, ymax = bounds
    x0, y0 = math.floor(xmin / cell), math.floor(ymin / cell)
    nx, ny = math.ceil(xmax / cell) - x0, math.ceil(ymax / cell) - y0
    cells = spark.range(nx * ny).select(
        (F.col("id") % nx + x0).alias("cell_x"), (F.floor(F.col("id") / nx) + y0).alias("cell_y")
    )
    centre = lambda c: (F.col(c) + F.lit(0.5)) * F.lit(float(cell))
    return cells.withColumns({"x": centre("cell_x"), "y": centre("cell_y")})


def refine(df: DataFrame, factor: int = 2, conserve: list[str] = (), copy: list[str] | None = None) -> DataFrame:
    """Split every cell into ``factor`` x ``factor`` children.

    Conserved quantities are shared equally, so their total does not change; the others are copied.
    """
    children = factor * factor
    copied = [c for c in df.columns if c not in (*CELL, *conserve)] if copy is None else list(copy)
    split = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(children - 1))).alias("_k"))
    return split.select(
        (F.col("cell_x") * factor + F.col("_k") % factor).cast("bigint").alias("cell_x"),
        (F.col("cell_y") * factor + F.floor(F.col("_k") / factor)).cast("bigint").alias("cell_y"),
        *[(F.col(c) / F.lit(children)).alias(c) for c in conserve],
        *copied,
    )


def bilinear(
    points: DataFrame, grid: DataFrame, value: str, cell: float, x: str = "x", y: str = "y", out: str | None = None
) -> DataFrame:
    """Interpolate a coarse field between its four surrounding cell centres.

    The four corner values are brought into one row per square first (a small groupBy on the
    coarse grid), so the points are joined once and never multiplied. A missing corner gives NULL.
    """
    shifts = [(0, 0), (1, 0), (0, 1), (1, 1)]
    corner = F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), (F.col("cell_x") - i % 2).alias("_gx"), (F.col("cell_y") - i // 2).alias("_gy"))
        for i in range(4)
    ]))
    at = lambda i: F.max(F.when(F.col("s.i") == i, F.col("v"))).alias(f"_v{i}")
    squares = (
        grid.select(*CELL, present(grid, value).alias("v"))
        .select("v", *CELL, corner.alias("s"))
        .groupBy("s._gx", "s._gy").agg(*[at(i) for i in range(len(shifts))])
    )
    u, v = F.col(x) / F.lit(cell) - F.lit(0.5), F.col(y) / F.lit(cell) - F.lit(0.5)
    placed = points.withColumns({"_gx": F.floor(u).cast("bigint"), "_gy": F.floor(v).cast("bigint")})
    joined = lookup_join(placed, settle(squares), ["_gx", "_gy"])
    wx, wy = u - F.col("_gx"), v - F.col("_gy")
    low = F.col("_v0") * (1 - wx) + F.col("_v1") * wx
    high = F.col("_v2") * (1 - wx) + F.col("_v3") * wx
    return joined.withColumn(out or value, low * (1 - wy) + high * wy).drop("_gx", "_gy", "_v0", "_v1", "_v2", "_v3")


def lookup_coarse(points: DataFrame, grid: DataFrame, cell: float, x: str = "x", y: str = "y") -> DataFrame:
    """Value of the coarse cell each point falls into: nearest coarse cell centre."""
    keyed = points.withColumns({"_gx": cell_of(F.col(x), cell), "_gy": cell_of(F.col(y), cell)})
    coarse = grid.withColumnsRenamed({"cell_x": "_gx", "cell_y": "_gy"})
    return lookup_join(keyed, coarse, ["_gx", "_gy"]).drop("_gx", "_gy")


def grid_points(df: DataFrame, value: str, cell: float = 500.0, x: str = "x", y: str = "y") -> DataFrame:
    """Mean and standard deviation of irregular points per (cell, month)."""
    snapped = snap(df, cell, x, y)
    v = present(snapped, value)
    return snapped.groupBy(*CELL, "month_idx").agg(
        F.avg(v).alias(f"mean_{value}"), F.stddev_samp(v).alias(f"std_{value}"), F.count(v).alias("n")
    )


def slope(df: DataFrame, name: str, cell: float = 500.0, by: list[str] = (), prefix: str | None = None) -> DataFrame:
    """Gradient components and magnitude: central differences, one-sided at edges.

    Two windows along the raster lines, one per axis, with range frames at the neighbouring cells: every row
    is shuffled once per axis and nothing is joined back. A window is a line of cells of one group of ``by``. Rows
    that share a cell count as one with the largest value. Along an axis without any neighbour the
    component is NULL, and so is the magnitude; rows without a cell have neither.
    """
    prefix = prefix or name
    placed = F.col("cell_x").isNotNull() & F.col("cell_y").isNotNull()
    value = F.when(placed, present(df, name).cast("double"))

    def along(across: str, axis: str) -> Column:
        line = Window.partitionBy(*by, across).orderBy(F.col(axis).cast("bigint"))
        at = lambda offset: F.max("_v").over(line.rangeBetween(offset, offset))
        return F.when(placed, _difference(at(-1), at(0), at(1), cell))

    out = df.withColumn("_v", value).withColumn(f"{prefix}_dx", along("cell_y", "cell_x")).withColumn(f"{prefix}_dy", along("cell_x", "cell_y"))
    return out.withColumn(f"{prefix}_slope", F.hypot(f"{prefix}_dx", f"{prefix}_dy")).drop("_v")


def _difference(low: Column, mid: Column, high: Column, cell: float) -> Column:
    return F.coalesce((high - low) / F.lit(2.0 * cell), (high - mid) / F.lit(float(cell)), (mid - low) / F.lit(float(cell)))


#: Rows of cells in a band of ``nearest_distance``, and the side of a tile of ``neighbourhood_fraction``.
BAND = 128
TILE = 256
_FAR = np.int64(1) << 40


def nearest_distance(
    points: DataFrame, targets: DataFrame, cell: float = 500.0, cap: float | None = None, out: str = "distance"
) -> DataFrame:
    """Exact distance from each point's cell centre to the nearest target cell centre, beyond ``cap`` NULL.

    A distance transform in two passes. Seen from a row of cells, a column offers its target nearest to that row, at a squared distance g; the
    nearest target of a cell is the lowest of the parabolas (x - column)^2 + g at its place, and where a parabola lies under all others is an interval. First
    pass: every column is cut into bands of ``BAND`` rows, and each band that has points is handed the column's targets inside it and the last one before
    and the first one behind it, so nothing else of the column matters to it. Second pass: every band by itself finds g of its rows
    and the lower envelope of the columns' parabolas, and reads off its points. One exchange by column, one by band;
    cells are distinct within a task before they are sent, so crowded cells cost nothing, and a band never holds more than its area.
    """
    cells = targets.select(*[F.col(c).cast("bigint") for c in CELL]).na.drop()
    asked = points.select(*[F.col(c).cast("bigint") for c in CELL]).na.drop()
    band = F.floor(F.col("cell_y") / BAND).cast("bigint")
    # Which bands have points: one row per BAND rows of cells, a few hundred for a continent at 500 m.
    bands = settle(asked.select(band.alias("band")).distinct())
    # One row per column and band: its targets, lowest and highest.
    held = cells.withColumn("band", band).groupBy("cell_x", "band").agg(F.collect_set("cell_y").alias("ys"))
    lines = Window.partitionBy("cell_x").orderBy("band")
    carried = held.select(
        "cell_x", "band", "ys", F.array_max("ys").alias("last"), F.lead("band").over(lines).alias("ahead"),
        F.lag(F.array_max("ys")).over(lines).alias("before"), F.lead(F.array_min("ys")).over(lines).alias("behind"),
        F.lag("band").over(lines).isNull().alias("starts"), F.array_min("ys").alias("first"),
    )
    offered = F.array_compact(F.array("before", "behind"))
    own = carried.select("cell_x", "band", F.array_union("ys", offered).alias("ys"))
    ends = F.array(
        # Bands between this one and the column's next, and those before its first.
        F.struct((F.col("band") + 1).alias("a"), F.coalesce(F.col("ahead"), F.lit(1 << 60)).alias("b"), F.array_compact(F.array("last", "behind")).alias("ys")),
        F.struct(F.when(F.col("starts"), F.lit(-(1 << 60))).alias("a"), F.col("band").alias("b"), F.array("first").alias("ys")),
    )
    gaps = carried.select("cell_x", F.inline(ends)).where("a is not null and a < b")
    # A gap is laid out over the bands with points inside it: whole columns of bands, at most one row per column and band.
    ladder = bands.agg(F.sort_array(F.collect_list("band")).alias("all"))
    inside = F.filter("all", lambda v: (v >= F.col("a")) & (v < F.col("b")))
    between = gaps.join(F.broadcast(ladder), F.lit(True)).select("cell_x", F.explode(inside).alias("band"), "ys")
    sent = own.join(F.broadcast(bands), "band", "left_semi").unionByName(between)
    sent = sent.select("band", "cell_x", F.explode("ys").alias("cell_y"), F.lit(False).alias("asks"))
    asking = asked.distinct().select(band.alias("band"), *CELL, F.lit(True).alias("asks"))
    found = sent.unionByName(asking).groupBy("band").applyInArrow(_band_distances, "cell_x bigint, cell_y bigint, d2 bigint")
    if cap is not None:
        found = found.where(F.col("d2") <= math.floor((cap / cell) ** 2))
    metres = F.sqrt(F.col("d2").cast("double")) * F.lit(float(cell))
    return lookup_join(points, settle(found.select(*CELL, metres.alias(out))), CELL)


def _band_distances(rows: pa.Table) -> pa.Table:
    """Squared distance of the asking cells of a band to the nearest of its other cells; nothing without any."""
    x, y, asks = (np.asarray(rows.column(c)) for c in (*CELL, "asks"))
    px, py, tx, ty = x[asks], y[asks], x[~asks], y[~asks]
    names = [*CELL, "d2"]
    if not len(px) or not len(tx):
        return pa.table([pa.array([], pa.int64())] * 3, names)
    lines, at = np.unique(py, return_inverse=True)
    columns = np.unique(tx)
    place = np.searchsorted(columns, tx)
    d2 = np.empty(len(px), np.int64)
    # Nearest target above and below, line by line: targets in order of their rows, taken in once each.
    up = np.argsort(ty, kind="stable")
    below, above = np.full(len(columns), -_FAR), np.full((len(lines), len(columns)), _FAR)
    ends = np.searchsorted(ty[up], lines, "right")
    starts = np.searchsorted(ty[up], lines, "left")
    nearest = np.full(len(columns), _FAR)
    for i in range(len(lines) - 1, -1, -1):
        taken = up[starts[i] : starts[i + 1] if i + 1 < len(lines) else len(up)][::-1]
        nearest[place[taken]] = ty[taken]
        above[i] = nearest
    order = np.argsort(at, kind="stable")
    cut = np.searchsorted(at[order], np.arange(len(lines) + 1))
    for i, line in enumerate(lines):
        taken = up[ends[i - 1] if i else 0 : ends[i]]
        below[place[taken]] = ty[taken]
        gap = np.minimum(line - below, above[i] - line)
        mine = order[cut[i] : cut[i + 1]]
        d2[mine] = _lowest(columns, gap * gap, px[mine])
    return pa.table([pa.array(px), pa.array(py), pa.array(d2)], names)


def _lowest(columns: np.ndarray, g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Smallest (x - column)^2 + g at every x of ``at``, by the lower envelope of the parabolas; ``columns`` ascend."""
    hull: list[int] = []
    borders: list[int] = []  # hull[k] is lowest from borders[k] on
    c, v = columns.tolist(), g.tolist()
    for j in range(len(c)):
        while hull:
            i = hull[-1]
            # The first whole x where j is lower than i, which lies to its left.
            border = (c[j] * c[j] + v[j] - c[i] * c[i] - v[i]) // (2 * (c[j] - c[i])) + 1
            if border > borders[-1]:
                break
            hull.pop(), borders.pop()
        borders.append(border if hull else -(1 << 62))
        hull.append(j)
    best = np.asarray(hull)[np.searchsorted(np.asarray(borders), at, "right") - 1]
    return (at - columns[best]) ** 2 + g[best]


def neighbourhood_fraction(
    df: DataFrame, flag: str, radius: float = 10_000.0, cell: float = 500.0, out: str = "fraction"
) -> DataFrame:
    """Share of flagged cells among the cells whose centres lie within ``radius``, itself included.

    The grid is cut into tiles of ``TILE`` cells a side. A cell goes to its own tile and to those whose halo of the radius it lies in: about
    1.3 rows per cell at 10 km. A tile is a dense array with sums along its rows, and a disc is a stack of row intervals, so every
    row of the disc costs two look-ups per cell for a whole tile at once. Counts are whole numbers, so exact. A radius wider
    than a tile widens the tile.
    """
    reach2 = math.floor((radius / cell) ** 2)
    reach = math.isqrt(reach2)
    side = max(TILE, 2 * reach)
    cells = df.filter(F.col("cell_x").isNotNull() & F.col("cell_y").isNotNull()).groupBy(*CELL).agg(
        F.max(F.coalesce(F.col(flag).cast("boolean"), F.lit(False))).alias("f")
    )
    tile = lambda c, shift: F.floor((F.col(c) + shift) / side).cast("bigint")
    tiles = [F.sequence(tile(c, -reach), tile(c, reach)) for c in CELL]
    sent = cells.withColumn("tx", F.explode(tiles[0])).withColumn("ty", F.explode(tiles[1]))

    def shares(key: tuple, rows: pa.Table) -> pa.Table:
        x0, y0 = (k.as_py() * side - reach for k in key)
        x, y = (np.asarray(rows.column(c)).astype(np.int64) - o for c, o in zip(CELL, (x0, y0)))
        own = (x >= reach) & (x < reach + side) & (y >= reach) & (y < reach + side)
        totals = []
        for weight in (np.ones(len(x), np.int32), np.asarray(rows.column("f")).astype(np.int32)):
            sums = np.zeros((side + 2 * reach, side + 2 * reach + 1), np.int32)
            sums[y, x + 1] = weight
            np.cumsum(sums, axis=1, out=sums)
            total = np.zeros(int(own.sum()), np.int64)
            for dy in range(-reach, reach + 1):
                half = math.isqrt(reach2 - dy * dy)
                total += sums[y[own] + dy, x[own] + half + 1] - sums[y[own] + dy, x[own] - half]
            totals.append(total)
        picked = [rows.column(c).filter(pa.array(own)) for c in CELL]
        return pa.table([*picked, pa.array(totals[1] / np.maximum(totals[0], 1))], [*CELL, out])

    kept = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    found = sent.groupBy("tx", "ty").applyInArrow(shares, f"cell_x {kept['cell_x']}, cell_y {kept['cell_y']}, `{out}` double")
    return lookup_join(df, settle(found), CELL)

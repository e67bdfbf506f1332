"""Hexagonal binning: two interleaved rectangular lattices (Carr, Littlefield, Nicholson 1987)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Lattice:
    """Extent of the data and the number of hexagons across it."""

    x0: float
    x1: float
    y0: float
    y1: float
    gridsize: int

    @property
    def rows(self) -> int:
        return max(int(self.gridsize / math.sqrt(3)), 1)

    @property
    def pitch(self) -> tuple[Column, Column]:
        """Width and height of a lattice step."""
        return (
            (F.lit(self.x1) - F.lit(self.x0)) / F.lit(self.gridsize),
            (F.lit(self.y1) - F.lit(self.y0)) / F.lit(self.rows),
        )

    def assign(self, points: DataFrame) -> DataFrame:
        """Add (hx, hy), the nearest lattice point; half-integers belong to the second lattice.

        The distance is scaled so that both lattices form regular hexagons; ties go to the second
        lattice, and an axis without extent has a single step.
        """
        wide, high = self.pitch
        u = F.coalesce(F.try_divide(F.col("px") - F.lit(self.x0), wide), F.lit(0.0))
        v = F.coalesce(F.try_divide(F.col("py") - F.lit(self.y0), high), F.lit(0.0))
        placed = points.withColumns({"u": u, "v": v})
        u, v = F.col("u"), F.col("v")
        corner = (F.rint(u), F.rint(v))
        middle = (F.floor(u) + F.lit(0.5), F.floor(v) + F.lit(0.5))
        apart = lambda p: (u - p[0]) * (u - p[0]) + 3 * (v - p[1]) * (v - p[1])
        nearer = placed.withColumn("on_corner", apart(corner) < apart(middle))
        pick = lambda i: F.when(F.col("on_corner"), corner[i]).otherwise(middle[i]).cast("double")
        return nearer.withColumns({"hx": pick(0), "hy": pick(1)}).drop("u", "v", "on_corner")

    def centre(self) -> tuple[Column, Column]:
        wide, high = self.pitch
        return F.lit(self.x0) + F.col("hx") * wide, F.lit(self.y0) + F.col("hy") * high

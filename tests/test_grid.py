"""Projection and grid algebra against closed forms and brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from polarframe.functions.projection import snap, to_geographic, to_polar, wrap_longitude
from polarframe.operators import distribute
from polarframe.operators import grid as grids


def _cells(spark, cells):
    return spark.createDataFrame([(int(x), int(y)) for x, y in cells], "cell_x long, cell_y long")


def test_known_projection_points(spark):
    df = spark.createDataFrame([(-60.0, 0.0), (-71.0, 0.0), (-71.0, 90.0), (-90.0, 0.0)], "lat double, lon double")
    got = to_polar(df).collect()
    assert got[0].y == pytest.approx(3_333_134.03, abs=0.01) and got[0].x == pytest.approx(0, abs=1e-6)
    assert got[1].y == pytest.approx(2_082_760.11, abs=0.01)
    assert got[2].x == pytest.approx(2_082_760.11, abs=0.01)
    assert got[3].x == pytest.approx(0, abs=1e-6) and got[3].y == pytest.approx(0, abs=1e-6)


def test_projection_round_trip(spark):
    rng = random.Random(1)
    made = [(rng.uniform(-89.9, -55), rng.uniform(-179.9, 179.9)) for _ in range(200)]
    df = to_polar(spark.createDataFrame(made, "lat0 double, lon0 double"), "lat0", "lon0")
    worst = to_geographic(df).agg(F.max(F.abs(F.col("lat") - F.col("lat0"))), F.max(F.abs(F.col("lon") - F.col("lon0")))).first()
    assert max(worst) < 1e-9


def test_wrap_longitude(spark):
    df = spark.createDataFrame([(0.0,), (180.0,), (359.75,), (-0.25,)], "lon double")
    assert [r.lon for r in wrap_longitude(df, "lon", "180").collect()] == [0.0, -180.0, -0.25, -0.25]
    assert [r.lon for r in wrap_longitude(df, "lon", "360").collect()] == [0.0, 180.0, 359.75, 359.75]


def test_master_grid(spark):
    cells = grids.master_grid(spark, (-1000.0, -500.0, 1000.0, 500.0), 500.0)
    assert cells.count() == 8 and cells.distinct().count() == 8
    assert cells.agg(F.min("x"), F.max("y")).first() == (-750.0, 250.0)
    assert snap(cells.select("x", "y")).select("cell_x", "cell_y").subtract(cells.select("cell_x", "cell_y")).count() == 0


def test_refine_conserves_the_total(spark, rows):
    df = spark.createDataFrame([(0, 0, 8.0, "a"), (-1, 2, 4.0, "b")], "cell_x long, cell_y long, area double, tag string")
    fine = grids.refine(df, 2, conserve=["area"])
    assert fine.count() == 8 and fine.agg(F.sum("area")).first()[0] == 12.0
    assert rows(fine.filter("tag = 'b'"), "cell_x", "cell_y") == [(-2, 4), (-2, 5), (-1, 4), (-1, 5)]


def test_bilinear_reproduces_a_plane(spark):
    plane = spark.range(25).select((F.col("id") % 5).alias("cell_x"), F.floor(F.col("id") / 5).alias("cell_y"))
    centre = lambda c: (F.col(c) + 0.5) * 10.0
    plane = plane.withColumn("z", 2 * centre("cell_x") + 3 * centre("cell_y"))
    points = spark.createDataFrame([(12.5, 33.0), (44.9, 5.0), (1.0, 1.0), (49.0, 20.0)], "x double, y double")
    got = {(r.x, r.y): r.z for r in grids.bilinear(points, plane, "z", 10.0).collect()}
    assert got[(12.5, 33.0)] == pytest.approx(2 * 12.5 + 3 * 33.0)
    assert got[(44.9, 5.0)] == pytest.approx(2 * 44.9 + 15.0)
    assert got[(1.0, 1.0)] is None and got[(49.0, 20.0)] is None


def test_slope_of_a_plane_and_of_single_cells(spark):
    plane = spark.range(25).select((F.col("id") % 5).alias("cell_x"), F.floor(F.col("id") / 5).alias("cell_y"))
    plane = plane.withColumn("z", (2 * F.col("cell_x") + 3 * F.col("cell_y")) * 500.0)
    out = grids.slope(plane, "z").collect()
    assert len(out) == 25
    assert all(r.z_dx == pytest.approx(2) and r.z_dy == pytest.approx(3) and r.z_slope == pytest.approx(math.sqrt(13)) for r in out)
    alone = grids.slope(spark.createDataFrame([(0, 0, 1.0), (5, 5, 2.0), (6, 5, 3.0)], "cell_x long, cell_y long, z double"), "z")
    got = {r.cell_x: r for r in alone.collect()}
    assert got[0].z_slope is None and got[5].z_dx == pytest.approx(1 / 500) and got[5].z_slope is None


def _brute(points, targets):
    return {p: min((math.dist(p, t) for t in targets), default=None) for p in points}


@pytest.mark.parametrize("seed, n_targets, bound", [(0, 1, None), (1, 40, None), (2, 400, None), (4, 60, 0)])
def test_nearest_distance_equals_brute_force(spark, seed, n_targets, bound, monkeypatch):
    if bound is not None:  # as on tables too large to broadcast
        monkeypatch.setattr(distribute, "BROADCAST_VALUES", bound)
    rng = random.Random(seed)
    points = {(rng.randint(-70, 90), rng.randint(-40, 120)) for _ in range(300)}
    targets = {(rng.randint(-30, 60), rng.randint(-40, 30)) for _ in range(n_targets)}
    got = grids.nearest_distance(_cells(spark, points), _cells(spark, targets), cell=1.0).collect()
    want = _brute(points, targets)
    assert len(got) == len(points)
    assert all(r.distance == pytest.approx(want[(r.cell_x, r.cell_y)]) for r in got)


def test_nearest_distance_with_dense_targets_copies_and_cap(spark):
    block = [(x, y) for x in range(20) for y in range(20)]
    points = [(30, 10)] * 500 + [(5, 5), (-3, -4), (200, 200), (25, 25)]
    frame = _cells(spark, points).withColumn("id", F.monotonically_increasing_id())
    got = grids.nearest_distance(frame, _cells(spark, block * 3), cell=500.0, cap=30_000.0).collect()
    assert len(got) == len(points)
    by_cell = {(r.cell_x, r.cell_y): r.distance for r in got}
    assert by_cell == {
        (30, 10): 11 * 500.0, (5, 5): 0.0, (-3, -4): 2500.0, (200, 200): None, (25, 25): pytest.approx(500 * math.hypot(6, 6)),
    }


def test_nearest_distance_without_targets(spark):
    got = grids.nearest_distance(_cells(spark, [(1, 1), (4, 4)]), _cells(spark, []), cell=1.0).collect()
    assert [r.distance for r in got] == [None, None]
    one = grids.nearest_distance(_cells(spark, [(1, 1)]), _cells(spark, [(1, 1)]), cell=1.0).collect()
    assert [r.distance for r in one] == [0.0]


def test_neighbourhood_fraction_equals_brute_force(spark):
    rng = random.Random(3)
    flags = {(rng.randint(0, 40), rng.randint(-10, 25)): rng.random() < 0.4 for _ in range(500)}
    df = spark.createDataFrame([(x, y, f) for (x, y), f in flags.items()], "cell_x long, cell_y long, f boolean")
    got = grids.neighbourhood_fraction(df, "f", radius=4.2, cell=1.0).collect()
    for r in got:
        near = [f for p, f in flags.items() if math.dist(p, (r.cell_x, r.cell_y)) <= 4.2]
        assert r.fraction == pytest.approx(sum(near) / len(near))
    assert len(got) == len(flags)


def test_points_in_and_out_of_a_radius(spark):
    df = spark.createDataFrame([(0, 0, True), (20, 0, False), (21, 0, False), (12, 16, False), (13, 16, True)], "cell_x long, cell_y long, f boolean")
    got = {(r.cell_x, r.cell_y): r.fraction for r in grids.neighbourhood_fraction(df, "f", 10_000.0).collect()}
    assert got[(0, 0)] == pytest.approx(1 / 3)  # itself, (20, 0) and (12, 16); 10 km is inside

"""Polygons of parts and holes over adaptive tiles against the even-odd rule on every pair."""

import random

import pytest
from pyspark.sql import functions as F

from wayline.functions import geo as G
from wayline.operators import tiles

PARTS = "poly int, parts array<array<array<struct<x: double, y: double>>>>"


def square(x, y, r, back=False):
    ring = [(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r), (x - r, y - r)]
    return ring[::-1] if back else ring


def holds(parts, x, y):
    odd = False
    for ring in (r for part in parts for r in part):
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            if (ay > y) != (by > y) and x < ax + (bx - ax) * (y - ay) / (by - ay):
                odd = not odd
    return odd


def star(rng, x, y, r, n):
    import math

    ring = [(x + math.cos(2 * math.pi * k / n) * r * rng.uniform(0.3, 1), y + math.sin(2 * math.pi * k / n) * r * rng.uniform(0.3, 1)) for k in range(n)]
    return [*ring, ring[0]]


def polygons():
    rng = random.Random(8)
    found = {
        1: [[square(0, 0, 60)]],
        2: [[square(0, 0, 40), square(0, 0, 20, back=True)], [square(0, 0, 10)]],
        3: [[square(10, 10, 30), square(12, 12, 5), square(-5, -5, 4, back=True)], [square(80, 40, 6)]],
        4: [[star(rng, -30, 20, 45, 60)]],
        5: [[star(rng, 31.3, 31.3, 0.4, 9), square(31.3, 31.3, 0.05)]],
        6: [[square(200, 80, 2)]],
        7: [[[(5, 5), (5, 5)]]],
        8: [],
    }
    return found


@pytest.mark.parametrize("load,depth", [(10_000, 9), (40, 9), (15, 3)])
def test_pairs_equal_every_pair(spark, load, depth):
    rng = random.Random(load)
    points = [(i, rng.uniform(-90, 210), rng.uniform(-70, 90)) for i in range(300)] + [(300 + i, 31.3 + rng.gauss(0, 0.3), 31.3 + rng.gauss(0, 0.3)) for i in range(400)]
    points += [(1000 + i, float(x), float(y)) for i, (x, y) in enumerate((a, b) for a in (-60, -40, -20, 0, 20, 40, 60) for b in (-60, -20, 0, 10, 20, 60))] + [(2000 + i, 31.0, 31.0) for i in range(60)]
    shapes = polygons()
    frame = spark.createDataFrame([(k, [[[{"x": float(x), "y": float(y)} for x, y in r] for r in p] for p in v]) for k, v in shapes.items()], PARTS)
    got = sorted((r.pid, r.poly) for r in tiles.pairs(spark.createDataFrame(points, "pid int, x double, y double"), frame, load, depth).collect())
    assert got == sorted((i, k) for i, x, y in points for k, v in shapes.items() if holds(v, x, y))


def test_a_dense_tile_is_split_and_its_points_dealt(spark):
    points = spark.range(4000).selectExpr("cast(id as int) as pid", "1.0 + id % 50 / 1000.0D as x", "1.0D as y")
    wide = spark.createDataFrame([(1, [[[{"x": float(x), "y": float(y)} for x, y in square(0, 0, 90)]]])], PARTS)
    tree = tiles.tile_tree(points, (-90.0, -90.0, 90.0, 90.0), 500, 6).collect()
    leaves = [r for r in tree if r.leaf]
    assert max(r.level for r in tree) == 6 and sum(r.n for r in leaves) == 4000
    assert all(r.n / r.slices <= 500 for r in leaves)
    assert tiles.pairs(points, wide, 500, 6).count() == 4000


def test_sums_locate_and_empty_tables(spark):
    shapes = spark.createDataFrame([(2, [[[{"x": float(x), "y": float(y)} for x, y in square(0, 0, 5)]]]), (1, [[[{"x": float(x), "y": float(y)} for x, y in square(3, 3, 5)]]])], PARTS)
    points = spark.createDataFrame([(1, 1.0, 1.0, 2.0), (1, 1.0, 1.0, 2.0), (2, -4.0, -4.0, 3.0), (3, 50.0, 0.0, 1.0), (4, 0.0, 0.0, -1.0), (5, None, 0.0, 1.0)], "pid int, x double, y double, value double")
    assert sorted(map(tuple, tiles.sums(points, shapes).collect())) == [(1, 4.0, 2), (2, 7.0, 3)]
    assert sorted((r.pid, r.poly) for r in tiles.locate(points, shapes).collect()) == [(1, 1), (1, 1), (2, 2), (4, 1)]
    assert tiles.pairs(points.limit(0), shapes).count() == 0
    assert tiles.pairs(points, shapes.limit(0)).count() == 0


def test_holes_subtract_from_areas(spark):
    ring = lambda r: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in r])
    outer, hole, other = square(10, 50, 4), square(10, 50, 1, back=True), square(30, 50, 2)
    row = spark.range(1).select(
        G.polygon_area(F.array(F.array(ring(outer))), "km2").alias("whole"), G.polygon_area(F.array(F.array(ring(outer), ring(hole)), F.array(ring(other))), "km2").alias("both"),
        G.polygon_area(F.array(F.array(ring(hole))), "km2").alias("hole"), G.ring_area(ring(outer), "km2").alias("ring"),
    ).first()
    assert row.whole == row.ring and abs(row.ring / 1e3 - 493) < 60
    # The same parallels hold for all rings, so small differences stay.
    assert row.both == pytest.approx(row.whole * (1 - 1 / 16 + 1 / 4), rel=0.01)

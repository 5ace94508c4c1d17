"""Points in polygons, boxes and grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G


def ring_box(polygons: DataFrame) -> DataFrame:
    """Adds min_x, min_y, max_x, max_y of the ring (array of structs x, y)."""
    axis = lambda f, name: f(F.transform("ring", lambda p: p[name]))
    return polygons.withColumns({"min_x": axis(F.array_min, "x"), "min_y": axis(F.array_min, "y"), "max_x": axis(F.array_max, "x"), "max_y": axis(F.array_max, "y")})


def locate(points: DataFrame, polygons: DataFrame, size: float = 10.0) -> DataFrame:
    """Points (x, y) with the first polygon (poly, least number) that holds each; points in none are left out.
    Polygons are dealt to the cells of a grid of `size` degrees that their boxes touch, so that the join is on equal
    cells, then by box and ring. Adds poly."""
    key = lambda c: F.floor(c / size).cast("int")
    boxes = ring_box(polygons)
    boxes = boxes.withColumn("_cx", F.explode(F.sequence(key(F.col("min_x")), key(F.col("max_x"))))).withColumn("_cy", F.explode(F.sequence(key(F.col("min_y")), key(F.col("max_y")))))
    held = boxes.select("poly", "ring", "_cx", "_cy", "min_x", "min_y", "max_x", "max_y")
    near = points.withColumns({"_row": F.monotonically_increasing_id(), "_cx": key(F.col("x")), "_cy": key(F.col("y"))}).join(held, ["_cx", "_cy"])
    near = near.where("x between min_x and max_x and y between min_y and max_y").where(G.inside(F.col("ring"), F.col("x"), F.col("y")))
    # Equal rows are points of their own: one that lies in several polygons is told by its number.
    return near.groupBy("_row", *points.columns).agg(F.min("poly").alias("poly")).drop("_row")


def polygon_sums(points: DataFrame, polygons: DataFrame, size: float = 10.0) -> DataFrame:
    """Sum of the positive values of the points in each polygon, 0 without any. points: pid, x, y, value."""
    found = locate(points.where("value > 0"), polygons, size).groupBy("poly").agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    return polygons.select("poly").join(found, "poly", "left").select("poly", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("n", F.lit(0)).alias("n"))


def bounds(points: DataFrame) -> DataFrame:
    """minx, maxx, miny, maxy, kept inside the world's."""
    return points.agg(F.least(F.lit(180.0), F.min("x")).alias("minx"), F.greatest(F.lit(-180.0), F.max("x")).alias("maxx"), F.least(F.lit(90.0), F.min("y")).alias("miny"), F.greatest(F.lit(-90.0), F.max("y")).alias("maxy"))


def downsample(points: DataFrame, size: float = 1 / 12) -> DataFrame:
    """Sum of values by coarser cell; partial sums come before the shuffle."""
    return points.groupBy(G.cell(F.col("x"), size).alias("cx"), G.cell(F.col("y"), size).alias("cy")).agg(F.sum("value").alias("value"))


def cells_within(points: DataFrame, size: float, km: float) -> DataFrame:
    """Cells whose distance from a point (pid, x, y) is at most km: pid, i, j (steps from the point's cell); at most once
    around the world, also near the poles, where cells have no width."""
    centre = points.withColumns({"gx": G.cell(F.col("x"), size) * size, "gy": G.cell(F.col("y"), size) * size})
    wide = G.distance_km(F.col("gx"), F.col("gy"), F.col("gx") + size, F.col("gy"))
    high = F.lit(math.radians(size) * G.RADIUS_KM)
    around = math.ceil(180 / size)
    reach = lambda w: F.coalesce(F.least(F.ceil(F.lit(km) / F.nullif(w, F.lit(0.0))) + 1, F.lit(around)), F.lit(around)).cast("int")
    steps = centre.withColumns({"ni": reach(wide), "nj": reach(high)})
    steps = steps.withColumn("i", F.explode(F.sequence(-F.col("ni"), F.col("ni")))).withColumn("j", F.explode(F.sequence(-F.col("nj"), F.col("nj"))))
    d = G.distance_km(F.col("x"), F.col("y"), F.col("gx") + F.col("i") * size, F.col("gy") + F.col("j") * size)
    return steps.where(d <= km).select("pid", "i", "j")


def dense(pixels: DataFrame) -> DataFrame:
    """Rows of an image as arrays by column, null where the value is not positive."""
    cells = F.array_sort(F.collect_list(F.struct("col", F.when(F.col("value") > 0, F.col("value")).alias("value"))))
    return pixels.groupBy("row").agg(cells.alias("cells"))


def masked(value: Column, least: float) -> Column:
    """Null where the value is below `least`."""
    return F.when(value >= least, value)


def extent(points: DataFrame, margin: float = 0.5, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """left, right, down, up of a map of the points with a margin, or those of the box, and its centre."""
    found = points.agg((F.min("x") - margin).alias("left"), (F.max("x") + margin).alias("right"), (F.min("y") - margin).alias("down"), (F.max("y") + margin).alias("up"))
    if box is not None:
        found = found.select(*[F.lit(float(v)).alias(c) for v, c in zip(box, ("left", "right", "down", "up"))])
    centre = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) / 2
    return found.withColumns({"centre_lon": centre("left", "right"), "centre_lat": centre("down", "up")})


def image_shape(pixels: DataFrame) -> DataFrame:
    """First and last row and column, height and width."""
    found = pixels.agg(F.min("row").alias("top"), F.max("row").alias("bottom"), F.min("col").alias("left"), F.max("col").alias("right"))
    return found.withColumns({"height": F.col("bottom") - F.col("top") + 1, "width": F.col("right") - F.col("left") + 1})


def population_table(areas: DataFrame, sums: DataFrame) -> DataFrame:
    """areas (poly, area, other columns) with population (0 without any) and density; sums: poly, total."""
    found = areas.join(sums.select("poly", F.col("total").alias("population")), "poly", "left").withColumn("population", F.coalesce("population", F.lit(0.0)))
    return found.withColumn("density", F.col("population") / F.nullif("area", F.lit(0.0)))


def labels(places: DataFrame, text: str) -> DataFrame:
    """x, y, label of places (lon, lat) to be drawn with their names; places without a spot are left out."""
    return places.where("lon is not null and lat is not null").select(F.col("lon").alias("x"), F.col("lat").alias("y"), F.col(text).cast("string").alias("label"))


def segments(lines: DataFrame, key: str) -> DataFrame:
    """A row for each pair of points that follow each other in lines (key, line: an array of structs lon, lat)."""
    n = F.size("line")
    pairs = F.arrays_zip(F.slice("line", F.lit(1), F.greatest(n - 1, F.lit(0))).alias("p"), F.slice("line", F.lit(2), F.greatest(n - 1, F.lit(0))).alias("q"))
    rows = lines.select(key, F.posexplode(pairs).alias("pos", "s"))
    return rows.select(key, "pos", F.col("s.p.lon").alias("x1"), F.col("s.p.lat").alias("y1"), F.col("s.q.lon").alias("x2"), F.col("s.q.lat").alias("y2"))

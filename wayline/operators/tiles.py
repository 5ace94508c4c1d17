"""Points in polygons of parts and holes, over tiles that follow the points.

The polygons' box is halved both ways, DEPTH times at most, wherever a tile holds more than `load` points, so tiles are small
where points are dense; a tile of the last depth that still holds more has its points dealt over slices. Each polygon walks
down the tiles that it touches. A tile without any of its sides lies inside or outside as a whole: outside ones are left,
and points of inside ones need no test. Of the others a row keeps only the sides that can matter there: those beside or right of
the tile at its height, and of those that pass it on the right from bottom to top only whether they are odd.

There are 4**DEPTH tiles of the last depth at most, which bounds the table that tells points their tiles; it is broadcast. The
points are moved once, by tile and slice, or not at all where the planner finds the polygons' rows small enough.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G
from . import lineage

DEPTH, LOAD = 9, 50_000


def box(polygons: DataFrame) -> tuple[float, float, float, float] | None:
    """x1, y1, x2, y2 around all polygons (parts: parts of rings of points x, y); None without any point."""
    points = polygons.select(F.explode(F.flatten(F.flatten("parts"))).alias("p"))
    b = points.agg(F.min("p.x").alias("x1"), F.min("p.y").alias("y1"), F.max("p.x").alias("x2"), F.max("p.y").alias("y2")).first()
    return None if b.x1 is None else tuple(b)


def _code(x: Column, y: Column, around: tuple, depth: int) -> Column:
    """The number of the last-depth tile of a point: two bits for each halving, coarse ones first."""
    n = 1 << depth
    place = lambda c, low, high: F.least(F.greatest(F.floor((c - low) / ((high - low) or 1.0) * n), F.lit(0)), F.lit(n - 1)).cast("bigint")
    i, j = place(x, around[0], around[2]), place(y, around[1], around[3])
    bit = lambda v, k: F.shiftright(v, k).bitwiseAND(F.lit(1))
    return reduce(lambda a, b: a + b, [(bit(i, k) * 2 + bit(j, k)) * (1 << 2 * k) for k in range(depth)])


def tile_tree(points: DataFrame, around: tuple, load: int = LOAD, depth: int = DEPTH) -> DataFrame:
    """level, code, n and leaf of all tiles that hold points (x, y) and are no part of a leaf."""
    last = points.groupBy(_code(F.col("x"), F.col("y"), around, depth).alias("code")).agg(F.count("*").alias("n"))
    up = last.select("n", "code", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"))
    nodes = lineage.cut(up.groupBy("level", F.expr(f"shiftright(code, 2 * ({depth} - level))").alias("code")).agg(F.sum("n").alias("n")))
    full = nodes.where(F.col("n") > load).select((F.col("level") + 1).alias("level"), F.col("code").alias("_up"))
    below = nodes.withColumn("_up", F.shiftright("code", 2)).join(full, ["level", "_up"], "left_semi").unionByName(nodes.where("level = 0").withColumn("_up", F.lit(0).cast("bigint")))
    return lineage.cut(below.select("level", "code", "n", ((F.col("n") <= load) | (F.col("level") == depth)).alias("leaf"), F.ceil(F.when(F.col("level") == depth, F.col("n") / load).otherwise(1)).cast("int").alias("slices")))


def _descend(polygons: DataFrame, tree: DataFrame, around: tuple) -> DataFrame:
    """poly, level, code, inside, odd, sides: the leaves that each polygon touches."""
    x1, y1, x2, y2 = around
    front = polygons.select("poly", F.lit(0).cast("bigint").alias("code"), F.lit(0).cast("bigint").alias("i"), F.lit(0).cast("bigint").alias("j"), F.lit(False).alias("inside"), F.lit(False).alias("odd"), G.sides(F.col("parts")).alias("sides"))
    deepest = tree.where("leaf").agg(F.max("level")).first()[0]
    found = None
    for level in range((-1 if deepest is None else deepest) + 1):
        wide, high = ((x2 - x1) or 1.0) / (1 << level), ((y2 - y1) or 1.0) / (1 << level)
        # A little more than the tile, as points are dealt by rounded quotients.
        left, low = x1 + F.col("i") * wide - wide * 1e-9, y1 + F.col("j") * high - high * 1e-9
        at = front.withColumns({"_l": left, "_r": left + wide * (1 + 2e-9), "_d": low, "_u": low + high * (1 + 2e-9)})
        at = at.join(tree.where(F.col("level") == level).select("code", "leaf"), "code")
        least, most = (lambda s, c: F.least(s[f"a{c}"], s[f"b{c}"])), (lambda s, c: F.greatest(s[f"a{c}"], s[f"b{c}"]))
        passes = lambda s: (least(s, "x") > F.col("_r") + wide * 1e-6) & (least(s, "y") <= F.col("_d")) & (most(s, "y") > F.col("_u"))
        beside = lambda s: (most(s, "y") >= F.col("_d")) & (least(s, "y") <= F.col("_u")) & (most(s, "x") >= F.col("_l"))
        corner = lambda s, x, y: F.signum((s["bx"] - s["ax"]) * (F.col(y) - s["ay"]) - (s["by"] - s["ay"]) * (F.col(x) - s["ax"]))
        # A side meets the tile if its box does and the tile's corners are not all on one side of its line.
        split = lambda s: F.abs(corner(s, "_l", "_d") + corner(s, "_l", "_u") + corner(s, "_r", "_d") + corner(s, "_r", "_u")) < 4
        meets = lambda s: (least(s, "x") <= F.col("_r")) & split(s)
        at = at.withColumn("_odd", F.col("odd") != (F.size(F.filter("sides", passes)) % 2 == 1)).withColumn("sides", F.filter("sides", lambda s: beside(s) & ~passes(s)))
        at = at.withColumn("_cut", ~F.col("inside") & F.exists("sides", meets))
        centre = (F.col("_odd") != (G.crossings(F.col("sides"), (F.col("_l") + F.col("_r")) / 2, (F.col("_d") + F.col("_u")) / 2) % 2 == 1))
        at = at.withColumn("inside", F.col("inside") | (~F.col("_cut") & centre)).where("inside or _cut")
        at = at.select("poly", "code", "i", "j", "leaf", "inside", F.col("_odd").alias("odd"), F.when(~F.col("inside"), F.col("sides")).otherwise(F.array().cast(front.schema["sides"].dataType)).alias("sides"))
        at = lineage.cut(at)
        leaves = at.where("leaf").select("poly", F.lit(level).alias("level"), "code", "inside", "odd", "sides")
        found = leaves if found is None else found.unionByName(leaves)
        step = F.struct(F.col("k"), F.shiftright("k", 1).alias("di"), F.col("k").bitwiseAND(F.lit(1)).alias("dj"))
        front = at.where("not leaf").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("s", step)
        front = front.select("poly", (F.col("code") * 4 + F.col("k")).alias("code"), (F.col("i") * 2 + F.col("s.di")).alias("i"), (F.col("j") * 2 + F.col("s.dj")).alias("j"), "inside", "odd", "sides")
    return found


def pairs(points: DataFrame, polygons: DataFrame, load: int = LOAD, depth: int = DEPTH) -> DataFrame:
    """Points (x, y) with the number (poly) of each polygon (poly, parts) that holds them, by the even-odd rule over all rings."""
    around = box(polygons)
    if around is None:
        return points.limit(0).withColumn("poly", F.lit(None).cast(polygons.schema["poly"].dataType))
    near = points.where(F.col("x").between(around[0], around[2]) & F.col("y").between(around[1], around[3]))
    tree = tile_tree(near, around, load, depth)
    rows = _descend(polygons, tree, around)
    if rows is None:
        return points.limit(0).withColumn("poly", F.lit(None).cast(polygons.schema["poly"].dataType))
    leaves = tree.where("leaf").select("level", "code", "slices")
    # 4**depth rows of last-depth tiles, at most: which leaf each lies in.
    spread = near.select(_code(F.col("x"), F.col("y"), around, depth).alias("_last")).distinct().select("_last", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"))
    owner = spread.withColumn("code", F.expr(f"shiftright(_last, 2 * ({depth} - level))")).join(leaves, ["level", "code"])
    tiled = near.withColumn("_last", _code(F.col("x"), F.col("y"), around, depth)).join(F.broadcast(owner.withColumnsRenamed({"level": "_level", "code": "_code", "slices": "_slices"})), "_last")
    dealt = tiled.withColumn("_slice", F.pmod(F.monotonically_increasing_id(), F.col("_slices")).cast("int"))
    held = rows.join(leaves, ["level", "code"]).select("poly", F.col("level").alias("_level"), F.col("code").alias("_code"), "inside", "odd", "sides", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("_slice"))
    both = dealt.join(held, ["_level", "_code", "_slice"])
    inner = F.col("inside") | (F.col("odd") != (G.crossings(F.col("sides"), F.col("x"), F.col("y")) % 2 == 1))
    return both.where(inner).select(*points.columns, "poly")


def sums(points: DataFrame, polygons: DataFrame, load: int = LOAD, depth: int = DEPTH) -> DataFrame:
    """total and n of the positive values of the points in each polygon, 0 without any. A point counts in every polygon that
    holds it. points: x, y, value."""
    found = pairs(points.where("value > 0").select("x", "y", "value"), polygons, load, depth).groupBy("poly").agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    return polygons.select("poly").join(found, "poly", "left").select("poly", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("n", F.lit(0)).alias("n"))


def locate(points: DataFrame, polygons: DataFrame, load: int = LOAD, depth: int = DEPTH) -> DataFrame:
    """Points with the least number of the polygons that hold each; points in none are left out. Equal points are
    told apart by a row number, so that none is lost."""
    numbered = points.withColumn("_row", F.monotonically_increasing_id())
    return pairs(numbered, polygons, load, depth).groupBy("_row", *points.columns).agg(F.min("poly").alias("poly")).drop("_row")

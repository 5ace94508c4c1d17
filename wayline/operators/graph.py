"""Edge tables as graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G
from . import lineage


def undirected(edges: DataFrame, weight: str = "w", row: str = "row") -> DataFrame:
    """One row for each pair of ends; of repeated edges, in either direction, the last row counts."""
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), weight, row)
    return pairs.groupBy("a", "b").agg(F.max_by(weight, row).alias(weight))


def cut(edges: DataFrame, most: float, weight: str = "w") -> DataFrame:
    """Edges of at most `most`; nodes without an edge are gone, a loop is an edge."""
    return edges.where(F.col(weight) <= most)


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()


#: Edges of one node that one task gets; a node with more has them dealt over slices.
SLICE = 10_000


def adjacency(edges: DataFrame, weight: str = "w", directed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Edges (node, slice, to, _w), partitioned by node and slice once for all rounds, and the number of slices (node, slices) of
    the nodes with more than SLICE edges."""
    step = edges.select(F.col("a").alias("node"), F.col("b").alias("to"), F.col(weight).cast("double").alias("_w"))
    if not directed:
        step = step.union(edges.select("b", "a", F.col(weight).cast("double")))
    step = lineage.cut(step)
    busy = lineage.cut(step.groupBy("node").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices")).where("slices > 1"))
    dealt = step.join(busy, "node", "left").withColumn("slice", F.pmod(F.xxhash64("to"), F.coalesce("slices", F.lit(1))).cast("int"))
    return lineage.held(dealt.select("node", "slice", "to", "_w"), "node", "slice"), busy


def _extended(front: DataFrame, step: DataFrame, busy: DataFrame) -> DataFrame:
    """origin, node, new: the least distances to the ends of the edges of the front (origin, node, dist, heavy, delta): with heavy
    those longer than delta, else the others."""
    wide = front.join(busy, "node", "left").withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)))
    moved = wide.join(step, ["node", "slice"]).where((F.col("_w") > F.col("delta")) == F.col("heavy"))
    return moved.groupBy("origin", F.col("to").alias("node")).agg(F.min(F.col("dist") + F.col("_w")).alias("new"))


def distances(edges: DataFrame, sources: DataFrame, rounds: int | None = None, weight: str = "w", directed: bool = False, delta: float | None = None) -> DataFrame:
    """Least weight from each source (origin, node) to every node within `rounds` edges, or until nothing changes.
    edges: a, b, weight (0 at least, where rounds is not given).

    Without rounds the search is by buckets of `delta` (twice the mean weight, if not given): each origin works on its nearest bucket
    with open nodes, over edges of at most delta until the bucket has none, then once over its longer edges. The edges
    are partitioned once; the distances are kept by node, so a round moves what it has found and no edges. With rounds, all
    nodes that have improved are extended in each of them."""
    step, busy = adjacency(edges, weight, directed)
    if rounds is not None:
        return _within(step, busy, sources, rounds)
    weights = step.agg(F.min("_w").alias("low"), F.avg("_w").alias("mean"), F.max("_w").alias("most")).first()
    if weights.low is not None and weights.low < 0:
        raise ValueError("an edge has a negative weight")
    delta = delta or 2 * (weights.mean or 0.5)
    longer = F.lit(weights.most is not None and weights.most > delta)
    known = lineage.held(sources.select("origin", "node", F.lit(0.0).alias("dist"), F.lit(True).alias("near"), longer.alias("far")).distinct(), "node")
    while not (open_ := known.where("near or far").withColumn("bucket", F.floor(F.col("dist") / delta))).isEmpty():
        # The nearest open bucket of each origin, and whether it has nodes whose short edges wait.
        turn = open_.groupBy("origin").agg(F.min(F.struct("bucket", ~F.col("near"))).alias("t")).select("origin", F.col("t.bucket").alias("bucket"), F.col("t.col2").alias("heavy"))
        front = open_.join(turn, ["origin", "bucket"]).where(F.col("heavy") | F.col("near")).select("origin", "node", "dist", "heavy", F.lit(delta).alias("delta"))
        moved = _extended(front, step, busy).repartition("node")
        now = known.join(moved, ["origin", "node"], "full").join(front.select("origin", "node", "heavy"), ["origin", "node"], "left")
        better = F.col("dist").isNull() | (F.col("new") < F.col("dist"))
        done = lambda c, heavy: F.coalesce(F.col(c), F.lit(False)) & ~F.coalesce(F.col("heavy") == heavy, F.lit(False))
        known = lineage.kept_in_place(now.select(
            "origin", "node", F.when(better, F.col("new")).otherwise(F.col("dist")).alias("dist"),
            (F.coalesce(better, F.lit(False)) | done("near", False)).alias("near"), ((F.coalesce(better, F.lit(False)) & longer) | done("far", True)).alias("far"),
        ))
    return known.select("origin", "node", "dist")


def _within(step: DataFrame, busy: DataFrame, sources: DataFrame, rounds: int) -> DataFrame:
    """Least weight within `rounds` edges."""
    known = sources.select("origin", "node", F.lit(0.0).alias("dist")).distinct()
    front = known
    for _ in range(rounds):
        every = front.withColumns({"heavy": F.lit(True), "delta": F.lit(float("-inf"))})
        joined = known.join(_extended(every, step, busy), ["origin", "node"], "full").select("origin", "node", "dist", "new", (F.col("dist").isNull() | (F.col("new") < F.col("dist"))).alias("better"))
        joined = lineage.cut(joined)
        front = joined.where("better").select("origin", "node", F.col("new").alias("dist"))
        known = joined.select("origin", "node", F.when(F.col("better"), F.col("new")).otherwise(F.col("dist")).alias("dist"))
        if front.isEmpty():
            break
    return known


def travel_time(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs: origin, target. Weight of the shortest path, -1 if there is none."""
    found = distances(edges, pairs.select("origin", F.col("origin").alias("node")).distinct())
    return pairs.join(found.withColumnRenamed("node", "target"), ["origin", "target"], "left").select("origin", "target", F.coalesce("dist", F.lit(-1.0)).alias("dist"))


def descendants(edges: DataFrame, roots: DataFrame, rounds: int | None = None) -> DataFrame:
    """Nodes that each root (node) reaches along src -> dst, without itself at depth 0."""
    weighted = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1.0).alias("w"))
    found = distances(weighted, roots.select(F.col("node").alias("origin"), "node"), rounds, directed=True)
    return found.where("dist > 0").select(F.col("origin").alias("root"), "node", F.col("dist").cast("int").alias("depth"))


def located(edges: DataFrame, places: DataFrame) -> DataFrame:
    """Edges whose both ends have a place (node, lon, lat), with the ends' places."""
    at = lambda end, k: places.select(F.col("node").alias(end), F.col("lon").alias(f"lon{k}"), F.col("lat").alias(f"lat{k}"))
    return edges.join(at("a", 1), "a").join(at("b", 2), "b")


def shade(value) -> object:
    """Colour class of an edge's value."""
    v = F.abs(value)
    return F.when(v >= 100, "r").when(v >= 50, "g").when(v >= 15, "b").when(v >= 2, "y").otherwise("lightgrey")


def relabelled(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Ends renamed by names (old, new); ends without a name stay."""
    at = lambda end: names.select(F.col("old").alias(end), F.col("new").alias(f"{end}_new"))
    joined = edges.join(at("a"), "a", "left").join(at("b"), "b", "left")
    return joined.withColumns({"a": F.coalesce("a_new", "a"), "b": F.coalesce("b_new", "b")}).drop("a_new", "b_new")


def composed(left: DataFrame, right: DataFrame, weight: str = "w") -> DataFrame:
    """Union of two edge tables; the right one's weights win."""
    both = left.select("a", "b", weight, F.lit(0).alias("_side")).union(right.select("a", "b", weight, F.lit(1)))
    return both.groupBy("a", "b").agg(F.max_by(weight, "_side").alias(weight))


def reach(starts: DataFrame, size: float, times: DataFrame, most: float, rounds: int = 1_000) -> DataFrame:
    """Cells reached from each start cell (origin, lon, lat) through neighbours whose drive time from the origin is at
    most `most`. times: origin, lon, lat, seconds, metres; the start is always in."""
    found = starts.select("origin", "lon", "lat", F.lit(0.0).alias("metres"), F.lit(0.0).alias("seconds"))
    front = found
    for k in range(rounds):
        near = front.select("origin", F.inline(G.around(F.col("lon"), F.col("lat"), size))).distinct()
        front = near.join(times.where((F.col("seconds") >= 0) & (F.col("seconds") <= most)), ["origin", "lon", "lat"])
        front = front.select("origin", "lon", "lat", F.round("metres").alias("metres"), F.round("seconds").alias("seconds")).join(found, ["origin", "lon", "lat"], "left_anti")
        front = lineage.cut(front)
        if front.isEmpty():
            return found
        found = found.union(front)
        if k % 8 == 7:
            # The union of few frames is cheap, that of many is not.
            found = lineage.cut(found)
    raise RuntimeError(f"the cells did not end in {rounds} rounds")

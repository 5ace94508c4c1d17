"""Distributions of samples."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from . import lineage


def log_histogram(samples: DataFrame, bins: int = 50) -> DataFrame:
    """x, freq: shares of positive samples in logarithmic bins, from the decade at or above zero-truncation of the least
    to the rounded decade of the largest; samples beyond the last edge are in no bin but count in the total. Empty bins
    at both ends are left out, the first bin excepted at the tail."""
    span = samples.agg(F.log10(F.min("value")).cast("int").alias("low"), F.rint(F.log10(F.max("value"))).alias("high"), F.count("*").alias("n")).first()
    if not span.n or span.high is None:
        return samples.sparkSession.createDataFrame([], "bin int, x double, freq double")
    step = (span.high - span.low) / (bins - 1)
    if step <= 0:
        return samples.sparkSession.createDataFrame([], "bin int, x double, freq double")
    place = F.floor((F.log10("value") - F.lit(float(span.low))) / F.lit(step) + F.lit(1e-9)).cast("int")
    counted = samples.select(place.alias("bin")).where(f"bin between 0 and {bins - 1}").groupBy("bin").agg((F.count("*") / F.lit(span.n)).alias("freq"))
    edges = samples.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), F.pow(F.lit(10.0), F.lit(float(span.low)) + F.col("id") * F.lit(step)).alias("x"))
    held = counted.agg(F.min("bin").alias("first"), F.max("bin").alias("last"))
    full = edges.join(counted, "bin", "left").join(F.broadcast(held)).where("bin between first and last")  # one row
    return full.select("bin", "x", F.coalesce("freq", F.lit(0.0)).alias("freq"))


def reverse_cdf(histogram: DataFrame) -> DataFrame:
    """Share at or above each bin; a histogram has a bounded number of rows."""
    after = Window.orderBy("bin").rowsBetween(0, Window.unboundedFollowing)
    return histogram.select("bin", "x", F.sum("freq").over(after).alias("share"))


#: Bins of an interval in one pass of at_places().
BINS = 256


def at_places(values: DataFrame, places: list[int]) -> dict[int, float | None]:
    """The value at each place, from 0, of the sorted values: nulls first, nan last. Each pass counts, for each interval that holds
    wanted places, its bins' values, and keeps the bins that hold them, until such a bin holds one value. Nothing is sorted or
    copied: a pass moves BINS counts for each interval at most, of which there are as many as places."""
    v = F.col("value").cast("double")
    whole = F.when(v.isNotNull() & ~F.isnan(v), v)
    total = values.agg(F.count(F.when(v.isNull(), 1)).alias("null"), F.count(whole).alias("whole"), F.min(whole).alias("low"), F.max(whole).alias("high")).first()
    found: dict[int, float | None] = {p: None for p in places if p < total.null}
    found |= {p: math.nan for p in places if p >= total.null + total.whole}
    # (low, high, places below it): intervals with the places that are wanted inside.
    open_ = {(total.low, total.high, total.null): {p for p in places if total.null <= p < total.null + total.whole}}
    while True:
        found |= {p: low for (low, high, _), own in open_.items() if low == high for p in own}
        open_ = {k: own for k, own in open_.items() if own and k[0] != k[1]}
        if not open_:
            return found
        order = sorted(open_)
        lows, highs = (F.array(*[F.lit(float(k[i])) for k in order]) for i in (0, 1))
        rows = values.select(whole.alias("v")).where(F.col("v").between(order[0][0], order[-1][1])).withColumn("i", F.size(F.filter(lows, lambda low: low <= F.col("v"))) - 1)
        rows = rows.where((F.col("i") >= 0) & (F.col("v") <= F.get(highs, F.col("i"))))
        # Far numbers are told apart by their logarithms first; both ways never put a larger value into an earlier bin.
        scale = lambda x: F.signum(x) * F.log1p(F.abs(x))
        far = F.array(*[F.lit(_far(k[0], k[1])) for k in order])
        low, high, wide = F.get(lows, F.col("i")), F.get(highs, F.col("i")), F.get(far, F.col("i"))
        share = F.when(wide, (scale(F.col("v")) - scale(low)) / (scale(high) - scale(low))).otherwise((F.col("v") / 2 - low / 2) / (high / 2 - low / 2))
        place = F.when(F.col("v") == high, BINS - 1).when(F.col("v") == low, 0).otherwise(F.least(F.greatest(F.floor(share * BINS), F.lit(0)), F.lit(BINS - 1))).cast("int")
        bins: dict[int, list] = {}
        for r in rows.groupBy("i", place.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect():
            bins.setdefault(r.i, []).append((r.bin, r.n, r.low, r.high))
        new: dict[tuple, set] = {}
        for i, k in enumerate(order):
            below = k[2]
            for _, n, a, b in sorted(bins[i]):
                new[a, b, below] = {p for p in open_[k] if below <= p < below + n}
                below += n
        open_ = new


def _far(low: float, high: float) -> bool:
    """Do two bounds differ so much that bins of equal width would be coarse, and by their logarithms at all?"""
    scale = lambda x: math.copysign(math.log1p(abs(x)), x)
    return scale(high) - scale(low) > 12 and math.isfinite(scale(high) - scale(low))


def split_points(values: DataFrame, n: int) -> DataFrame:
    """k, split: the value at place round(count / n * k) for k = 1 .. n - 1, ties to even, and the largest for k = n."""
    total = values.agg(F.count("*").alias("total"), F.max("value").alias("top")).first()
    wanted = {k: round(total.total / n * k) for k in range(1, n)}
    kind = values.schema["value"].dataType
    at = at_places(values, sorted({p for p in wanted.values() if p < total.total}))
    rows = [(k, at[p]) for k, p in wanted.items() if p in at]
    found = values.sparkSession.createDataFrame(rows, "k int, split double").select("k", F.col("split").cast(kind).alias("split"))
    return found.union(values.agg(F.lit(n), F.max("value")))


def largest(items: DataFrame, n: int) -> DataFrame:
    """n + 1 rows of the largest values, ties by name."""
    return items.orderBy(F.desc("value"), "name").limit(n + 1)


#: Different x that fit_power takes: their sums lie on the driver.
MOST_X = 1_000_000


def fit_power(points: DataFrame, steps: int = 100, rate: float = 0.01, n: int | None = None) -> tuple[float, float]:
    """w, b of y = b / x**w after full-batch steps from (1, 1), with the step rule sum(2 (model - y) x) / n for w and
    sum(2 (model - y)) / n for b. As the model depends on x alone, points of equal x are added up first, by Spark and once; the
    steps work on those sums on the driver. More than MOST_X different x raise an error: round x, or fit a histogram."""
    held = points.groupBy("x").agg(F.count("*").alias("c"), F.sum("y").alias("s")).limit(MOST_X + 1).collect()
    if len(held) > MOST_X:
        raise ValueError(f"more than {MOST_X} different x")
    rows = np.array([tuple(r) for r in held], dtype=float).reshape(-1, 3).T
    n = n or rows[1].sum()
    w = b = 1.0
    for _ in range(steps if rows.size else 0):
        off = 2 * (b / rows[0] ** w * rows[1] - rows[2])
        w, b = w - rate * math.fsum(off * rows[0]) / n, b - rate * math.fsum(off) / n
        if not (math.isfinite(w) and math.isfinite(b)):
            break
    return float(w), float(b)


def describe_pairs(points: DataFrame) -> DataFrame:
    """Slope, intercept and correlation of y on x."""
    return points.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.corr("y", "x").alias("corr"), F.count("*").alias("n"))


def bucketed(values: DataFrame, splits: DataFrame) -> DataFrame:
    """values with the first bucket whose split reaches the value; null above all. splits (k, split) has a row for each bucket."""
    edges = F.broadcast(splits.agg(F.array_sort(F.collect_list(F.struct("split", "k"))).alias("_s")))  # one row
    reached = F.filter("_s", lambda s: s["split"] >= F.col("value"))
    return values.join(edges).withColumn("bucket", F.get(reached, F.lit(0))["k"]).drop("_s")


def value_range(values: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """low, high: those given, else (also for 0) the least and the largest value."""
    return values.agg((F.lit(low) if low else F.min("value")).alias("low"), (F.lit(high) if high else F.max("value")).alias("high"))


def histogram(values: DataFrame, bins: int) -> DataFrame:
    """bin, x (its lower edge), n, density, for bins of equal width that hold a value; the largest value is in the last."""
    span = values.agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("all"))
    width = (F.col("high") - F.col("low")) / bins
    place = F.coalesce(F.least(F.floor((F.col("value") - F.col("low")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)), F.lit(0)).cast("int")
    counted = values.where("value is not null").join(F.broadcast(span)).groupBy(place.alias("bin"), "low", "high", "all").agg(F.count("*").alias("n"))  # one row
    return counted.select("bin", (F.col("low") + F.col("bin") * width).alias("x"), "n", (F.col("n") / F.col("all") / F.nullif(width, F.lit(0.0))).alias("density"))


def density(values: DataFrame, steps: int) -> DataFrame:
    """point, x, density at steps + 1 points from the least to the largest value: Gaussian kernels whose width is the
    standard deviation times n ** -0.2. Every value counts at every point, in partial sums."""
    span = values.agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("all"), F.stddev_samp("value").alias("sd"))
    span = F.broadcast(span.withColumn("width", F.nullif(F.col("sd") * F.pow("all", F.lit(-0.2)), F.lit(0.0))))  # one row
    rows = values.where("value is not null").join(span).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    x = F.col("low") + F.col("point") * (F.col("high") - F.col("low")) / steps
    kernel = F.exp(-F.pow((x - F.col("value")) / F.col("width"), F.lit(2)) / 2)
    found = rows.groupBy("point", "low", "high", "all", "width").agg(F.sum(kernel).alias("k"))
    return found.select("point", x.alias("x"), (F.col("k") / (F.col("all") * F.col("width") * math.sqrt(2 * math.pi))).alias("density"))


def binned_density(values: DataFrame, steps: int, cells: int = 1_000) -> DataFrame:
    """density() with the values dealt linearly to the two nearest of cells + 1 places first, so that a task sends a number for each
    place, however many values and points there are. It differs from density() by density_error() at most."""
    span = values.agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("all"), F.stddev_samp("value").alias("sd"))
    span = F.broadcast(span.withColumn("width", F.nullif(F.col("sd") * F.pow("all", F.lit(-0.2)), F.lit(0.0))))  # one row
    facts = ["low", "high", "all", "width"]
    rows = values.where("value is not null").join(span).withColumn("_at", F.coalesce((F.col("value") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * cells, F.lit(0.0)))
    rows = rows.withColumn("_i", F.least(F.floor("_at"), F.lit(cells - 1)).cast("int"))
    part = F.col("_at") - F.col("_i")
    dealt = rows.select(*facts, F.inline(F.array(F.struct(F.col("_i").alias("cell"), (1 - part).alias("w")), F.struct((F.col("_i") + 1).alias("cell"), part.alias("w")))))
    held = dealt.groupBy("cell", *facts).agg(F.sum("w").alias("w")).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    place = lambda k, n: F.col("low") + F.col(k) * (F.col("high") - F.col("low")) / n
    kernel = F.exp(-F.pow((place("point", steps) - place("cell", cells)) / F.col("width"), F.lit(2)) / 2)
    found = held.groupBy("point", *facts).agg(F.sum(F.col("w") * kernel).alias("k"))
    return found.select("point", place("point", steps).alias("x"), (F.col("k") / (F.col("all") * F.col("width") * math.sqrt(2 * math.pi))).alias("density"))


def density_error(spread: float, width: float, cells: int = 1_000) -> float:
    """The most by which binned_density() is off, for values that spread so far and kernels so wide: linear weights miss a function by
    an eighth of its second derivative times the square of a cell, and a Gaussian's is largest in its middle."""
    return (spread / cells) ** 2 / 8 / (width**3 * math.sqrt(2 * math.pi))


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """df that counts its rows as they pass, without a pass of its own; the count is in the observation once df has run."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen

"""Departures of station pairs as profiles, and as-of look-ups in them around the clock.

A profile is a row for each (dep, arr, bucket), a bucket being `width` minutes of the day. Of one minute's departures it
holds the shortest, so it has `width` entries at most however many services there are. Two pruned lists answer windows that
end, or begin, outside the bucket: in `later` no entry is beaten by one that leaves at the same time or later and arrives
first, in `sooner` none by one that leaves earlier. A window that begins and ends inside a bucket may exclude the entry that
beats another, so it is answered from `later` where that entry is inside, and from all entries where it is not.

Searches from many origins look departures up as flat rows (`board`, `earliest`) and find the services of a path afterwards (`retraced`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def profile(services: DataFrame, day: int = 1440, width: int | None = None) -> DataFrame:
    """dep, arr, bucket and the entries (c, id, t, arr_t) all, later, sooner. t is the departure from the bucket's start and c that
    of the arrival; of equal arrivals the least id wins. width divides the day; without one the day is one bucket."""
    width = width or day
    if day % width:
        raise ValueError(f"buckets of {width} do not divide {day}")
    each = services.groupBy("dep", "arr", "dep_t").agg(F.min(F.struct("during", "id", "arr_t")).alias("s"))
    at = F.pmod(F.col("dep_t"), F.lit(day))
    entry = F.struct((F.col("t") + F.col("s.during")).alias("c"), F.col("s.id").alias("id"), "t", F.col("s.arr_t").alias("arr_t"))
    rows = each.select("dep", "arr", F.floor(at / width).cast("int").alias("bucket"), (at % width).alias("t"), "s").select("dep", "arr", "bucket", "t", entry.alias("e"))
    beside = Window.partitionBy("dep", "arr", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    key = F.struct("e.c", "e.id")
    rows = rows.withColumns({"_after": F.min(key).over(beside.orderBy(F.desc("t"))), "_before": F.min(key).over(beside.orderBy("t"))})
    keep = lambda other: F.sort_array(F.collect_list(F.when(F.col(other).isNull() | (key < F.col(other)), F.col("e"))))
    return rows.groupBy("dep", "arr", "bucket").agg(F.sort_array(F.collect_list("e")).alias("all"), keep("_after").alias("later"), keep("_before").alias("sooner"))


def windows(labels: DataFrame, low: int | Column, high: int, day: int, closed: bool = False, width: int | None = None) -> DataFrame:
    """labels, a row for each bucket that its window of waits [low, high) or [low, high] touches: bucket, and seg and again, the
    parts of the window there as (from, upto, base), in minutes of the bucket; base + t is the wait for a departure at t.
    again is the part of a window that comes back to its first bucket after a day. low may be a column of the labels."""
    width = width or day
    n, least = day // width, low if isinstance(low, Column) else F.lit(low)
    length = F.least(F.lit(high + closed), F.lit(day)) - least
    rows = labels.withColumns({"_s": F.pmod(F.col("at") + least, F.lit(day)).cast("bigint"), "_n": length.cast("bigint"), "_low": least.cast("bigint")}).where("_n > 0")
    part = lambda k: F.struct(F.greatest(F.col("_s") - k * width, F.lit(0)).alias("from"), F.least(F.col("_s") + F.col("_n") - k * width, F.lit(width)).alias("upto"), (k * width - F.col("_s") + F.col("_low")).alias("base"))
    first, last = F.floor(F.col("_s") / width), F.floor((F.col("_s") + F.col("_n") - 1) / width)
    rows = rows.withColumns({"_k": F.explode(F.sequence(first, F.least(last, first + n - 1))), "_last": last})
    return rows.withColumns({"bucket": (F.col("_k") % n).cast("int"), "seg": part(F.col("_k")), "again": F.when(F.col("_k") + n <= F.col("_last"), part(F.col("_k") + n))}).drop("_s", "_n", "_low", "_k", "_last")


def first_arrival(seg: Column, width: int) -> Column:
    """The entry of a profile's lists that arrives first of those that leave inside the part of a window, null if none does."""
    begin, end = seg["from"], seg["upto"]
    after = F.array_min(F.filter("later", lambda e: e["t"] >= begin))
    inside = F.array_min(F.filter("all", lambda e: (e["t"] >= begin) & (e["t"] < end)))
    before = F.array_min(F.filter("sooner", lambda e: e["t"] < end))
    return F.when(seg.isNull(), F.lit(None)).when(end >= width, after).when(begin <= 0, before).when(after["t"] < end, after).otherwise(inside)


def next_service(labels: DataFrame, profiles: DataFrame, low: int | Column, high: int, day: int = 1440, closed: bool = False, width: int | None = None) -> DataFrame:
    """Labels (origin, station, total, at, legs, path) carried over the admissible service of each profile that arrives first, the wait
    in [low, high) or [low, high], around the clock: one row for each label, pair of stations and bucket at most."""
    width = width or day
    held = profiles.withColumnRenamed("dep", "station")
    near = windows(labels, low, high, day, closed, width).join(held, ["station", "bucket"])
    timed = lambda s: F.transform(F.array_compact(F.array(first_arrival(F.col(s), width))), lambda e: F.struct((F.col("total") + F.col(f"{s}.base") + e["c"]).alias("total"), e["id"].alias("id"), e["arr_t"].alias("at")))
    best = near.select("origin", "arr", "legs", "path", F.array_min(F.concat(timed("seg"), timed("again"))).alias("b")).where("b is not null")
    return best.select("origin", F.col("arr").alias("station"), "b.total", "b.at", (F.col("legs") + 1).alias("legs"), F.concat("path", F.array("b.id")).alias("path"))


def every_service(labels: DataFrame, services: DataFrame, low: int | Column, high: int, day: int = 1440, closed: bool = False, width: int | None = None) -> DataFrame:
    """Labels carried over all admissible services, not the first arrivals only. The join is on station and bucket."""
    width = width or day
    at = F.pmod(F.col("dep_t"), F.lit(day))
    held = services.select("id", F.col("dep").alias("station"), "arr", "arr_t", "during", (at % width).alias("t"), F.floor(at / width).cast("int").alias("bucket"))
    near = windows(labels, low, high, day, closed, width).join(held, ["station", "bucket"])
    fits = lambda s: (F.col("t") >= F.col(f"{s}.from")) & (F.col("t") < F.col(f"{s}.upto"))
    wait = F.when(fits("seg"), F.col("seg.base")).when(F.col("again").isNotNull() & fits("again"), F.col("again.base")) + F.col("t")
    near = near.withColumn("_wait", wait).where("_wait is not null")
    return near.select("origin", F.col("arr").alias("station"), (F.col("total") + F.col("_wait") + F.col("during")).alias("total"), F.col("arr_t").alias("at"), (F.col("legs") + 1).alias("legs"), F.concat("path", F.array("id")).alias("path"))


def board(services: DataFrame, day: int = 1440, width: int | None = None) -> DataFrame:
    """The departures of each station and bucket as flat rows of numbers: station, bucket, arr, dep_t (of the day), during; of one
    minute's departures for a place the shortest."""
    width = width or day
    rows = services.groupBy(F.col("dep").alias("station"), "arr", F.pmod("dep_t", F.lit(day)).alias("dep_t")).agg(F.min("during").alias("during"))
    return rows.withColumn("bucket", F.floor(F.col("dep_t") / width).cast("int"))


def arrivals(services: DataFrame, day: int = 1440) -> DataFrame:
    """The services by where and at what minute of the day they arrive by their departure and ride: arr, minute, id, dep, dep_t, during, arr_t."""
    return services.select("arr", F.pmod(F.col("dep_t") + F.col("during"), F.lit(day)).alias("minute"), "id", "dep", F.pmod("dep_t", F.lit(day)).alias("dep_t"), "during", "arr_t")


def _wait(low: Column, high: int, day: int, closed: bool) -> tuple[Column, Column]:
    """The wait of a label for a departure, and whether it is in [low, high) or [low, high], and below a day."""
    wait = F.pmod(F.col("dep_t") - F.col("at"), F.lit(day))
    return wait, (wait >= low) & (wait < F.least(F.lit(high + closed), F.lit(day)))


def earliest(labels: DataFrame, boards: DataFrame, low: int | Column, high: int, day: int = 1440, closed: bool = False, width: int | None = None) -> DataFrame:
    """The least total at each station that labels (origin, station, total, at, legs, path) reach by one admissible service: origin, station,
    legs, start, total. start is the time of the day at which the totals count from 0.

    Only numbers are carried, so that the least is kept in a hash table where the rows are made, before anything is moved."""
    least = low if isinstance(low, Column) else F.lit(low)
    own = labels.select("origin", "station", "total", "at", "legs", least.alias("low"))
    near = windows(own, F.col("low"), high, day, closed, width).drop("seg", "again").join(boards, ["station", "bucket"])
    wait, fits = _wait(F.col("low"), high, day, closed)
    start = F.pmod(F.col("at") - F.col("total"), F.lit(day))
    moved = near.where(fits).select("origin", F.col("arr").alias("station"), (F.col("legs") + 1).alias("legs"), start.alias("start"), (F.col("total") + wait + F.col("during")).alias("total"))
    return moved.groupBy("origin", "station", "legs", "start").agg(F.min("total").alias("total"))


def retraced(found: DataFrame, labels: DataFrame, by_arrival: DataFrame, low: int | Column, high: int, day: int = 1440, closed: bool = False) -> DataFrame:
    """The rows of earliest() as labels with their paths: for each the services that arrive there at that minute and the labels that catch
    them with that total, all of equal total."""
    least = low if isinstance(low, Column) else F.lit(low)
    goal = found.select("origin", F.col("station").alias("arr"), "start", (F.col("legs") - 1).alias("legs"), F.col("total").alias("goal"), F.pmod(F.col("start") + F.col("total"), F.lit(day)).alias("minute"))
    own = labels.select("origin", F.col("station").alias("dep"), "legs", F.pmod(F.col("at") - F.col("total"), F.lit(day)).alias("start"), "total", "at", "path", least.alias("low"))
    wait, fits = _wait(F.col("low"), high, day, closed)
    ways = goal.join(by_arrival, ["arr", "minute"]).join(own, ["origin", "dep", "legs", "start"]).where(fits & (F.col("total") + wait + F.col("during") == F.col("goal")))
    return ways.select("origin", F.col("arr").alias("station"), F.col("goal").alias("total"), F.col("arr_t").alias("at"), (F.col("legs") + 1).alias("legs"), F.concat("path", F.array("id")).alias("path"))

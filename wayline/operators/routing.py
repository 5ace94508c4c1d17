"""Earliest-arrival routing with transfer rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lineage
from .profiles import arrivals, board, earliest, every_service, retraced


def _best(labels: DataFrame) -> DataFrame:
    """One label for each origin and station: least total, then fewest legs, then the least path."""
    found = labels.groupBy("origin", "station").agg(F.min(F.struct("total", "legs", "path", "at")).alias("b"))
    return found.select("origin", "station", "b.total", "b.at", "b.legs", "b.path")


class _Timetable:
    """A schedule for the layers of a search, made once: departures partitioned by station and bucket and, where paths are
    asked for, services by station and minute of arrival."""

    def __init__(self, services: DataFrame, day: int, width: int | None, paths: bool):
        self.day, self.width, self.none = day, width, _no_path(services)
        self.board = lineage.held(board(services, day, width), "station", "bucket")
        self.arrivals = lineage.held(arrivals(services, day), "arr", "minute") if paths else None

    def moved(self, labels: DataFrame, low: int | Column, high: int, closed: bool) -> DataFrame:
        """The best label of each origin and station after one more service. Without paths the labels of an origin must count from
        one time of the day and rides last as the clocks say (arr_t is dep_t and during, but for whole days); path is then empty and at within the day."""
        first = earliest(labels, self.board, low, high, self.day, closed, self.width)
        if self.arrivals is None:
            at = F.pmod(F.col("start") + F.col("total"), F.lit(self.day))
            return _best(first.select("origin", "station", "total", at.alias("at"), "legs", self.none.alias("path")))
        return _best(retraced(lineage.cut(first), labels, self.arrivals, low, high, self.day, closed))


def _no_path(services: DataFrame) -> Column:
    return F.array().cast(f"array<{services.schema['id'].dataType.simpleString()}>")


def route_layers(services: DataFrame, seeds: DataFrame, hops: int, low: int, high: int, day: int = 1440, closed: bool = False, pareto: bool = True, width: int | None = None, paths: bool = True) -> DataFrame:
    """Labels after 1 to `hops` services from the seeds (origin, station, total, at), the best of each number of
    services; with pareto only those faster than all with fewer services, else the best over all. A layer works on the
    best labels of the layer before, so it finds what a settled search finds; route_bags finds all. A layer is
    checkpointed, so the plan stays short and a lost executor costs one layer. Without paths totals only are found, see _Timetable."""
    known = _Timetable(services, day, width, paths)
    layer = seeds.select("origin", "station", "total", "at", F.lit(0).alias("legs"), known.none.alias("path"))
    found = None
    for _ in range(hops):
        layer = lineage.cut(known.moved(layer, low, high, closed))
        found = layer if found is None else found.unionByName(layer)
    return _faster(found) if pareto else _best(found)


def dominates(a: tuple[int, int], b: tuple[int, int]) -> bool:
    """Is label a = (transfers, total) as good as b in both and better in one?"""
    return a != b and a[0] <= b[0] and a[1] <= b[1]


def route_exact(services: DataFrame, seeds: DataFrame, low: int, high: int, day: int = 1440, most: int = 3, by_transfers: bool = False, width: int | None = None, paths: bool = True) -> DataFrame:
    """What a label-setting search finds that extends settled labels only: origin, station, transfers (services), total, at, path.

    by_transfers: of each number of services, `most` at most, the best label of each station that is faster than all with
    fewer; only such labels are extended. Else one label for each station: the best over the labels of the other stations, with
    `most` services at most. As waits are not first in, first out, a label that a better one replaces may have reached a
    station in less time than the better one does; so each round starts anew from the labels of the round before, until none changes."""
    known = _Timetable(services, day, width, paths)
    first = _best(seeds.select("origin", "station", "total", "at", F.lit(0).alias("legs"), known.none.alias("path")))
    columns = ["origin", "station", "total", "at", "legs", "path"]
    named = lambda df: df.select("origin", "station", F.col("legs").alias("transfers"), "total", "at", F.col("path").cast("array<string>").alias("path"))
    layer = found = lineage.cut(first.select(columns))
    if by_transfers:
        for _ in range(most):
            before = found.groupBy("origin", "station").agg(F.min("total").alias("_least"))
            moved = known.moved(layer, low, high, False).select(columns).join(before, ["origin", "station"], "left")
            layer = lineage.cut(moved.where("_least is null or total < _least").select(columns))
            found = lineage.cut(found.unionByName(layer))
        return named(found)
    while True:
        moved = known.moved(found.where(F.col("legs") < most), low, high, False).select(columns)
        new = lineage.cut(_best(layer.unionByName(moved)).select(columns))
        if new.exceptAll(found).isEmpty() and found.exceptAll(new).isEmpty():
            return named(new)
        found = new


def departures(services: DataFrame, day: int = 1440) -> DataFrame:
    """station and the minutes of the day at which services leave it, `day` at most."""
    return services.groupBy(F.col("dep").alias("station")).agg(F.sort_array(F.collect_set(F.pmod(F.col("dep_t"), F.lit(day)).cast("int"))).alias("minutes"))


def useful(labels: DataFrame, leaving: DataFrame, bag: DataFrame | None, high: int, day: int = 1440, closed: bool = False) -> DataFrame:
    """Of the labels (origin, station, total, at, legs, path, low) those that are the best, by total and services, of those
    that catch some departure from their station; the labels of `bag`, of fewer services, compete and are not returned.

    Of two labels that catch one departure the one with the lower total has it first, if the totals of an origin's labels count
    from one time of the day. So nothing that the others reach is lost. The best label catches all but a few
    departures; only what it misses is compared one by one."""
    both = labels.withColumn("old", F.lit(False))
    if bag is not None:
        both = bag.withColumn("old", F.lit(True)).unionByName(both)
    rank = F.struct("total", "legs", "path", "at", "old")
    first = Window.partitionBy("origin", "station")
    wait = lambda d, at: F.pmod(d - at, F.lit(day))
    caught = lambda d, at: (wait(d, at) >= F.col("low")) & ((wait(d, at) <= high) if closed else (wait(d, at) < high))
    timed = both.withColumn("_b", F.min(rank).over(first)).join(leaving, "station")
    left = timed.withColumn("_mine", F.filter("minutes", lambda d: ~caught(d, F.col("_b.at")) & caught(d, F.col("at"))))
    head = left.where((rank == F.col("_b")) & F.exists("minutes", lambda d: caught(d, F.col("at"))))
    rest = left.select("origin", "station", "low", rank.alias("r"), F.explode("_mine").alias("_d")).groupBy("origin", "station", "low", "_d").agg(F.min("r").alias("r"))
    kept = head.select("origin", "station", "low", rank.alias("r")).union(rest.select("origin", "station", "low", "r")).distinct()
    return kept.where("not r.old").select("origin", "station", "r.total", "r.at", "r.legs", "r.path", "low")


def route_bags(
    services: DataFrame, seeds: DataFrame, hops: int, low: int, high: int, day: int = 1440, closed: bool = False, pareto: bool = True, kinds: DataFrame | None = None,
    prepare: dict[str, int] | None = None, drives: DataFrame | None = None, cap: int | None = None, width: int | None = None, paths: bool = True,
) -> DataFrame:
    """The least total for each origin, station and number of services, 1 to `hops`, over all walks from the seeds, as route_layers
    gives it: with pareto those faster than all with fewer, else the best over all.

    Waits have a lower and an upper bound, so a later label may catch what an earlier one misses: each origin and station
    keeps a bag of labels, one for each time of the day at most, and of these the ones that useful() finds are
    extended. seeds: origin, station, total, at; of one origin, total and at count from one time. kinds and prepare give the least
    wait by the kind of port instead of low. drives (source, target, duration) may be taken after a service, never after a
    drive, to go on by another service. Labels with a total over cap are not extended."""
    columns = ["origin", "station", "total", "at", "legs", "path"]
    ready = (lambda labels: labels.withColumn("low", F.lit(low))) if kinds is None else (lambda labels: _prepared(labels, kinds, prepare or PREPARE))
    by_time = lambda labels: labels.groupBy("origin", "station", "at").agg(F.min(F.struct("total", "legs", "path")).alias("b")).select("origin", "station", "b.total", "at", "b.legs", "b.path")
    held = lineage.cut(services.select("id", "dep", "dep_t", "arr", "arr_t", "during"))
    leaving, last = lineage.cut(departures(held, day)), _Timetable(held, day, width, paths)
    source = seeds.select("origin", "station", "total", F.pmod("at", F.lit(day)).cast("bigint").alias("at"), F.lit(0).alias("legs"), last.none.alias("path"))
    bag = found = None
    for k in range(1, hops + 1):
        source = by_time(source if cap is None else source.where(F.col("total") <= cap))
        extend = lineage.cut(useful(ready(source).select(*columns, "low"), leaving, bag, high, day, closed))
        bag = extend if bag is None else lineage.cut(bag.unionByName(extend))
        if k == hops:
            # Nothing follows: the first arrival of each pair of stations is enough.
            moved = last.moved(extend, F.col("low"), high, closed).select(columns)
        else:
            moved = by_time(every_service(extend, held, F.col("low"), high, day, closed, width)).select(columns)
        moved = lineage.cut(moved.withColumn("at", F.pmod("at", F.lit(day)).cast("bigint")))
        source = moved if drives is None else moved.unionByName(driven(moved, drives, day).select(columns))
        found = _best(moved).select(columns) if found is None else found.unionByName(_best(moved).select(columns))
    if not pareto:
        return _best(found)
    return _faster(found)


def _faster(found: DataFrame) -> DataFrame:
    """Labels that are faster than all of their station with fewer services."""
    before = Window.partitionBy("origin", "station").orderBy("legs").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("_least", F.min("total").over(before)).where("_least is null or total < _least").drop("_least")


def drive_seeds(access: DataFrame, start: int, limit: int, day: int) -> DataFrame:
    """access: origin, station, duration. Stations within a drive below the limit."""
    return access.where(F.col("duration") < limit).select("origin", "station", F.col("duration").alias("total"), F.pmod(F.lit(start) + F.col("duration"), F.lit(day)).alias("at"))


def driven(labels: DataFrame, drives: DataFrame, day: int) -> DataFrame:
    """Labels carried over drives (source, target, duration), not after a drive; path gets 'carDriving'."""
    step = labels.where(F.coalesce(F.try_element_at("path", F.lit(-1)), F.lit("")) != "carDriving").join(drives, F.col("station") == F.col("source"))
    return step.select(
        "origin", F.col("target").alias("station"), (F.col("total") + F.col("duration")).alias("total"), F.pmod(F.col("at") + F.col("duration"), F.lit(day)).alias("at"),
        "legs", F.concat("path", F.array(F.lit("carDriving"))).alias("path"),
    )


#: Minutes to be at a port before a service leaves, by the port's kind; '' is any other.
PREPARE = {"station": 15, "": 60}


def _prepared(labels: DataFrame, kinds: DataFrame, prepare: dict[str, int]) -> DataFrame:
    """labels with `low`, the least wait at their station, by its kind (kinds: station, kind; a station without one counts as '')."""
    least = F.lit(prepare[""])
    for kind, minutes in prepare.items():
        least = F.when(F.col("kind") == kind, minutes).otherwise(least) if kind else least
    return labels.join(kinds.select("station", "kind"), "station", "left").withColumn("low", least).drop("kind")


def route_multimodal(
    services: DataFrame, access: DataFrame, drives: DataFrame, kinds: DataFrame, start: int, hops: int = 3, high: int = 1440, day: int = 1440, limit: int = 120,
    cap: int | None = 1440, prepare: dict[str, int] = PREPARE, closed: bool = False, by_car: bool = False, margin: float = 0.0, pareto: bool = False, width: int | None = None, paths: bool = True,
) -> DataFrame:
    """Routes that begin with a drive and may drive between ports: origin, station, total, at, legs, path.

    access: origin, station, duration: drives from the origins; those below `limit` are taken at the time `start`. drives:
    source, target, duration, taken after a service, never after a drive. A service waits for at least its port's prepare time.
    A label is carried on if it has at most `hops` services, if its total is at most `cap`, and if it beats all labels of
    its station with fewer services by more than `margin`; a driven label counts for the services from its port, and with
    by_car it is a result as well. The result is the best label of each origin and station, or with pareto the best of each
    number of services that is faster than all with fewer. A drive of no length takes no time. Each layer is checkpointed."""
    kind = services.schema["id"].dataType.simpleString()
    columns = ["origin", "station", "total", "at", "legs", "path"]
    # Made once: a layer reads the departures, drives and kinds of ports, not what they come from.
    known, drives, kinds = _Timetable(services, day, width, paths), lineage.cut(drives), lineage.cut(kinds)
    seeds = drive_seeds(access, start, limit, day).select("origin", "station", "total", "at", F.lit(0).alias("legs"), F.array(F.lit("carDriving")).cast(f"array<{kind}>").alias("path"))
    sources, found, reached = _best(seeds), None, None
    for _ in range(hops):
        ready = _prepared(sources if cap is None else sources.where(F.col("total") <= cap), kinds, prepare)
        moved = known.moved(ready, F.col("low"), high, closed).select(columns)
        if reached is not None:
            moved = moved.join(reached, ["origin", "station"], "left").where(F.col("before").isNull() | (F.col("total") < F.col("before") - margin)).select(columns)
        moved = lineage.cut(moved)
        cars = _best(driven(moved, drives, day)).select(columns)
        sources = moved.unionByName(cars)
        layer = sources if by_car else moved
        found = layer if found is None else found.unionByName(layer)
        best = moved.select("origin", "station", F.col("total").alias("before"))
        reached = best if reached is None else lineage.cut(reached.unionByName(best).groupBy("origin", "station").agg(F.min("before").alias("before")))
    if not pareto:
        return _best(found)
    each = found.groupBy("origin", "station", "legs").agg(F.min(F.struct("total", "path", "at")).alias("b")).select("origin", "station", "legs", "b.*")
    return _faster(each).select(columns)


def first_gaps(labels: DataFrame, services: DataFrame, access: DataFrame, kinds: DataFrame, start: int, later: int, day: int = 1440, prepare: dict[str, int] = PREPARE) -> DataFrame:
    """For each label of route_multimodal the minutes from the drive's end to the first service: old_gap at the old start,
    around the clock, gap at `later` minutes later, as the clock shows them, and the prepare time there."""
    first = labels.select("origin", "station", F.get("path", F.lit(1)).alias("id"))
    at = first.join(services.select("id", F.col("dep").alias("port"), "dep_t"), "id").join(access.select("origin", F.col("station").alias("port"), "duration"), ["origin", "port"])
    ready = _prepared(at.select("origin", F.col("port").alias("station"), F.col("station").alias("_to"), "dep_t", "duration"), kinds, prepare)
    arrive = lambda t: F.pmod(F.lit(t) + F.col("duration"), F.lit(day))
    return ready.select("origin", F.col("_to").alias("station"), (F.col("dep_t") - arrive(start + later)).alias("gap"), F.pmod(F.col("dep_t") - arrive(start), F.lit(day)).alias("old_gap"), F.col("low").alias("prepare"))


def replanned(old: DataFrame, first: DataFrame, later: int) -> DataFrame:
    """Plans of a departure `later` minutes after the old one: legs and totals of the old plan stay usable where its
    first train is still caught (gap of `first` is at least its prepare and below the old gap); totals shrink by `later`.
    That holds for a whole plan, so for all stations that are reached over the same first train."""
    ok = (F.col("gap") >= F.col("prepare")) & (F.col("gap") < F.col("old_gap"))
    return old.join(first, ["origin", "station"]).where(ok).withColumn("total", F.col("total") - later).select(*old.columns)


def taken_over(kept: DataFrame, fresh: DataFrame) -> DataFrame:
    """Plans of the new departure: those that were kept, and fresh ones for the other stations; reused tells which."""
    rest = fresh.join(kept.select("origin", "station"), ["origin", "station"], "left_anti")
    return kept.withColumn("reused", F.lit(True)).unionByName(rest.select(kept.columns).withColumn("reused", F.lit(False)))


def scheme_rows(labels: DataFrame) -> DataFrame:
    """A row for each leg of each label, destinations by total time."""
    return labels.select("origin", "station", "total", F.posexplode("path").alias("pos", "service")).orderBy("total", "station", "origin", "pos")


def total_text(total: Column) -> Column:
    """Minutes as HH:MM, hours beyond a day not wrapped."""
    return F.format_string("%02d:%02d", F.floor(total / 60), F.pmod(total, F.lit(60)))


def scheme_tree(schemes: DataFrame) -> DataFrame:
    """Edges between successive stations of schemes (scheme, pos, station)."""
    order = Window.partitionBy("scheme").orderBy("pos")
    return schemes.withColumn("child", F.lead("station").over(order)).where("child is not null").select(F.col("station").alias("parent"), "child").distinct()


def looked_up(pairs: DataFrame, times: DataFrame) -> DataFrame:
    """pairs (source, target) with the answer of a table of ways (source, target, seconds, steps): no steps and -1 seconds
    where it has none, as a route service that fails."""
    last = times.groupBy("source", "target").agg(F.min(F.struct("seconds", "steps")).alias("_w"))
    found = pairs.join(last, ["source", "target"], "left")
    none = F.array().cast(times.schema["steps"].dataType)
    return found.select(*pairs.columns, F.coalesce("_w.seconds", F.lit(-1.0)).alias("seconds"), F.coalesce("_w.steps", none).alias("steps"))

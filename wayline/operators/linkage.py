"""Linking and merging records of the same train.

stops: train, seq, station, arr, dep: UTC HHMM integers, null where missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import timeops as T
from . import lineage

NO_LINK, TOO_FEW = 100_000.0, 10_000.0


def similarity(stops: DataFrame, common: int, exact: int = 0, loose: int = 25, numbers: DataFrame | None = None, among: DataFrame | None = None) -> DataFrame:
    """a, b, score for pairs of trains with a shared station: the mean difference in minutes over the shared stations,
    TOO_FEW if fewer than `common` of them agree, NO_LINK if one of them disagrees, there are too few, or both trains
    have numbers (numbers: train, number) and share none. With `among` (a, b) only for those pairs. A station agrees by arrivals, else by departures, within
    `exact`; else by an arrival and a departure within `loose`, which all together count as one."""
    stops = _timed(stops)
    if among is not None:
        left, right = (stops.select(F.col("train").alias(t), "station", F.col("arr").alias(f"arr{k}"), F.col("dep").alias(f"dep{k}")) for k, t in ((1, "a"), (2, "b")))
        scored = _scores(among.join(left, "a").join(right, ["b", "station"]).withColumn("differ", F.lit(False)), common, exact, loose)
        if numbers is None:
            return scored
        own = _numbers(numbers)
        both = scored.join(own.select(F.col("train").alias("a"), F.col("n").alias("n1")), "a", "left").join(own.select(F.col("train").alias("b"), F.col("n").alias("n2")), "b", "left")
        return both.select("a", "b", F.when(_differ(), NO_LINK).otherwise(F.col("score")).alias("score"))
    # Each stop knows its train's stations and numbers, so a pair that shares one station, served once by both, is scored where
    # it is made; only other pairs are brought together. A train's stations are few, its pairs may be any number.
    rows = stops.where("station is not null").withColumns({"of": F.collect_set("station").over(Window.partitionBy("train")), "times": F.count("*").over(Window.partitionBy("train", "station"))})
    columns = ["arr", "dep", "of", "times"]
    if numbers is not None:
        rows, columns = rows.join(_numbers(numbers), "train", "left"), [*columns, "n"]
    pairs = _meet(rows.select("train", "station", *columns), ["station"], columns).withColumn("differ", F.lit(False) if numbers is None else _differ())
    once = (F.size(F.array_intersect("of1", "of2")) == 1) & (F.col("times1") == 1) & (F.col("times2") == 1)
    alone = _marks(pairs.where(once), exact, loose).withColumn("shared", F.lit(1))
    return _score(alone, common).union(_scores(pairs.where(~once), common, exact, loose))


def _numbers(numbers: DataFrame) -> DataFrame:
    return numbers.distinct().groupBy("train").agg(F.collect_set("number").alias("n"))


def _differ() -> Column:
    """Do both have numbers and share none?"""
    return F.coalesce(~F.arrays_overlap("n1", "n2"), F.lit(False))


def _timed(stops: DataFrame) -> DataFrame:
    """train, station and the minutes of arr and dep, reckoned once for a stop and not for each pair."""
    return stops.select("train", "station", T.to_minutes("arr").alias("arr"), T.to_minutes("dep").alias("dep"))


def _apart(exact: int, loose: int) -> tuple[Column, Column]:
    """Minutes between two stops (arr1, dep1; arr2, dep2, in minutes) by arrivals, else departures, and within `loose` by one of each."""
    off = lambda x, y: F.abs(F.col(x) - F.col(y))
    ad, da = off("arr1", "dep2"), off("dep1", "arr2")
    return F.coalesce(off("arr1", "arr2"), off("dep1", "dep2")), F.when(ad <= loose, ad).when(da <= loose, da)


def _marks(pairs: DataFrame, exact: int, loose: int) -> DataFrame:
    """a, b and what a shared stop (arr1, dep1, arr2, dep2, differ) says of the pair: hits, loose, off, veto."""
    same, near = _apart(exact, loose)
    named = pairs.select("a", "b", "differ", same.alias("same"), near.alias("near"))
    veto = F.coalesce(F.col("same") > exact, F.col("near").isNull()) | F.col("differ")
    return named.select("a", "b", (F.col("same") <= exact).cast("int").alias("hits"), (F.col("same").isNull() & F.col("near").isNotNull()).cast("int").alias("loose"), F.coalesce("same", "near").alias("off"), veto.alias("veto"))


def _scores(pairs: DataFrame, common: int, exact: int, loose: int) -> DataFrame:
    """a, b, score of the shared stops of pairs."""
    gathered = _marks(pairs, exact, loose).groupBy("a", "b").agg(F.count("*").alias("shared"), F.sum("hits").alias("hits"), F.max("loose").alias("loose"), F.sum("off").alias("off"), F.bool_or("veto").alias("veto"))
    return _score(gathered, common)


def _score(found: DataFrame, common: int) -> DataFrame:
    agree = F.coalesce("hits", F.lit(0)) + F.col("loose")
    score = F.when(F.col("veto") | (F.col("shared") < common), NO_LINK).when(agree < common, TOO_FEW).otherwise(F.col("off") / agree)
    return found.select("a", "b", score.alias("score"))


#: Trains of one list that meet in one task.
LIST = 2_000


def _meet(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Pairs a < b of rows (train, keys, columns) with equal keys: a, b, the keys, and each column as of a and of b (name1, name2). A list of
    more than LIST rows is dealt over blocks, each pair of blocks _p, _q being a key of its own; such lists are a LIST-th of the
    rows at most. Both sides are one table, so it is moved once."""
    blocks = rows.groupBy(*keys).agg(F.ceil(F.count("*") / LIST).cast("int").alias("_g")).where("_g > 1")
    many = F.coalesce("_g", F.lit(1))
    dealt = rows.join(F.broadcast(blocks), keys, "left").withColumn("_o", F.pmod(F.xxhash64("train"), many).cast("int")).withColumn("_x", F.explode(F.sequence(F.lit(0), many - 1)))
    side = lambda t, k: dealt.select(*keys, F.least("_o", "_x").alias("_p"), F.greatest("_o", "_x").alias("_q"), F.col("train").alias(t), F.col("_o").alias(f"_o{k}"), *[F.col(c).alias(f"{c}{k}") for c in columns])
    return side("a", 1).join(side("b", 2), [*keys, "_p", "_q"]).where("a < b and (_o1 <> _o2 or _p = _q)")


def _stretches(lists: DataFrame, common: int) -> DataFrame:
    """lists (train, l: an array of structs) with a row for each two elements x before y that can be the first two of `common`
    in the list: all but the last. These are as many as the square of a train's list."""
    head = lists.withColumn("_h", F.slice("l", F.lit(1), F.greatest(F.size("l") - (common - 2), F.lit(0))))
    return head.select(*lists.columns, "_h", F.posexplode("_h").alias("_i", "x")).withColumn("y", F.explode(F.slice("_h", F.col("_i") + 2, F.size("_h")))).drop("_h", "_i")


def sharing(stops: DataFrame, common: int) -> DataFrame:
    """a, b: pairs of trains that have `common` different stations in common; a < b.

    Stations are ordered by how few trains they have. Of two trains with `common` stations in common the first two of these are,
    in either train, among all but the last common - 2 of its stations, so trains meet by two such stations (by one if
    common is 1), and busy stations are seldom among them. Where they meet, their stations are compared."""
    own = lineage.cut(stops.select("train", "station").where("station is not null").distinct())
    if common < 2:
        return _meet(own, ["station"], []).select("a", "b").distinct()
    many = own.groupBy("station").agg(F.count("*").alias("_m"))
    lists = own.join(many, "station").groupBy("train").agg(F.array_sort(F.collect_list(F.struct("_m", "station"))).alias("l")).where(F.size("l") >= common)
    two = lineage.cut(_stretches(lists.select("train", F.col("l.station").alias("l")), common))
    met = _meet(two.select("train", "x", "y", F.col("l").alias("of")), ["x", "y"], ["of"])
    return met.where(F.size(F.array_intersect("of1", "of2")) >= common).select("a", "b").distinct()


def close(stops: DataFrame, common: int, exact: int = 0, loose: int = 25, numbers: DataFrame | None = None) -> DataFrame:
    """The rows of similarity() for pairs of trains with at least `common` different stations in common, found by sharing()."""
    return similarity(stops, common, exact, loose, numbers, lineage.cut(sharing(stops, common)))


def similar(stops: DataFrame, common: int = 1, exact: int = 0, loose: int = 25, numbers: DataFrame | None = None) -> DataFrame:
    """The pairs of similarity() that are scored below TOO_FEW. Only trains that meet within the larger tolerance are compared:
    at two stations, and where `common` is 1 or one of both serves a station more than once, at that station. They are found by
    station and time bucket, so a busy station does not bring all its trains together. common: 1 at least."""
    most = max(exact, loose)
    wide = 4 * (most + 1)
    same, near = _apart(exact, loose)
    agree = ~F.coalesce(same > exact, near.isNull())
    rows = _timed(stops).where("station is not null")
    times = lambda s: F.array_compact(F.array(F.col(f"{s}arr"), F.col(f"{s}dep")))
    spots = lambda s: F.explode(F.array_distinct(F.transform(times(s), lambda t: F.floor(t / wide))))
    reach = lambda s: F.explode(F.array_distinct(F.flatten(F.transform(times(s), lambda t: F.sequence(F.floor((t - most) / wide), F.floor((t + most) / wide))))))
    side = lambda df, t, k, *more: df.select(F.col("train").alias(t), "station", F.col("arr").alias(f"arr{k}"), F.col("dep").alias(f"dep{k}"), *more)
    if common < 2:
        met = side(rows, "a", 1, reach("").alias("_k")).join(side(rows, "b", 2, spots("").alias("_k")), ["station", "_k"]).where("a < b").where(agree).select("a", "b")
    else:
        again = rows.withColumn("_c", F.count("*").over(Window.partitionBy("train", "station"))).where("_c > 1")
        met = side(again, "a", 1, reach("").alias("_k")).join(side(rows, "b", 2, spots("").alias("_k")), ["station", "_k"]).where("a <> b").where(agree).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        # Where no shared stop disagrees, any one stop at each of two shared stations agrees.
        one = rows.groupBy("train", "station").agg(F.min(F.struct("arr", "dep")).alias("t"))
        lists = one.groupBy("train").agg(F.array_sort(F.collect_list(F.struct("station", "t.arr", "t.dep"))).alias("l"))
        two = lineage.cut(_stretches(lists, common).select("train", "x", "y"))
        end = lambda t, k, key: two.select(F.col("train").alias(t), F.col("x.station").alias("sx"), F.col("y.station").alias("sy"), key.alias("_k"), *[F.col(f"{e}.{c}").alias(f"{e}_{c}{k}") for e in "xy" for c in ("arr", "dep")])
        both = end("a", 1, reach("x.")).join(end("b", 2, spots("x.")), ["sx", "sy", "_k"]).where("a < b")
        for e in "xy":
            both = both.withColumns({f"{c}{k}": F.col(f"{e}_{c}{k}") for k in (1, 2) for c in ("arr", "dep")}).where(agree)
        met = met.union(both.select("a", "b"))
    return similarity(stops, common, exact, loose, numbers, lineage.cut(met.distinct())).where(F.col("score") < TOO_FEW)


def possible_links(stops: DataFrame, common: int = 2, exact: int = 0, changed: DataFrame | None = None) -> DataFrame:
    """Pairs with at least `common` shared stations that agree exactly and none that disagrees: a, b, matches; with `changed`
    (train) only those with one of its trains.

    Stops meet by station and time, in buckets of a few times exact + 1 minutes, and the buckets that the tolerance reaches, so that a
    busy station does not bring all its trains together; the stations that disagree are then looked for among the pairs found."""
    minutes = stops.select("train", "station", T.to_minutes("arr").alias("arr"), T.to_minutes("dep").alias("dep"))
    timed = minutes.select("train", "station", "arr", "dep", F.col("arr").isNull().alias("none"))
    if changed is not None:
        timed = timed.join(changed.select("train", F.lit(True).alias("new")).distinct(), "train", "left").withColumn("new", F.coalesce("new", F.lit(False)))
    wide = 4 * (exact + 1)
    met = None
    for c in ("arr", "dep"):
        # What a stop takes along is its time, and for departures, which count only where an arrival is missing, whether it has one.
        more = [*(["none"] if c == "dep" else []), *([] if changed is None else ["new"])]
        side = lambda t, k: timed.where(F.col(c).isNotNull()).select(F.col(c).alias(f"t{k}"), F.col("train").alias(t), "station", *[F.col(m).alias(f"{m}{k}") for m in more])  # noqa: B023, E731
        reach = F.sequence(F.floor((F.col("t1") - exact) / wide), F.floor((F.col("t1") + exact) / wide))
        near = side("a", 1) if changed is None else side("a", 1).where("new1")
        both = near.withColumn("_k", F.explode(reach)).join(side("b", 2).withColumn("_k", F.floor(F.col("t2") / wide)), ["station", "_k"])
        both = both.where("a < b" if changed is None else "a < b or (a > b and not new2)").where(F.abs(F.col("t1") - F.col("t2")) <= exact)
        both = (both if c == "arr" else both.where("none1 or none2")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        met = both if met is None else met.union(both)
    # Written, so that the planner knows how few they are when it looks for the stops of their trains.
    found = lineage.turn(met.groupBy("a", "b").agg(F.count("*").alias("matches")).where(F.col("matches") >= common))
    own = of_trains(minutes, found)
    left, right = (own.select(F.col("train").alias(t), "station", F.col("arr").alias(f"arr{k}"), F.col("dep").alias(f"dep{k}")) for k, t in ((1, "a"), (2, "b")))
    off = F.coalesce(F.abs(F.col("arr1") - F.col("arr2")), F.abs(F.col("dep1") - F.col("dep2")))
    all_ = found.select("a", "b").join(left, "a").join(right, ["b", "station"]).groupBy("a", "b").agg(F.max(off).alias("most")).where(F.col("most") <= exact)
    return found.join(all_, ["a", "b"]).select("a", "b", "matches")


def of_trains(stops: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of trains that are in pairs (a, b)."""
    return stops.join(pairs.select(F.explode(F.array("a", "b")).alias("train")), "train", "left_semi")


def events(stops: DataFrame) -> DataFrame:
    """A row for each valid time: train, station, kind ('a.' or 'd.'), seq, t: HHMM on the train's own clock, 2400 more
    each time it goes back."""
    times = F.filter(F.array(F.struct(F.lit("a.").alias("kind"), F.col("arr").alias("t0")), F.struct(F.lit("d.").alias("kind"), F.col("dep").alias("t0"))), lambda x: x["t0"].isNotNull())
    rows = stops.select("train", "seq", "station", F.inline(times))
    order = Window.partitionBy("train").orderBy("seq", "kind")
    back = F.when(F.col("t0") < F.coalesce(F.lag("t0").over(order), F.lit(0)), 2400).otherwise(0)
    return rows.withColumn("_back", back).withColumn("t", F.col("t0") + F.sum("_back").over(order)).select("train", "seq", "station", "kind", "t")


def running_period(found: DataFrame) -> DataFrame:
    return found.groupBy("train").agg(F.min_by("t", F.struct("seq", "kind")).alias("first"), F.max_by("t", F.struct("seq", "kind")).alias("last"))


def merged(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """Events of each pair (a, b) as one train: the longer record's, ties to b, with the other's at stations and kinds
    that it lacks, moved by a day where a shared event is within 60 minutes of it then. Of events at one time the
    first by station and kind stays."""
    # Both are read several times; of the events only those of trains that are in pairs.
    pairs = lineage.turn(pairs)
    found = lineage.turn(of_trains(found, pairs))
    size = found.groupBy("train").agg(F.count("*").alias("n"))
    of = lambda end: pairs.select("a", "b").join(size.select(F.col("train").alias(end), F.col("n").alias(f"n_{end}")), end)
    roles = of("a").join(of("b"), ["a", "b"]).select("a", "b", F.when(F.col("n_a") > F.col("n_b"), F.col("a")).otherwise(F.col("b")).alias("base"))
    roles = roles.withColumn("other", F.when(F.col("base") == F.col("a"), F.col("b")).otherwise(F.col("a")))
    base = roles.join(found.select(F.col("train").alias("base"), "station", "kind", "t"), "base").select("a", "b", "station", "kind", "t")
    other = roles.join(found.select(F.col("train").alias("other"), "station", "kind", F.col("t").alias("u")), "other").select("a", "b", "station", "kind", "u")
    near = lambda x: F.abs(T.minutes_of(F.col("t")) - T.minutes_of(x)) <= 60
    day = F.when(near(F.col("u")), 0).when(near(F.col("u") + 2400), 2400).when(near(F.col("u") - 2400), -2400)
    shift = base.join(other, ["a", "b", "station", "kind"]).groupBy("a", "b").agg(F.min_by(day, F.struct("station", "kind", "t", "u")).alias("day"))
    more = other.join(base.select("a", "b", "station", "kind"), ["a", "b", "station", "kind"], "left_anti").join(shift, ["a", "b"], "left")
    both = base.union(more.select("a", "b", "station", "kind", F.col("u") + F.coalesce("day", F.lit(0))))
    return both.groupBy("a", "b", "t").agg(F.min(F.struct("station", "kind")).alias("s")).select("a", "b", "s.station", "s.kind", "t")


def as_stops(found: DataFrame) -> DataFrame:
    """Merged events (a, b, station, kind, t) as stops of a, in the order of their first times: train, b, seq, station, arr, dep, on
    the record's own clock; of several times of one kind at a station the last."""
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("t")))
    rows = found.groupBy("a", "b", "station").agg(of("a.").alias("arr"), of("d.").alias("dep"), F.min("t").alias("_t"))
    order = Window.partitionBy("a", "b").orderBy("_t", "station")
    return rows.select(F.col("a").alias("train"), "b", F.row_number().over(order).alias("seq"), "station", "arr", "dep")


def consolidated(stops: DataFrame, places: DataFrame, tables: DataFrame, common: int = 2, exact: int = 0, limit: float = 300.0) -> tuple[DataFrame, DataFrame]:
    """Chains of records as one record each: stops (train, seq, station, arr, dep) and records (train, members, tables, refs).

    tables: train, table, refs (an array of tables that the record refers to). In each round the pairs of possible_links()
    that are each other's best (most matches, then the least a and b) are merged, and accepted if their times rise and no speed
    is over the limit; the merged record, named by its lesser train, drops its own tables from its references and competes
    again. A pair that is not accepted is not tried again until one of the two has changed. It ends when no pair is left: a
    round settles the best pair of all at least. Records, stops and links are checkpointed in each round; links are looked for only
    among records that have changed and the others."""
    kept = lineage.turn(stops.select("train", "seq", "station", "arr", "dep"))
    known = stops.select("train").distinct().join(tables, "train", "left")
    none = F.array().cast("array<string>")
    known = lineage.turn(known.select("train", F.array("train").alias("members"), F.when(F.col("table").isNull(), none).otherwise(F.array(F.col("table").cast("string"))).alias("tables"), F.coalesce(F.col("refs").cast("array<string>"), none).alias("refs")))
    links = lineage.turn(possible_links(kept, common, exact))
    while True:
        key = F.struct((-F.col("matches")).alias("m"), "a", "b")
        ends = links.select(F.explode(F.array("a", "b")).alias("train"), key.alias("k")).groupBy("train").agg(F.min("k").alias("k"))
        best = lineage.turn(ends.groupBy("k").agg(F.count("*").alias("c")).where("c = 2").select("k.a", "k.b"))
        if best.isEmpty():
            return kept, known
        own = kept.join(best.select(F.explode(F.array("a", "b")).alias("train")), "train", "left_semi")
        new = as_stops(merged(events(own), best))
        new = lineage.turn(new)
        clock = new.select("train", "seq", "station", *[F.pmod(c, F.lit(2400)).cast("int").alias(c) for c in ("arr", "dep")])
        timed = new.select("train", "seq", F.inline(F.array(F.struct(F.lit("a.").alias("kind"), F.col("arr").alias("t")), F.struct(F.lit("d.").alias("kind"), F.col("dep").alias("t"))))).where("t is not null")
        good = lineage.turn(best.join(accepted(timed, speeds(clock, places), limit).where("ok").select(F.col("train").alias("a")), "a"))
        gone, stays = good.select(F.explode(F.array("a", "b")).alias("train")), good.select(F.col("a").alias("train"))
        kept = lineage.turn(kept.join(gone, "train", "left_anti").union(clock.join(stays, "train", "left_semi").select(kept.columns)))
        of = lambda end: known.select(F.col("train").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("members", "tables", "refs")])
        both = good.join(of("a"), "a").join(of("b"), "b")
        tables_ = F.array_union("tables_a", "tables_b")
        joined = both.select(F.col("a").alias("train"), F.sort_array(F.array_union("members_a", "members_b")).alias("members"), F.sort_array(tables_).alias("tables"), F.sort_array(open_references(F.col("refs_a"), F.col("refs_b"), tables_)).alias("refs"))
        known = lineage.turn(known.join(gone, "train", "left_anti").union(joined))
        # Links of records that have not changed stay, but for those that were tried; those of changed ones are found anew.
        old = links.join(best, ["a", "b"], "left_anti").join(gone.withColumnRenamed("train", "a"), "a", "left_anti").join(gone.withColumnRenamed("train", "b"), "b", "left_anti")
        links = lineage.turn(old.select("a", "b", "matches").union(possible_links(kept, common, exact, stays)))


def speeds(stops: DataFrame, places: DataFrame) -> DataFrame:
    """km/h between successive stops with known places (station, lon, lat): train, seq, speed; rows without a speed are
    left out. The clock runs from the departure, else the arrival, to the next arrival, else departure."""
    order = Window.partitionBy("train").orderBy("seq")
    now, left = F.coalesce("arr", "dep"), F.coalesce("dep", "arr")
    rows = stops.join(places, "station", "left").withColumns({c: F.lag(e).over(order) for c, e in (("_t", left), ("_lon", F.col("lon")), ("_lat", F.col("lat")))})
    minutes = T.to_minutes(F.when(now < F.col("_t"), now + 2400).otherwise(now)) - T.to_minutes("_t")
    speed = G.speed_kmh(G.distance_km(F.col("_lon"), F.col("_lat"), F.col("lon"), F.col("lat")), minutes)
    return rows.select("train", "seq", speed.alias("speed")).where("speed > 0")


def monotone(found: DataFrame) -> DataFrame:
    """train, ok: does each event come after all before it? found: train, seq, kind, t; the first may be at 0."""
    before = Window.partitionBy("train").orderBy("seq", "kind").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("_late", F.coalesce(F.col("t") > F.max("t").over(before), F.lit(True))).groupBy("train").agg(F.bool_and("_late").alias("ok"))


def accepted(found: DataFrame, fastest: DataFrame, limit: float = 300.0) -> DataFrame:
    """train, ok for merged records: monotone and no faster than the limit (fastest: train, speed; null: no place known)."""
    top = fastest.groupBy("train").agg(F.max("speed").alias("top"))
    return monotone(found).join(top, "train", "left").select("train", (F.col("ok") & F.coalesce(F.col("top") <= limit, F.lit(False))).alias("ok"))


def distinct_records(records: Column) -> Column:
    """Different records of an array of structs."""
    return F.array_distinct(records)


def open_references(refs: Column, others: Column, tables: Column) -> Column:
    """Tables that either record refers to, without those that are merged already."""
    return F.array_except(F.array_union(refs, others), tables)


def from_rows(rows: DataFrame) -> DataFrame:
    """rows: train, station, kind ('a.' or 'd.'), time (HHMM text, '' or 'nan' where missing), row, zone, italic, ref.
    For each train and station: arr, dep in UTC, of repeated ones the last row's, and the tables that rows in italics refer to."""
    valid = rows.where(~F.col("time").isin("", "nan"))
    at = F.struct("row", T.to_utc(F.col("time").cast("int"), F.col("zone")).alias("t"))
    last = lambda kind: F.max(F.when(F.col("kind") == kind, at))["t"]
    refs = F.collect_set(F.when(F.col("italic"), F.regexp_replace(F.col("ref").cast("string"), ",", "")))
    return valid.groupBy("train", "station").agg(last("a.").alias("arr"), last("d.").alias("dep"), refs.alias("refs"))


def local_times(stops: DataFrame) -> DataFrame:
    """Stops as they are shown: arrival and departure in local time (zone: hours), -1 where missing."""
    local = lambda c: F.coalesce(T.to_local(F.col(c), F.col("zone")), F.lit(-1))
    return stops.withColumns({"arrival": local("arr"), "departure": local("dep")})


def sources(pairs: DataFrame, stops: DataFrame, tables: DataFrame) -> DataFrame:
    """Where each station of a merged pair (a, b) comes from: a, b, station, table_from: 'both', or the table of the one
    record that has it. tables: train, table; a stop that says itself where it comes from (table_from) keeps that."""
    own = stops.select("train", "station", F.col("table_from") if "table_from" in stops.columns else F.lit(None).cast("string").alias("table_from"))
    own = own.join(tables, "train", "left").groupBy("train", "station").agg(F.min(F.coalesce("table_from", "table")).alias("t"))
    side = lambda end: pairs.join(own.select(F.col("train").alias(end), "station", F.col("t").alias(f"t_{end}")), end).select("a", "b", "station", f"t_{end}", F.lit(True).alias(f"in_{end}"))
    both = side("a").join(side("b"), ["a", "b", "station"], "full")
    return both.select("a", "b", "station", F.when(F.col("in_a") & F.col("in_b"), "both").otherwise(F.coalesce("t_a", "t_b")).alias("table_from"))

"""From stop sequences to services between stations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import timeops as T


def last_runs(stops: DataFrame, train: str = "train", row: str = "row") -> DataFrame:
    """Rows of the last unbroken run of each train, by row number; runs are told apart within a train, so that
    no window over all rows is needed. Adds seq, from 0."""
    own = Window.partitionBy(train).orderBy(row)
    runs = stops.withColumn("_run", F.col(row) - F.row_number().over(own))
    last = runs.withColumn("_last", F.max("_run").over(Window.partitionBy(train))).where("_run = _last")
    return last.withColumn("seq", (F.row_number().over(own) - 1).cast("int")).drop("_run", "_last")


def _clocks(stops: DataFrame) -> DataFrame:
    """A row for each stop that has a time: its first and last one (t0, t1) and the minutes on the train's own clock then
    (clock0, clock1); times that are earlier than the one before are on the next day. Sorted once, by train and seq."""
    order = Window.partitionBy("train").orderBy("seq")
    rows = stops.select("train", "seq", "station", F.coalesce("arr", "dep").alias("t0"), F.coalesce("dep", "arr").alias("t1")).where("t0 is not null")
    stay = F.pmod(F.col("t1") - F.col("t0"), F.lit(1440))
    step = F.coalesce(F.pmod(F.col("t0") - F.lag("t1").over(order), F.lit(1440)), F.lit(0))
    return rows.withColumn("_step", step).withColumn("clock1", F.sum(F.col("_step") + stay).over(order)).withColumn("clock0", F.col("clock1") - stay).drop("_step")


def services(stops: DataFrame, mode: str = "all") -> DataFrame:
    """stops: train, seq, station, arr, dep (minutes of the day, null: none). For each train and ordered pair of
    different stations it serves: depart, arrive (minutes of the day) and travel_time; mode 'direct' takes only the
    next stop of another name. Of several pairs of the same names the last one counts."""
    clock = _clocks(stops)
    own = ["train", F.col("seq").alias("seq_a"), F.col("station").alias("depart_station"), F.col("t1").alias("depart"), F.col("clock1").alias("clock_a")]
    to = {"seq_b": "seq", "arrive_station": "station", "arrive": "t0", "clock_b": "clock0"}
    if mode == "direct":
        # Of stops of one name in a row the last has the same next stop as the others, and is the one that counts.
        order = Window.partitionBy("train").orderBy("seq")
        pairs = clock.where("station is not null").select(*own, *[F.lead(c).over(order).alias(n) for n, c in to.items()])
    else:
        pairs = clock.select(*own).join(clock.select("train", *[F.col(c).alias(n) for n, c in to.items()]), "train").where("seq_a < seq_b")
    ride = F.col("clock_b") - F.col("clock_a")
    best = pairs.where("depart_station <> arrive_station").groupBy("train", "depart_station", "arrive_station").agg(F.max(F.struct("seq_a", "seq_b", "depart", "arrive", ride.alias("travel_time"))).alias("s"))
    return best.select("train", "depart_station", "arrive_station", "s.depart", "s.arrive", "s.travel_time")


def service_rows(found: DataFrame, kind: str = "train") -> DataFrame:
    """The eight columns of a service table; ids are numbered within a train, so no window spans all trains."""
    number = F.row_number().over(Window.partitionBy("train").orderBy("depart_station", "arrive_station"))
    return found.select(
        F.concat(F.lit(kind[0]), F.col("train").cast("string"), F.lit("_"), (number - 1).cast("string")).alias("id"), "depart_station", "arrive_station",
        T.wrapped_clock("depart").alias("depart"), T.wrapped_clock("arrive").alias("arrive"), F.col("train").cast("string").alias("train_code"), "travel_time", F.lit(kind).alias("type"),
    )


def station_graph(stops: DataFrame, mode: str = "all") -> DataFrame:
    """Undirected pairs of different stations that a train serves both, a row for each such train: no station's trains are
    gathered."""
    if mode == "direct":
        order = Window.partitionBy("train").orderBy("seq")
        pairs = stops.withColumn("other", F.lead("station").over(order)).where("station <> other")
    else:
        # Pairs of different rows are different, so nothing is left to be told apart.
        own = stops.select("train", "station").distinct()
        return own.join(own.select("train", F.col("station").alias("other")), "train").where("station < other").select(F.col("station").alias("a"), F.col("other").alias("b"), "train")
    return pairs.select(F.least("station", "other").alias("a"), F.greatest("station", "other").alias("b"), "train").distinct()


def trains_of_stations(stops: DataFrame) -> DataFrame:
    """A row for each station and train that serves it."""
    return stops.select("station", "train").distinct()


def leg_services(legs: DataFrame, mode: str = "all") -> DataFrame:
    """legs: code, seq, dep, dep_t, arr, arr_t, info ('A->B'; times in seconds). Services over one leg, or over
    every stretch of legs; a stretch of several legs that comes back to its start is left out. The last one of
    (dep, arr, code) counts."""
    a = legs.select("code", F.col("seq").alias("i"), "dep", "dep_t", F.col("info").alias("first"))
    b = legs.select("code", F.col("seq").alias("j"), "arr", "arr_t", F.col("info").alias("last"))
    meet = F.col("i") == F.col("j") if mode == "direct" else F.col("i") <= F.col("j")
    pairs = a.join(b, "code").where(meet & ~((F.col("j") > F.col("i")) & (F.col("dep") == F.col("arr"))))
    last = pairs.groupBy("code", "dep", "arr").agg(F.max(F.struct("i", "j", "dep_t", "arr_t", "first", "last")).alias("s"))
    return last.select(
        "code", "dep", T.of_day("s.dep_t").alias("dep_t"), "arr", T.of_day("s.arr_t").alias("arr_t"), T.ride("s.dep_t", "s.arr_t").alias("during"),
        F.concat("code", F.lit(":"), F.split_part("s.first", F.lit("->"), F.lit(1)), F.lit("->"), F.split_part("s.last", F.lit("->"), F.lit(2))).alias("describe"),
    )


def flight_legs(flights: DataFrame) -> DataFrame:
    """Services of flight rows as a file has them (source, depTime_s, target, arrTime_s, flightNumber, info): id, dep,
    dep_t, arr, arr_t (seconds of the day), during (as the times say, not wrapped), describe 'flightNumber:info'; the id
    is what stands before the first ':'. Of rows with one (source, target, id) the last by times counts."""
    describe = F.concat_ws(":", "flightNumber", "info")
    # The id tells most rows apart, so it comes first where rows are sorted for the maximum of a text.
    rows = flights.groupBy(F.split_part(describe, F.lit(":"), F.lit(1)).alias("id"), "source", "target").agg(F.max(F.struct("depTime_s", "arrTime_s", describe.alias("describe"))).alias("s"))
    return rows.select("id", F.col("source").alias("dep"), T.of_day("s.depTime_s").alias("dep_t"), F.col("target").alias("arr"), T.of_day("s.arrTime_s").alias("arr_t"), (F.col("s.arrTime_s") - F.col("s.depTime_s")).alias("during"), "s.describe")


def flight_services(flights: DataFrame) -> DataFrame:
    """A service for each flight row: flight, source, target, depart, arrive (HH:MM texts)."""
    return flights.select("flight", "source", "target", "depart", "arrive", T.gap_minutes("depart", "arrive").alias("travel_time"))


def scheme_minutes(legs: DataFrame, key: str = "scheme") -> DataFrame:
    """Minutes of each scheme: rides and the waits between them, around the clock. legs: key, pos, depart, arrive, during."""
    order = Window.partitionBy(key).orderBy("pos")
    wait = F.coalesce(F.pmod(F.col("depart") - F.lag("arrive").over(order), F.lit(1440)), F.lit(0))
    return legs.withColumn("_wait", wait).groupBy(key).agg(F.sum(F.col("during") + F.col("_wait")).alias("minutes"))


def of_train(stops: DataFrame, train) -> DataFrame:
    """The rows of one train."""
    return stops.where(F.col("train") == train)


def train_list(stops: DataFrame, train: str = "train") -> DataFrame:
    return stops.select(train).distinct()


def station_list(stops: DataFrame) -> DataFrame:
    return stops.select("station").distinct()


def station_distances(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """pairs (a, b) with km between their places (station, lon, lat), -1 where one of them is unknown."""
    at = lambda end: places.select(F.col("station").alias(end), F.struct("lon", "lat").alias(f"_{end}"))
    found = pairs.join(at("a"), "a", "left").join(at("b"), "b", "left")
    km = G.distance_km(F.col("_a.lon"), F.col("_a.lat"), F.col("_b.lon"), F.col("_b.lat"))
    return found.withColumn("km", F.coalesce(km, F.lit(-1.0))).drop("_a", "_b")


def train_points(stops: DataFrame, places: DataFrame) -> DataFrame:
    """Different places of the stops."""
    return stops.select("station").distinct().join(places, "station").select("lon", "lat").distinct()


def train_lines(stops: DataFrame, places: DataFrame) -> DataFrame:
    """train and line: places of its stops in order; stops without a place are left out."""
    found = stops.select("train", "seq", "station").join(places, "station")
    line = F.array_sort(F.collect_list(F.struct("seq", "lon", "lat")))
    return found.groupBy("train").agg(F.transform(line, lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("line"))

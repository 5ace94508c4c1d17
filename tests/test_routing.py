"""Profiles and bags of labels against plain enumerations of services and of walks."""

import random

import pytest
from pyspark.sql import functions as F

from wayline.operators import profiles, routing

DAY = 60
SCHEMA = "id string, dep bigint, dep_t bigint, arr bigint, arr_t bigint, during bigint"
SEEDS = "origin bigint, station bigint, total bigint, at bigint"


def schedule(n, stations, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        dep, arr, t, during = rng.randrange(stations), rng.randrange(stations), rng.randrange(DAY), rng.randint(1, 45)
        rows.append((f"s{i:03}", dep, t, arr, (t + during) % DAY, during))
    return rows


def admissible(service, at, low, high, closed=False):
    wait = (service[2] - at) % DAY
    return wait if low <= wait and (wait <= high if closed else wait < high) else None


@pytest.mark.parametrize("width", [60, 20, 5])
@pytest.mark.parametrize("low,high,closed", [(0, 60, False), (7, 60, False), (5, 25, True), (3, 4, False), (10, 10, False)])
def test_look_ups_equal_a_scan_of_all_departures(spark, width, low, high, closed):
    services = schedule(150, 4, 9)
    labels = [(o, o % 4, 100 + o, (o * 13) % DAY) for o in range(40)]
    p = profiles.profile(spark.createDataFrame(services, SCHEMA), DAY, width)
    frame = spark.createDataFrame(labels, SEEDS).selectExpr("*", "0 as legs", "array('x') as path")
    got = profiles.next_service(frame, p, low, high, DAY, closed, width).collect()
    best = {}
    for r in got:
        best[r.origin, r.station] = min(best.get((r.origin, r.station), (10**9,)), (r.total, r.path[1], r.at))
    want, buckets = {}, {}
    for o, station, total, at in labels:
        for s in services:
            wait = admissible(s, at, low, high, closed)
            if s[1] == station and wait is not None:
                want[o, s[3]] = min(want.get((o, s[3]), (10**9,)), (total + wait + s[5], s[0], s[4]))
                buckets.setdefault((o, s[3]), set()).add(s[2] // width)
    assert best == want
    # One row for each label, pair and bucket that holds an admissible service.
    assert len(got) == sum(map(len, buckets.values()))
    every = profiles.every_service(frame, spark.createDataFrame(services, SCHEMA), low, high, DAY, closed, width).collect()
    assert sorted((r.origin, r.path[1], r.total) for r in every) == sorted((o, s[0], total + admissible(s, at, low, high, closed) + s[5]) for o, station, total, at in labels for s in services if s[1] == station and admissible(s, at, low, high, closed) is not None)


def test_a_profile_is_as_long_as_its_bucket(spark):
    services = [(f"s{i:04}", 1, i % 60, 2, (i % 60 + 5 + i % 7) % 60, 5 + i % 7) for i in range(3000)]
    (row,) = profiles.profile(spark.createDataFrame(services, SCHEMA), DAY).collect()
    assert len(row["all"]) == 60 and len(row.later) <= 60 and len(row.sooner) <= 60
    with pytest.raises(ValueError, match="do not divide"):
        profiles.profile(spark.createDataFrame(services, SCHEMA), DAY, 7)


def walks(services, seeds, hops, low, high, closed=False, drives=(), cap=None):
    """The least total by origin, station and number of services, over every walk."""
    found, front = {}, {(o, s, t, at, False) for o, s, t, at in seeds}
    for k in range(1, hops + 1):
        new = set()
        for o, station, total, at, _ in front:
            if cap is not None and total > cap:
                continue
            for s in services:
                wait = admissible(s, at, low(station) if callable(low) else low, high, closed)
                if s[1] == station and wait is not None:
                    new.add((o, s[3], total + wait + s[5], s[4], False))
        for o, station, total, _, _ in new:
            found[o, station, k] = min(found.get((o, station, k), 10**9), total)
        front = new | {(o, d[1], t + d[2], (at + d[2]) % DAY, True) for o, s, t, at, _ in new for d in drives if d[0] == s}
    best = {}
    for (o, s, k), total in sorted(found.items(), key=lambda x: x[0][2]):
        if total < min((best[x] for x in best if x[:2] == (o, s)), default=10**9):
            best[o, s, k] = total
    return best


@pytest.mark.parametrize("hops,low,high,closed,seed", [(2, 10, 30, False, 1), (3, 10, 60, False, 2), (4, 8, 20, True, 3), (4, 25, 40, False, 4)])
def test_bags_equal_all_walks(spark, hops, low, high, closed, seed):
    services = schedule(60, 9, seed)
    seeds = [(1, 0, 0, 8), (1, 1, 12, 20), (2, 5, 3, 33)]
    got = routing.route_bags(spark.createDataFrame(services, SCHEMA), spark.createDataFrame(seeds, SEEDS), hops, low, high, DAY, closed, width=20).collect()
    assert {(r.origin, r.station, r.legs): r.total for r in got} == walks(services, seeds, hops, low, high, closed)
    # A path's services are in time and lead to the label's station.
    by = {s[0]: s for s in services}
    for r in got:
        assert len(r.path) == r.legs and by[r.path[-1]][3] == r.station


def test_bags_with_drives_kinds_and_a_cap(spark):
    services, drives = schedule(50, 8, 6), [(0, 1, 4), (2, 3, 7), (3, 3, 9), (5, 0, 0), (6, 2, 11)]
    seeds, kinds = [(1, 0, 0, 8), (2, 5, 3, 33)], [(s, "station" if s % 2 else "airport") for s in range(7)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = routing.route_bags(frame(services, SCHEMA), frame(seeds, SEEDS), 3, 0, 45, DAY, kinds=frame(kinds, "station bigint, kind string"), prepare={"station": 6, "": 15}, drives=frame(drives, "source bigint, target bigint, duration bigint"), cap=90).collect()
    want = walks(services, seeds, 3, lambda s: 6 if s % 2 and s < 7 else 15, 45, drives=drives, cap=90)
    assert {(r.origin, r.station, r.legs): r.total for r in got} == want


def test_a_later_label_catches_what_the_best_one_misses(spark):
    services = spark.createDataFrame([("a", 1, 500, 2, 580, 80), ("b", 1, 520, 2, 600, 80), ("c", 2, 612, 3, 700, 88)], SCHEMA)
    seeds = spark.createDataFrame([(1, 1, 0, 480)], SEEDS)
    got = routing.route_bags(services, seeds, 2, 10, 30).where("station = 3").collect()
    assert [] == got  # the first service leaves within 20 minutes, the second after 40
    got = routing.route_bags(services, seeds, 2, 10, 41).where("station = 3").collect()
    assert [(r.total, r.path) for r in got] == [(220, ["a", "c"])]
    later = services.withColumn("during", F.when(F.col("id") == "a", F.col("during") - 20).otherwise(F.col("during"))).withColumn("arr_t", F.when(F.col("id") == "a", F.lit(560)).otherwise(F.col("arr_t")))
    got = routing.route_bags(later, seeds, 2, 10, 41).where("station = 3").collect()
    assert [(r.total, r.path) for r in got] == [(220, ["b", "c"])]
    assert routing.route_layers(later, seeds, 2, 10, 41).where("station = 3").count() == 0


def settled(services, seeds, low, high, most):
    """Label setting from one origin, one label for each station."""
    open_, done = [(t, 0, (), s, at) for _, s, t, at in seeds], {}
    while open_:
        open_.sort(key=lambda x: x[:3])
        total, legs, path, station, at = open_.pop(0)
        if station in done:
            continue
        done[station] = (legs, total)
        for s in services if legs < most else ():
            wait = admissible(s, at, low, high)
            if s[1] == station and wait is not None:
                open_.append((total + wait + s[5], legs + 1, (*path, s[0]), s[3], s[4]))
    return done


@pytest.mark.parametrize("seed", [1, 2])
def test_settled_labels_equal_a_queue(spark, seed):
    services, seeds = schedule(45, 9, seed), [(1, 0, 0, 8), (1, 1, 12, 20)]
    got = routing.route_exact(spark.createDataFrame(services, SCHEMA), spark.createDataFrame(seeds, SEEDS), 10, 30, DAY, 3).collect()
    assert {r.station: (r.transfers, r.total) for r in got} == settled(services, seeds, 10, 30, 3)


def test_no_services_and_no_seeds(spark):
    none, seeds = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, 0, 0, 8)], SEEDS)
    assert routing.route_bags(none, seeds, 2, 0, 60, DAY).count() == 0
    assert routing.route_bags(spark.createDataFrame(schedule(9, 3, 1), SCHEMA), seeds.limit(0), 2, 0, 60, DAY).count() == 0


@pytest.mark.parametrize("width", [60, 20])
@pytest.mark.parametrize("low,high,closed", [(7, 60, False), (5, 25, True)])
def test_flat_look_ups_with_their_paths_equal_the_profiles(spark, width, low, high, closed):
    """Many origins at few stations and minutes, so that totals tie and the least path decides; two origins count from several times."""
    services = spark.createDataFrame(schedule(200, 5, 3), SCHEMA)
    labels = spark.createDataFrame([(o % 3, o % 5, 2 * (o % 7), (2 * (o % 7) + (o if o % 3 == 2 else 8)) % DAY) for o in range(40)], SEEDS).selectExpr("*", "0 as legs", "array(cast(at as string)) as path")
    found = profiles.earliest(labels, profiles.board(services, DAY, width), low, high, DAY, closed, width)
    got = routing._best(profiles.retraced(found, labels, profiles.arrivals(services, DAY), low, high, DAY, closed))
    want = routing._best(profiles.next_service(labels, profiles.profile(services, DAY, width), low, high, DAY, closed, width))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    # The least is kept in a hash table of numbers: nothing is sorted for it.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[origin" in plan and "SortAggregate" not in plan


def test_totals_without_paths_equal_those_with_paths(spark):
    services, seeds = spark.createDataFrame(schedule(60, 9, 2), SCHEMA), spark.createDataFrame([(1, 0, 0, 8), (1, 1, 12, 20), (2, 5, 3, 33)], SEEDS)
    rows = lambda **k: sorted((r.origin, r.station, r.legs, r.total, r.at) for r in routing.route_layers(services, seeds, 3, 10, 60, DAY, **k).collect())
    assert rows() == rows(paths=False) != []

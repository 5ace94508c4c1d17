"""Trains by common stations against every pair of trains."""

import random

import pytest

from wayline.operators import linkage

STOPS = "train int, seq int, station int, arr int, dep int"


@pytest.mark.parametrize("common,block", [(1, 2_000), (2, 3), (4, 2_000)])
def test_pairs_that_share_stations(spark, monkeypatch, common, block):
    monkeypatch.setattr(linkage, "LIST", block)
    rng = random.Random(common)
    rows = []
    for train in range(60):
        for seq in range(rng.randint(1, 8)):
            station = rng.choice([0, 0, 1, rng.randint(0, 25)])
            time = rng.choice([None, 800 + station, 805 + station])
            rows.append((train, seq, station, time, time if rng.random() < 0.7 else None))
    rows.append((99, 0, None, 800, 800))
    stops = spark.createDataFrame(rows, STOPS)
    own = {}
    for train, _, station, _, _ in rows:
        if station is not None:
            own.setdefault(train, set()).add(station)
    enough = {(a, b) for a in own for b in own if a < b and len(own[a] & own[b]) >= common}
    assert enough <= {(r.a, r.b) for r in linkage.sharing(stops, common).collect()}
    whole = {(r.a, r.b): r.score for r in linkage.similarity(stops, common, 5, 25).collect()}
    got = {(r.a, r.b): r.score for r in linkage.close(stops, common, 5, 25).collect()}
    assert got == {p: whole[p] for p in enough}


def test_a_busy_station_is_not_indexed_by_trains_with_rarer_ones(spark):
    rows = [(t, 0, 0, 800, 800) for t in range(40)] + [(t, 1, 1 + t // 2, 900, 900) for t in range(40)]
    pairs = {(r.a, r.b) for r in linkage.sharing(spark.createDataFrame(rows, STOPS), 2).collect()}
    assert pairs == {(t, t + 1) for t in range(0, 40, 2)}


def minutes(t):
    return t // 100 * 60 + t % 100


def chains(records, common, fast):
    """The same order as a plain loop: records {train: [(seq, station, arr, dep)]}; a merged pair takes the lesser name. fast tells
    whether a merged record is too fast."""
    records, members, tried = dict(records), {t: [t] for t in records}, set()

    def matches(x, y):
        n = 0
        for _, s, a, d in records[x]:
            for _, s2, a2, d2 in records[y]:
                if s == s2:
                    if (a, d) != (a2, d2):
                        return 0
                    n += 1
        return n

    while True:
        links = [(-matches(a, b), a, b) for a in records for b in records if a < b and (a, b) not in tried]
        links = [k for k in links if -k[0] >= common]
        best = [k for k in links if k == min(x for x in links if k[1] in x[1:]) and k == min(x for x in links if k[2] in x[1:])]
        if not best:
            return records, members
        for _, a, b in best:
            base, other = (a, b) if len(records[a]) > len(records[b]) else (b, a)
            rows = {s: (x, y) for _, s, x, y in records[other]} | {s: (x, y) for _, s, x, y in records[base]}
            order = sorted(rows.items(), key=lambda r: (r[1][0], r[0]))
            times = [t for _, xy in order for t in xy]
            if any(t >= u for t, u in zip(times, times[1:])) or fast(order):
                tried.add((a, b))
                continue
            records[a] = [(i, s, x, y) for i, (s, (x, y)) in enumerate(order)]
            members[a] = sorted(members[a] + members[b])
            del records[b], members[b]
            tried = {p for p in tried if a not in p and b not in p}


def test_chains_equal_a_plain_loop(spark):
    rng = random.Random(4)
    records = {}
    for line in range(6):
        stations = [100 * line + k for k in range(7)]
        clock = {s: 600 + 30 * k for k, s in enumerate(stations)}
        clock[stations[5]] += 25 if line % 2 else 0
        for k in range(rng.randint(3, 5)):
            own = stations[k : k + 3]
            records[10 * line + k] = [(i, s, minutes_to(clock[s]), minutes_to(clock[s] + 2)) for i, s in enumerate(own)]
    # A record that agrees with a line at two stations, and has a stop while the line stands at another.
    records[95] = [(0, 900, minutes_to(661), minutes_to(680)), (1, 3, minutes_to(690), minutes_to(692)), (2, 4, minutes_to(720), minutes_to(722))]
    far = {s: (s % 100) * 0.1 + (4.0 if s % 100 == 6 and s // 100 == 2 else 0.0) for r in records.values() for _, s, _, _ in r}

    def fast(order):
        for (s, (_, d)), (s2, (a, _)) in zip(order, order[1:]):
            if abs(far[s2] - far[s]) * 111.19 / ((minutes(a) - minutes(d)) / 60) > 300:
                return True
        return False

    want, members = chains(records, 2, fast)
    stops = spark.createDataFrame([(t, *r) for t, own in records.items() for r in own], STOPS)
    places = spark.createDataFrame([(s, x, 0.0) for s, x in far.items()], "station int, lon double, lat double")
    tables = spark.createDataFrame([(t, f"T{t}", [f"T{t + 1}", "X"]) for t in records], "train int, table string, refs array<string>")
    kept, known = linkage.consolidated(stops, places, tables, 2, 0)
    got = {}
    for r in kept.collect():
        got.setdefault(r.train, []).append((r.seq, r.station, r.arr, r.dep))
    assert {t: [x[1:] for x in sorted(rows)] for t, rows in got.items()} == {t: [x[1:] for x in rows] for t, rows in want.items()}
    assert 6 < len(want) < len(records)
    for r in known.collect():
        assert r.members == members[r.train] and r.tables == sorted(f"T{m}" for m in r.members)
        open_ = {f"T{m + 1}" for m in r.members} | {"X"}
        assert set(r.refs) == (open_ - set(r.tables) if len(r.members) > 1 else open_)


def minutes_to(m):
    return m // 60 * 100 + m % 60


def exchanges(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_pairs_of_one_station_are_scored_where_they_meet(spark):
    """With numbers, no exchange by a or by b alone follows the pairs, and trains that repeat a station count each stop."""
    rows = [(t, q, s, 800 + t % 3, None) for t in range(12) for q, s in enumerate([t % 2, 5, 5] if t % 4 == 0 else [t % 2])]
    stops = spark.createDataFrame(rows, STOPS)
    numbers = spark.createDataFrame([(t, t % 2) for t in range(9)], "train int, number int")
    found = linkage.similarity(stops, 1, 5, 25, numbers)
    keys = [line.partition("hashpartitioning(")[2].partition(",")[0].partition("#")[0] for line in exchanges(found)]
    assert sum(k in ("a", "b") for k in keys) <= 1
    shared = {(t, u): [(x, y) for i, _, s, x, _ in rows if i == t for j, _, r, y, _ in rows if j == u and r == s] for t in range(12) for u in range(t + 1, 12)}
    want = {p: linkage.NO_LINK if p[0] < 9 and p[1] < 9 and p[0] % 2 != p[1] % 2 else sum(abs(x - y) for x, y in z) / len(z) for p, z in shared.items() if z}
    assert {(r.a, r.b): r.score for r in found.collect()} == want


def test_trains_of_two_busy_stations_meet_by_both(spark):
    """All trains serve stations 0 and 1, but three each have a third one in common: only these are pairs."""
    rows = [(t, q, s, 800, 800) for t in range(30) for q, s in enumerate((0, 1, 2 + t // 3, 50 + t))]
    assert {(r.a, r.b) for r in linkage.sharing(spark.createDataFrame(rows, STOPS), 3).collect()} == {(a, b) for a in range(30) for b in range(a + 1, 30) if a // 3 == b // 3}


def test_similar_equals_all_pairs(spark):
    rng = random.Random(8)
    rows = [(t, q, rng.choice([0, 1, 2]), rng.choice([None, 800, 803, 807, 815]), rng.choice([None, 802, 809])) for t in range(60) for q in range(rng.randint(1, 3))]
    stops = spark.createDataFrame(rows, STOPS)
    for common in (1, 2):
        whole = {(r.a, r.b): r.score for r in linkage.similarity(stops, common, 5, 9).collect() if r.score < linkage.TOO_FEW}
        assert {(r.a, r.b): r.score for r in linkage.similar(stops, common, 5, 9).collect()} == whole and whole

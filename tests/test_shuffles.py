"""How often the rows of large tables are moved."""

import os

import pytest

from wayline.operators import lineage, linkage, timetable
from wayline.plans import catalogue, details, exchange  # noqa: F401
from wayline.plans import views as V
from wayline.sources import sinks

DATA = "/root/testdata/sf0.001"


def moved(df):
    """Shuffles of the plan as it is before it runs."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the supplied tables are not here")
@pytest.mark.parametrize("name,most", [("od_services_direct", 1), ("service_table", 1), ("station_graph", 2), ("station_graph_direct", 2)])
def test_what_follows_within_a_train_is_shuffled_once(spark, name, most):
    """station_graph reads its stops on both sides; station_graph_direct counts by pairs in the end."""
    assert moved(catalogue.QUERIES[name](spark, DATA)) == most


def test_partitions_of_trains_follow_the_rows(spark):
    rows = spark.range(3 * V.PART // 100).selectExpr("explode(sequence(1, 600)) as l_linenumber", "id as l_orderkey")
    assert V.by_train(rows).rdd.getNumPartitions() == 18


def test_stops_without_a_name_or_a_time_lie_between_services(spark):
    """A stop without a name keeps the clock going, one without a time does not count."""
    stops = [(1, 1, 5, 10, 20), (1, 2, None, 1430, 1435), (1, 3, 7, None, None), (1, 4, 5, 5, 6), (1, 5, 8, 30, None)]
    frame = spark.createDataFrame(stops, "train long, seq int, station long, arr long, dep long")
    direct = [tuple(r) for r in timetable.services(frame, "direct").collect()]
    assert direct == [(1, 5, 8, 6, 30, 24)]
    assert sorted(tuple(r) for r in timetable.services(frame).collect()) == direct
    stops[3] = (1, 4, 6, 5, 6)
    frame = spark.createDataFrame(stops, frame.schema)
    assert sorted(tuple(r) for r in timetable.services(frame, "direct").collect()) == [(1, 5, 6, 20, 5, 1425), (1, 6, 8, 6, 30, 24)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the supplied tables are not here")
def test_stops_take_along_only_what_they_keep(spark):
    for view in (V.stops, V.records):
        assert "l_shipdate" not in view(spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_trains_without_a_link_are_not_written(spark, monkeypatch):
    """Trains 1 and 2 are linked; 100 others pass other stations, and 3 shares two with 1 but disagrees at one of them."""
    rows = [(1, 1, 1, 100, 110), (1, 2, 2, 200, 210), (2, 1, 1, 105, None), (2, 2, 2, None, 215), (2, 3, 9, 300, 310), (3, 1, 1, 100, 110), (3, 2, 2, 900, 910)]
    rows += [(k, n, 10 * k + n, 100 * n, 100 * n + 5) for k in range(10, 110) for n in (1, 2)]
    stops = spark.createDataFrame(rows, "train long, seq int, station long, arr int, dep int")
    written, turn = [], lineage.turn
    monkeypatch.setattr(lineage, "turn", lambda df: (written.append(turn(df)), written[-1])[1])
    links = linkage.possible_links(stops, 2, 10)
    assert [tuple(r) for r in links.collect()] == [(1, 2, 2)]
    merged = linkage.merged(linkage.events(stops), links.select("a", "b"))
    assert sorted((r.t, r.station, r.kind) for r in merged.collect()) == [(105, 1, "a."), (110, 1, "d."), (200, 2, "a."), (215, 2, "d."), (300, 9, "a."), (310, 9, "d.")]
    assert written and all(w.count() <= 8 for w in written)


def test_flights_are_written_where_they_are_read(spark, monkeypatch, tmp_path):
    """Flight rows that occur twice are one service."""
    named = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    flights = spark.createDataFrame([(1, 1, 5, 7), (1, 1, 5, 7), (2, 1, 5, 7)], ", ".join(f"{c} long" for c in named))
    flights.repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    written, csv = [], sinks.csv
    monkeypatch.setattr(sinks, "csv", lambda df, path: (written.append(df), csv(df, path))[1])
    got = sorted(tuple(r) for r in exchange.flight_legs(spark, str(tmp_path)).collect())
    assert got == [(f"F{k}.1.5.7", "A7", 4320, "A5", 7920, 3600, f"F{k}.1.5.7:A7->A5") for k in (1, 2)]
    assert [moved(w) for w in written] == [0]

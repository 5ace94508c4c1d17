import pytest
from pyspark.sql import functions as F

from wayline.operators import flows, graph, hull, linkage, match, osm, routing, spatial, stats, timetable
from wayline.sources import files, sinks


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_services_across_midnight(spark):
    stops = spark.createDataFrame([("K", 1, "a", None, 1430), ("K", 2, "b", 5, 10), ("K", 3, "a", 20, 25), ("K", 4, "c", 40, None)], "train string, seq int, station string, arr int, dep int")
    got = rows(timetable.services(stops), "depart_station", "arrive_station", "depart", "arrive", "travel_time")
    assert got == [("a", "b", 1430, 5, 15), ("a", "c", 25, 40, 15), ("b", "a", 10, 20, 10), ("b", "c", 10, 40, 30)]
    direct = rows(timetable.services(stops, "direct"), "depart_station", "arrive_station")
    assert direct == [("a", "b"), ("a", "c"), ("b", "a")]


def test_last_runs(spark):
    t = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), ("x", 4), ("x", 5), ("z", 6)], "train string, row int")
    assert rows(timetable.last_runs(t), "train", "row", "seq") == [("x", 4, 0), ("x", 5, 1), ("y", 3, 0), ("z", 6, 0)]


def test_leg_services(spark):
    legs = spark.createDataFrame([("K", 0, "a", 100, "b", 100, "A->B"), ("K", 1, "b", 200, "a", 90_000, "B->A")], "code string, seq int, dep string, dep_t int, arr string, arr_t int, info string")
    got = rows(timetable.leg_services(legs), "dep", "arr", "arr_t", "during", "describe")
    assert got == [("a", "b", 100, 86_400, "K:A->B"), ("b", "a", 3600, 89_800, "K:B->A")]


def test_routes(spark):
    services = spark.createDataFrame([("s1", 1, 500, 2, 560, 60), ("s2", 2, 580, 3, 600, 20), ("s3", 1, 490, 3, 900, 410), ("s4", 2, 565, 3, 570, 5)], "id string, dep bigint, dep_t bigint, arr bigint, arr_t bigint, during bigint")
    seeds = spark.createDataFrame([(1, 1, 0, 480)], "origin bigint, station bigint, total bigint, at bigint")
    got = rows(routing.route_layers(services, seeds, 2, 10, 720), "station", "legs", "total")
    assert got == [(2, 1, 80), (3, 1, 420), (3, 2, 120)]  # s4 leaves inside the prepare window
    assert rows(routing.route_exact(services, seeds, 10, 720, most=2, by_transfers=True), "station", "transfers", "total") == [(1, 0, 0), (2, 1, 80), (3, 1, 420), (3, 2, 120)]
    assert rows(routing.route_exact(services, seeds, 10, 720, most=2), "station", "total") == [(1, 0), (2, 80), (3, 120)]
    assert routing.dominates((1, 5), (2, 5)) and not routing.dominates((1, 6), (2, 5)) and not routing.dominates((1, 5), (1, 5))


def test_graphs(spark):
    edges = spark.createDataFrame([("a", "b", 1.0, 1), ("b", "a", 4.0, 2), ("b", "c", 2.0, 3), ("d", "d", 1.0, 4), ("e", "f", 99.0, 5)], "src string, dst string, w double, row int")
    u = graph.undirected(edges)
    assert rows(u, "a", "b", "w") == [("a", "b", 4.0), ("b", "c", 2.0), ("d", "d", 1.0), ("e", "f", 99.0)]
    cut = graph.cut(u, 4)
    assert rows(graph.nodes(cut), "node") == [("a",), ("b",), ("c",), ("d",)]
    pairs = spark.createDataFrame([("a", "c"), ("a", "f"), ("a", "a")], "origin string, target string")
    assert rows(graph.travel_time(u, pairs), "origin", "target", "dist") == [("a", "a", 0.0), ("a", "c", 6.0), ("a", "f", -1.0)]
    assert rows(graph.composed(u, cut.withColumn("w", F.lit(7.0))), "a", "b", "w") == [("a", "b", 7.0), ("b", "c", 7.0), ("d", "d", 7.0), ("e", "f", 99.0)]


def test_flows_are_consistent(spark):
    places = spark.createDataFrame([(i, 10.0 * i, 5.0 * (i % 3), 100.0 + i) for i in range(5)] + [(9, 0.0, 0.0, 50.0)], "name int, lon double, lat double, value double")
    d = {(r.org, r.dest): r.d for r in flows.pair_distances(places).collect()}
    assert all(abs(d[a, b] - d[b, a]) < 1e-9 for a, b in d) and d[0, 9] == 0
    assert {r.flow is None for r in flows.gravity(places).where("org = 9 and dest = 0").collect()} == {True}
    r = {(x.org, x.dest): x for x in flows.radiation(places).collect()}
    order = sorted((b for a, b in d if a == 1), key=lambda b: (d[1, b], b))
    assert [r[1, b].s for b in order] == [sum({p.name: p.value for p in places.collect()}[x] for x in order[:k]) for k in range(len(order))]


def test_points_in_polygons(spark):
    box = lambda x, y, w: F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y))])
    polygons = spark.range(1).select(F.lit(2).alias("poly"), box(0, 0, 30).alias("ring")).union(spark.range(1).select(F.lit(1), box(5, 5, 30))).union(spark.range(1).select(F.lit(3), box(100, 0, 5)))
    points = spark.createDataFrame([(1, 10.0, 10.0, 2.0), (2, 1.0, 1.0, 3.0), (3, 10.0, 11.0, -5.0), (4, 90.0, 1.0, 7.0), (5, 34.0, 34.0, 1.0)], "pid int, x double, y double, value double")
    assert rows(spatial.polygon_sums(points, polygons), "poly", "total", "n") == [(1, 3.0, 2), (2, 3.0, 1), (3, 0.0, 0)]
    assert sum(r.value for r in spatial.downsample(points, 20.0).collect()) == 8.0


def test_distributions(spark):
    values = [float(v) for v in [1, 2, 3, 10, 50, 99, 100] * 3]
    frame = spark.createDataFrame([(v,) for v in values], "value double")
    h = stats.log_histogram(frame, 21).orderBy("bin").collect()
    assert sum(r.freq for r in h) == pytest.approx(1) and h[0].x == 1 and h[-1].freq > 0
    shares = [r.share for r in stats.reverse_cdf(stats.log_histogram(frame, 21)).orderBy("bin").collect()]
    assert shares == sorted(shares, reverse=True) and shares[0] == pytest.approx(1)
    ordered = sorted(values)
    want = [ordered[round(len(ordered) / 4 * k)] for k in (1, 2, 3)] + [100.0]
    assert [r.split for r in stats.split_points(frame, 4).orderBy("k").collect()] == want
    w, b = stats.fit_power(spark.createDataFrame([(0.5, 1.0), (0.8, 0.9)], "x double, y double"), 3)
    assert w != 1 and b != 1


def test_linkage(spark):
    stops = spark.createDataFrame(
        [("A", 0, "x", None, 100), ("A", 1, "y", 200, 210), ("A", 2, "z", 300, None), ("B", 0, "x", None, 100), ("B", 1, "y", 200, None), ("C", 0, "x", None, 130), ("D", 0, "y", None, 215), ("E", 0, "p", None, 2350), ("E", 1, "q", 10, 20)],
        "train string, seq int, station string, arr int, dep int",
    )
    got = {(r.a, r.b): r.score for r in linkage.similarity(stops, 1).collect()}
    assert got["A", "B"] == 0 and got["A", "C"] == linkage.NO_LINK and got["B", "D"] == 15 and got["A", "D"] == linkage.NO_LINK
    assert {(r.a, r.b): r.score for r in linkage.similarity(stops, 3).collect()}["A", "B"] == linkage.NO_LINK
    assert rows(linkage.possible_links(stops), "a", "b", "matches") == [("A", "B", 2)]
    events = linkage.events(stops)
    assert rows(events.where("train = 'E'"), "station", "kind", "t") == [("p", "d.", 2350), ("q", "a.", 2410), ("q", "d.", 2420)]
    merged = linkage.merged(events, spark.createDataFrame([("A", "B")], "a string, b string"))
    assert rows(merged, "station", "kind", "t") == [("x", "d.", 100), ("y", "a.", 200), ("y", "d.", 210), ("z", "a.", 300)]
    assert all(r.ok for r in linkage.monotone(events).collect())
    places = spark.createDataFrame([("x", 0.0, 0.0), ("y", 0.0, 1.0)], "station string, lon double, lat double")
    (speed,) = [r.speed for r in linkage.speeds(stops.where("train = 'A'"), places).collect()]
    assert speed == pytest.approx(111.195 / 1.0, abs=0.1)


def test_matching(spark):
    left = spark.createDataFrame([(1, "Berlin Hbf"), (2, ""), (3, None), (4, "zzz")], "id int, name string")
    right = spark.createDataFrame([("Hbf Berlin",), ("Berlin",), ("Bern",)], "other string")
    got = {r.id: r.matches for r in match.fuzzy_matches(left, right, "name", "other", 90).collect()}
    assert got == {1: "Berlin, Hbf Berlin", 2: "", 3: "", 4: ""}
    c = spark.createDataFrame([("Ulm Hbf", "p1", 0, ["Neu-Ulm"]), ("Ulm Hbf", "p2", 1, ["Ulm Hauptbahnhof"]), ("A", "p3", 0, ["A", "B"]), ("Q", "p4", 0, ["xyz"])], "name string, place string, rank int, names array<string>")
    assert rows(match.accepted_candidates(c), "name", "place", "confidence") == [("A", "p3", -1.0), ("Ulm Hbf", "p2", 1.0)]


def test_hull(spark):
    assert hull.hull_of([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1), (1, 0), (0, 0)]) == [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]
    p = spark.createDataFrame([("k", float(x), float(y)) for x in range(5) for y in range(5)] + [("l", 1.0, 1.0)], "key string, x double, y double").repartition(4)
    assert rows(hull.convex_hulls(p), "key", "pos", "x", "y") == [("k", 0, 0.0, 0.0), ("k", 1, 4.0, 0.0), ("k", 2, 4.0, 4.0), ("k", 3, 0.0, 4.0), ("k", 4, 0.0, 0.0), ("l", 0, 1.0, 1.0), ("l", 1, 1.0, 1.0)]


def test_osm_places(spark, tmp_path):
    (tmp_path / "a.osm").write_text("""<osm><node id="1" lon="0" lat="0"><tag k="name" v="N1"/></node><node id="2" lon="2" lat="2"/><node id="3" lon="5" lat="5"><tag k="name" v="Halt"/><tag k="railway" v="halt"/></node>
    <node id="4" lon="9" lat="9"><tag k="name" v="12 km"/></node><way id="1"><nd ref="1"/><nd ref="2"/><nd ref="77"/><tag k="name" v="W"/></way><relation id="9"><member type="way" ref="1"/><tag k="name:en" v="R"/></relation></osm>""")
    e = files.osm_xml(spark, str(tmp_path / "a.osm"))
    assert rows(osm.places(e), "name", "id", "lon", "type", "element") == [("Halt", 3, 5.0, "halt", "node"), ("N1", 9, 1.0, "", "relation"), ("R", 9, 1.0, "", "relation"), ("W", 9, 1.0, "", "relation")]
    assert rows(e.where(osm.is_station()), "id") == [(3,)]


def test_files(spark, tmp_path):
    (tmp_path / "legs.txt").write_text("('K1', [['a', 10, 'b', 20, 'A->B'], ['b', 30, 'c', 40, 'B->C']])\n('K2', [['x', 1, 'y', 2, 'X->Y']])\n('K2', [['x', 5, 'y', 6, 'X->Y']])\n")
    assert rows(files.leg_lines(spark, str(tmp_path / "legs.txt")), "code", "seq", "dep", "dep_t", "arr", "arr_t", "info") == [("K1", 0, "a", 10, "b", 20, "A->B"), ("K1", 1, "b", 30, "c", 40, "B->C"), ("K2", 0, "x", 5, "y", 6, "X->Y")]
    (tmp_path / "t.xml").write_text('<trains><train id="7" trainType="D"><station name="a" depart="0100" UTC="2"/><station name="b" arrive="0230" UTC="2"/></train></trains>')
    stops = files.trains_xml(spark, str(tmp_path / "t.xml"))
    assert rows(stops, "train", "seq", "station", "arr", "dep") == [("7", 0, "a", None, 2300), ("7", 1, "b", 30, None)]
    sinks.trains_xml(stops, str(tmp_path / "out"))
    assert rows(files.trains_xml(spark, str(tmp_path / "out")), "station", "arr", "dep") == [("a", None, 2300), ("b", 30, None)]
    assert rows(sinks.train_rows(stops), "stop_id", "arrive_time", "depart_time") == [(0, "--", "23:00"), (1, "00:30", "--")]
    (tmp_path / "s.xml").write_text('<all><station name="a" lon="01" lat="2" country="X" UTC="1"/></all>')
    assert rows(files.stations_xml(spark, str(tmp_path / "s.xml")), "name", "lon", "time_zone") == [("a", "01", "1")]
    html = "<table><tr><td>1</td><td><b>2</b></td></tr><tr><td>3</td></tr></table><dl><dt>k</dt><dd>v</dd></dl>"
    pages = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert [tuple(r) for r in files.table_rows(pages, 2).collect()] == [(1, 0, ["1", "2"])]
    assert files.info_box(pages).first().facts == {"k": "v"}
    with pytest.raises(ValueError):
        files.csv(spark, "a.xlsx", "a int")
    t = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 3)], "k string, v int, row int")
    assert rows(files.lookup(t, "k", "v", "row"), "k", "v") == [("a", 2), ("b", 3)]
    answer = '{"data": {"routeList": [{"legs": [{"flight": {"flightNumber": "F1", "departureDate": "2020-01-01 10:20:00", "arrivalDate": "2020-01-01 12:00:00"}, "characteristic": {"lowestPrice": "5"}}]}, {"legs": [{}, {}]}, {"legs": null}]}}'
    assert rows(files.flights_json(spark.createDataFrame([(answer,)], "json string")), "flight", "depart", "arrive", "price") == [("F1", "10:20", "12:00", "5")]

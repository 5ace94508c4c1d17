import pytest
from pyspark.sql import functions as F

from wayline.functions import geo as G
from wayline.functions import text as N
from wayline.functions import timeops as T


def values(spark, expressions):
    return list(spark.range(1).select(*[e.alias(f"c{i}") for i, e in enumerate(expressions)]).first())


L = F.lit


def test_gaps(spark):
    cases = [
        (T.gap_minutes(L("08:10"), L("09:05")), 55), (T.gap_minutes(L("23:50"), L("00:10")), 20), (T.gap_minutes(L("0700"), L("07:00")), 0),
        (T.gap_minutes(L("08:00"), L("09:00"), 2), 2940), (T.gap_minutes(L("08:00"), L("07:00"), 0), 1380), (T.gap_minutes(L(None).cast("string"), L("07:00")), -1),
        (T.gap(L("08:10"), L("09:05"), "h:m"), "00:55"), (T.gap(L("08:00"), L("09:30"), "h"), 1.5), (T.gap(L("08:00"), L("09:30"), "s"), None),
        (T.signed_gap(L("08:00"), L("07:30"), 0), -30.0), (T.signed_gap(L("08:00"), L("07:30"), 1), 1410.0),
    ]
    assert values(spark, [c for c, _ in cases]) == [v for _, v in cases]


def test_clock_numbers(spark):
    cases = [
        (T.clock_number(L("9:30")), 9.5), (T.clock_number(L("12:xx")), None), (T.clock_number(L("01:30"), "m"), 90.0), (T.clock_text(L(9.5)), "09:30"), (T.clock_text(L(1.9999)), "01:60"),
        (T.clock_text_carried(L(1.9999)), "02:00"), (T.clock_text(L(75.0), "m"), "00:75"), (T.to_minutes(L(-100)), 1380), (T.to_hhmm(L(1500)), 100), (T.to_hhmm(L(1439)), 2359),
        (T.to_utc(L(-1), L(3)), -1), (T.to_utc(L(30), L(2)), 2230), (T.to_utc(L(2330), L(-2)), 2530), (T.to_local(L(2200), L(2)), 2400), (T.to_local(L(2300), L(2)), 100), (T.to_local(L(100), L(-2)), -100),
        (T.wrapped_clock(L(1500)), "01:00"), (T.wrapped_clock(L(-1)), "23:59"), (T.ride(L(5), L(5)), 86_400), (T.ride(L(10), L(5)), 86_395), (T.of_day(L(-1)), 86_399),
        (T.iso_clock(L("2020-01-02 03:04:05")), "03:04"), (T.is_clock(L("--")), False), (T.is_clock(L("12:30")), True), (T.hhmm_clock(L(5)), "00:05"), (T.hhmm_clock(L(-1)), "--"),
        (T.zero_filled(L("12345"), 4), "12345"),
    ]
    assert values(spark, [c for c, _ in cases]) == [v for _, v in cases]


def test_distances_and_cells(spark):
    km, here, snap, half, speed, none = values(spark, [G.distance_km(L(0.0), L(0.0), L(0.0), L(90.0)), G.distance_km(L(5.0), L(5.0), L(5.0), L(5.0)), G.snapped(L(1.23), 0.5), G.cell(L(0.625), 0.25), G.speed_kmh(L(50.0), L(30)), G.speed_kmh(L(50.0), L(0))])
    assert km == pytest.approx(10007.557, abs=0.01) and here == 0
    assert snap == 1.5 and half == 3 and speed == 100 and none is None
    near = values(spark, [G.around(L(0.0), L(0.0), 0.5)])[0]
    assert len(near) == 8


def test_ring(spark):
    ring = F.array(*[F.struct(L(float(x)).alias("x"), L(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (2, 1), (0, 4), (0, 0))])
    got = values(spark, [G.inside(ring, L(x), L(y)) for x, y in ((1.0, 1.0), (2.0, 3.0), (3.9, 3.0), (5.0, 1.0), (0.0, 1.0), (4.0, 1.0))])
    assert got == [True, False, True, False, True, False]


def test_area_of_a_small_box(spark):
    import math

    a, b = 0.01, 50.0
    ring = F.array(*[F.struct(L(x).alias("x"), L(y).alias("y")) for x, y in ((0.0, b), (a, b), (a, b + a), (0.0, b + a), (0.0, b))])
    (km2,) = values(spark, [G.ring_area(ring, "km2")])
    e, s = G.ECC2, math.sin(math.radians(b + a / 2))
    m = G.AXIS_M * (1 - e) / (1 - e * s * s) ** 1.5
    n = G.AXIS_M / math.sqrt(1 - e * s * s)
    want = math.radians(a) ** 2 * m * n * math.cos(math.radians(b + a / 2)) / 1e6
    assert km2 == pytest.approx(want, rel=1e-4)
    level = F.array(*[F.struct(L(x).alias("x"), L(y).alias("y")) for x, y in ((0.0, -5.0), (9.0, -5.0), (9.0, 5.0), (0.0, 5.0), (0.0, -5.0))])
    assert values(spark, [G.ring_area(level, "m2")]) == [None]


def test_speed_tags_and_drives(spark):
    got = values(spark, [G.max_speed(L(s)) for s in ("160 kph", "90mph", "120", "none", "62.5 mph")])
    assert got == [160.0, 144.84, 120.0, -1.0, 1005.84]
    drive = lambda f, fo, b, bo, d: G.drive_time(L(f), L(fo), L(b), L(bo), L(d))
    got = values(spark, [drive(600, True, 1, True, 20.0), drive(3600, True, 1800, True, 20.0), drive(-1, False, 900, True, 20.0), drive(-1, False, 900, False, 20.0), drive(3600, True, 7200, True, 1.0)])
    assert [float(x) for x in got] == [600, 1800, 900, -1, 720]


def test_texts(spark):
    cases = [
        (N.xml_escaped(L("a<&>'\"")), "a&lt;&amp;&gt;&apos;&quot;"), (N.full_station_name(L("Ulm Hbf")), "Ulm Hauptbahnhof"), (N.full_station_name(L("Hbf Ulm")), "Hbf Ulm"),
        (N.joined_route(L("K1"), L("A->B"), L("C->D")), "K1:A->D"), (N.route_code(L("K1:A->D")), "K1"), (N.capitalised(L("hELLO wORLD")), "Hello world"), (N.level_of_file(L("/a/units_2.shp")), "2"),
        (N.cjk_runs(L("a北京b上海 北京")), ["北京", "上海"]), (N.name_ratio(L("ab"), L("ba")), 0.5), (N.name_ratio(L(""), L("")), 1.0), (N.distance_sign(F.create_map(L("name:en"), L("12 km"))), True),
    ]
    assert values(spark, [c for c, _ in cases]) == [v for _, v in cases]

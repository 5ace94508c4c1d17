"""Flows within a distance and order statistics against all pairs and a sort."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayline.functions import geo as G
from wayline.operators import flows, stats


def km(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * G.RADIUS_KM * math.asin(min(1.0, math.sqrt(h)))


@pytest.mark.parametrize("most", [15.0, 400.0, 3_000.0, 25_000.0])
def test_pairs_within_equal_all_pairs(spark, most):
    rng = random.Random(int(most))
    spots = [(rng.uniform(-180, 180), math.degrees(math.asin(rng.uniform(-1, 1)))) for _ in range(120)]
    spots += [(rng.choice([-179.99, 179.99, 180.0, -180.0]), rng.uniform(-89, 89)) for _ in range(30)] + [(rng.uniform(-180, 180), rng.choice([-1, 1]) * rng.uniform(88, 90)) for _ in range(30)]
    spots += [(0.0, 90.0), (77.0, 90.0), (0.0, -90.0)] + [(10 + rng.uniform(-0.2, 0.2), 50 + rng.uniform(-0.1, 0.1)) for _ in range(20)]
    places = spark.createDataFrame([(i, float(x), float(y), 1.0) for i, (x, y) in enumerate(spots)], "name int, lon double, lat double, value double")
    got = {(r.org, r.dest) for r in flows.pair_distances(places, most).collect()}
    want = {(i, j) for i, p in enumerate(spots) for j, q in enumerate(spots) if i != j and km(p, q) <= most}
    assert got == want


@pytest.mark.parametrize("values", [
    [], [5.0], [1.0] * 50, [None, 2.0, None, 1.0, float("nan")], list(range(1000)), [10.0**k for k in range(-300, 300, 7)] + [-(10.0**k) for k in range(-300, 300, 11)] + [0.0],
    [1.0, 1.0 + 2**-52, 1.0 + 2**-51] * 9, [1.7e308, -1.7e308, 5e-324, 0.0, float("inf"), float("-inf")],
])
def test_places_equal_a_sort(spark, values):
    frame = spark.createDataFrame([(float(v) if v is not None else None,) for v in values], "value double")
    order = sorted(values, key=lambda v: (0, 0.0) if v is None else (2, 0.0) if math.isnan(v) else (1, v))
    got = stats.at_places(frame, list(range(0, len(values), max(1, len(values) // 7))))
    for place, v in got.items():
        assert repr(v) == repr(None if order[place] is None else float(order[place])), place
    assert len(got) == len(range(0, len(values), max(1, len(values) // 7)))


def test_too_many_different_x_raise(spark, monkeypatch):
    monkeypatch.setattr(stats, "MOST_X", 3)
    with pytest.raises(ValueError, match="different x"):
        stats.fit_power(spark.range(9).selectExpr("id + 1.0D as x", "1.0D as y"))


def test_binned_density_is_within_its_error(spark):
    rng = random.Random(5)
    rows = [rng.gauss(10, 3) for _ in range(300)] + [rng.choice([1.0, 30.0]) for _ in range(40)]
    frame = spark.createDataFrame([(v,) for v in rows] + [(None,)], "value double")
    exact = {r.point: r.density for r in stats.density(frame, 20).collect()}
    mean = sum(rows) / len(rows)
    width = math.sqrt(sum((v - mean) ** 2 for v in rows) / (len(rows) - 1)) * len(rows) ** -0.2
    for cells in (40, 400):
        got = {r.point: r.density for r in stats.binned_density(frame, 20, cells).collect()}
        most = stats.density_error(max(rows) - min(rows), width, cells)
        assert got.keys() == exact.keys() and max(abs(got[k] - exact[k]) for k in got) <= most < 0.01


@pytest.mark.parametrize("load", [2, 250])
def test_pairs_of_full_cells_are_dealt_and_nothing_is_broadcast(spark, monkeypatch, load):
    monkeypatch.setattr(flows, "LOAD", load, raising=False)
    rng = random.Random(3)
    spots = [(rng.uniform(-180, 180), rng.uniform(86, 90)) for _ in range(40)] + [(rng.uniform(0, 4), rng.uniform(0, 4)) for _ in range(40)]
    values = [float(rng.randint(1, 9)) for _ in spots]
    places = spark.createDataFrame([(i, x, y, v) for i, ((x, y), v) in enumerate(zip(spots, values))], "name int, lon double, lat double, value double")
    pairs = flows.pair_distances(places, 350.0)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastNestedLoopJoin" not in plan
    got = {(r.org, r.dest): r.s for r in flows.radiation(places, most=350.0).collect()}
    near = {(i, j): km(p, q) for i, p in enumerate(spots) for j, q in enumerate(spots) if i != j and km(p, q) <= 350}
    assert got == {(i, j): sum(values[k] for (o, k), e in near.items() if o == i and (e, k) < (d, j)) for (i, j), d in near.items()}
    assert {(r.org, r.dest) for r in pairs.collect()} == near.keys()


def crowded(spark, n, kind="double", seed=4):
    """Places of a few cells, many at one spot or as far as another, a few without a value."""
    rng = random.Random(seed)
    rows = [(i, float(rng.randint(0, 6)) / 4, 50 + float(rng.randint(-4, 4)) / 4, None if i % 17 == 5 else rng.randint(1, 9)) for i in range(n)]
    return spark.createDataFrame(rows, "name int, lon double, lat double, value int").withColumn("value", F.col("value").cast(kind))


@pytest.mark.parametrize("kind", ["double", "bigint", "decimal(12,2)"])
@pytest.mark.parametrize("batch", [7, 10_000])
def test_nearer_values_are_summed_origin_by_origin(spark, monkeypatch, kind, batch):
    """The same rows and types as the window over all pairs, and no sort of a task's pairs."""
    monkeypatch.setattr(flows, "LOAD", 20)
    places = crowded(spark, 90, kind)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        near, whole = flows.radiation(places, most=25_000.0), flows.radiation(places)
        plan = near._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.splitlines() if "Sort [" in line and " d#" in line.replace("[d#", " d#")]
        assert near.schema["s"].dataType == whole.schema["s"].dataType
        got, want = ({(r.org, r.dest): (r.s, r.flow) for r in f.collect()} for f in (near, whole))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 90 * 89 and got == want


def test_pairs_of_an_origin_that_come_apart_raise():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"_i": [1, 2, 1], "org": [5, 6, 5], "dest": [6, 5, 7], "m": [1.0] * 3, "n": [1.0] * 3, "d": [1.0] * 3})
    with pytest.raises(RuntimeError, match="follow each other"):
        list(flows._origins(iter([batch])))
    with pytest.raises(RuntimeError, match="follow each other"):
        list(flows._origins(iter([batch.slice(1, 1), batch.slice(0, 1)])))


def test_blocks_of_a_cell_do_not_grow_in_number_with_the_places(spark, monkeypatch):
    """A place is shuffled once for each block of the cells around it."""
    monkeypatch.setattr(flows, "LOAD", 5)
    monkeypatch.setattr(flows, "SHARE", 4, raising=False)
    for n in (60, 240):
        pairs = flows._dealt_pairs(crowded(spark, n), 3_000.0)
        assert pairs.select(*[c for c in ("_k", "_b", "_c", "_o") if c in pairs.columns]).distinct().count() <= 8


def test_a_place_is_sent_to_the_bands_that_its_circle_reaches(spark):
    """Three at most, and gravity asks for the names' order before it reckons a distance."""
    places = crowded(spark, 50)
    bands = places.select(F.size(F.array_distinct(G.cells_around(F.col("lon"), F.col("lat"), 350.0)["band"])).alias("n"))
    assert bands.agg(F.max("n")).collect()[0][0] <= 3
    plan = flows.gravity(places, 350.0)._jdf.queryExecution().executedPlan().toString()
    join = next(line for line in plan.splitlines() if "SortMergeJoin" in line)
    assert 0 < join.index("(dest#") < join.index("350.0") and join.index("(dest#") < join.index("SIN(")

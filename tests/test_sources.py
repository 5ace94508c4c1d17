import numpy as np
import pytest

from wayline.operators import graph, lineage, osm, routing, spatial
from wayline.sources import binary, files


def test_shapes_of_all_kinds(tmp_path):
    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 0.0)]
    for kind, shapes in ((1, [[[(1.5, -2.5)]], [[(3.0, 4.0)]]]), (3, [[ring[:2], ring[1:]]]), (5, [[ring], [ring, [(0.5, 0.1), (1.0, 0.1), (1.0, 0.2), (0.5, 0.1)]]])):
        content = binary.shape_bytes([(kind, s) for s in shapes])
        assert [s for _, _, s in binary.parse_shapes(content)] == shapes
        assert len(content) == 2 * int.from_bytes(content[24:28], "big")
    with pytest.raises(ValueError):
        list(binary.parse_shapes(b"\0" * 200))
    rows = [{"name": "A é", "code": "1"}, {"name": None, "code": "22"}]
    assert [f for _, f in binary.parse_table(binary.table_bytes(rows))] == [[("name", "A é"), ("code", "1")], [("name", ""), ("code", "22")]]


@pytest.mark.parametrize("deflate", [False, True])
@pytest.mark.parametrize("shape", [(1, 1), (16, 3), (50, 7)])
def test_tiff_blocks_make_the_image(deflate, shape):
    image = np.random.default_rng(0).normal(0, 1, shape)
    out = np.zeros(shape)
    for row, col, block, facts in binary.parse_tiff(binary.tiff_bytes(image, 10, 20, 0.25, deflate)):
        out[row : row + block.shape[0], col : col + block.shape[1]] = block
    assert (out == image).all() and facts["scale"][:2] == (0.25, 0.25) and facts["tie"][3:5] == (10, 20)


def test_other_tiff_layouts():
    import struct

    # A tiled image of two bytes a pixel with the horizontal predictor, most significant byte first.
    image = np.arange(20 * 24, dtype=">u2").reshape(20, 24)
    tiles = []
    for r in (0, 16):
        for c in (0, 16):
            tile = np.zeros((16, 16), dtype=">u2")
            part = image[r : r + 16, c : c + 16]
            tile[: part.shape[0], : part.shape[1]] = part
            tiles.append(np.diff(tile.astype(np.uint16), axis=1, prepend=np.uint16(0)).astype(">u2").tobytes())
    starts = [8 + 512 * k for k in range(4)]
    extra = struct.pack(">4I", *starts) + struct.pack(">4I", *[512] * 4)
    end = 8 + 2048
    entries = [(256, 3, 1, 24 << 16), (257, 3, 1, 20 << 16), (258, 3, 1, 16 << 16), (317, 3, 1, 2 << 16), (322, 3, 1, 16 << 16), (323, 3, 1, 16 << 16), (324, 4, 4, end), (325, 4, 4, end + 16)]
    content = b"MM\0*" + struct.pack(">I", end + 32) + b"".join(tiles) + extra + struct.pack(">H", len(entries)) + b"".join(struct.pack(">HHII", *e) for e in entries)
    out = np.zeros((20, 24), dtype=int)
    for row, col, block, _ in binary.parse_tiff(content):
        out[row : row + block.shape[0], col : col + block.shape[1]] = block & 0xFFFF
    assert (out == image).all()
    with pytest.raises(ValueError):
        list(binary.parse_tiff(b"II+\0" + b"\0" * 20))


def test_grids_with_and_without_records():
    lats, lons, field = np.array([1.0, 2.0]), np.array([5.0, 6.0, 7.0]), np.arange(18.0).reshape(3, 2, 3)
    grid = binary.Grid(binary.grid_bytes(np.array([0.0, 1.0, 2.0]), lats, lons, field))
    assert (grid.values("value") == field).all() and grid.values("time").tolist() == [0, 1, 2] and grid.values("lon").tolist() == [5, 6, 7]
    with pytest.raises(ValueError):
        binary.Grid(b"\x89HDF\r\n")


def test_no_data_and_boxes(spark, tmp_path):
    image = np.array([[1.0, np.nan, -3.0], [4.0, 0.0, 6.0]])
    binary.put(spark, f"file://{tmp_path}/a.tif", binary.tiff_bytes(image, 0, 2, 1.0))
    got = lambda **k: sorted((r.row, r.col, r.x, r.y, r.value) for r in binary.tiff_pixels(spark, f"file://{tmp_path}", **k).collect())
    assert got() == [(0, 0, 0.5, 1.5, 1.0), (0, 2, 2.5, 1.5, -3.0), (1, 0, 0.5, 0.5, 4.0), (1, 1, 1.5, 0.5, 0.0), (1, 2, 2.5, 0.5, 6.0)]
    assert [g[4] for g in got(positive=True)] == [1, 4, 6] and [g[4] for g in got(box=(0.5, 1.5, 0, 1))] == [4, 0]


def test_equal_points_are_counted_each(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    polygons = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in ring]) for k in (1, 2)], "poly int, ring array<struct<x: double, y: double>>")
    points = spark.createDataFrame([(1, 5.0, 5.0, 2.0)] * 3 + [(2, 50.0, 5.0, 2.0)], "pid int, x double, y double, value double")
    assert [(r.poly, r.total, r.n) for r in spatial.polygon_sums(points, polygons).orderBy("poly").collect()] == [(1, 6.0, 3), (2, 0.0, 0)]


def test_cells_near_the_poles(spark):
    points = spark.createDataFrame([(1, 0.0, 90.0), (2, 10.0, -89.9)], "pid int, x double, y double")
    got = spatial.cells_within(points, 5.0, 600.0).groupBy("pid").count().collect()
    assert {r.pid for r in got} == {1, 2} and all(r["count"] <= 73 * 7 for r in got)


def test_cells_that_do_not_end_raise(spark):
    times = spark.createDataFrame([(1, 0.5 * k, 0.0, 1.0, 1.0) for k in range(6)], "origin int, lon double, lat double, seconds double, metres double")
    start = spark.createDataFrame([(1, 0.0, 0.0)], "origin int, lon double, lat double")
    assert graph.reach(start, 0.5, times, 5.0).count() == 6
    with pytest.raises(RuntimeError):
        graph.reach(start, 0.5, times, 5.0, rounds=2)


def test_first_table_wins_and_places_are_numbered(spark):
    a = spark.createDataFrame([("node", 1, "a"), ("way", 1, "a")], "type string, id int, v string")
    b = spark.createDataFrame([("node", 1, "b"), ("node", 0, "b")], "type string, id int, v string")
    assert [(r.type, r.id, r.v, r.place) for r in osm.numbered(osm.merged(a, b)).orderBy("place").collect()] == [("node", 0, "b", 0), ("node", 1, "a", 1), ("way", 1, "a", 2)]
    many = spark.range(5000).selectExpr("(id * 7919) % 5000 as k")
    assert [r.place for r in lineage.numbered(many, "k").orderBy("k").collect()] == list(range(5000))


def test_drives_join_the_routes(spark):
    services = spark.createDataFrame([("s1", "A", 500, "B", 560, 60), ("s2", "C", 600, "D", 700, 100), ("s3", "C", 590, "D", 620, 30), ("s4", "D", 100, "E", 160, 60)], "id string, dep string, dep_t int, arr string, arr_t int, during int")
    access = spark.createDataFrame([(1, "A", 10), (1, "Z", 130)], "origin bigint, station string, duration int")
    drives = spark.createDataFrame([("B", "C", 20), ("C", "B", 1), ("D", "Z", 5)], "source string, target string, duration int")
    kinds = spark.createDataFrame([("A", "station"), ("C", "station"), ("D", "airport")], "station string, kind string")
    run = lambda **k: sorted((r.station, r.total, r.legs, r.path) for r in routing.route_multimodal(services, access, drives, kinds, 470, **k).collect())
    # The drive to Z is too long; s3 leaves ten minutes after the car's arrival at C, too early; s4 leaves on the next day.
    first, second = ("B", 90, 1, ["carDriving", "s1"]), ("D", 230, 2, ["carDriving", "s1", "carDriving", "s2"])
    assert run(hops=2) == [first, second]
    assert run(hops=3) == [first, second, ("E", 1130, 3, [*second[3], "s4"])]
    assert run(hops=3, cap=200) == [first, second]
    assert run(hops=2, by_car=True) == [first, ("C", 110, 1, [*first[3], "carDriving"]), second, ("Z", 235, 2, [*second[3], "carDriving"])]
    assert run(hops=2, prepare={"station": 5, "": 60}) == [first, ("D", 150, 2, ["carDriving", "s1", "carDriving", "s3"])]


def test_gbk_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name,n\n上海,1\n".encode("gbk"))
    assert files.csv(spark, str(tmp_path / "a.csv"), "name string, n int", "gbk").first().name == "上海"


def test_no_match_is_pruned_away(spark):
    import random

    from wayline.operators import match

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 4))) for _ in range(120)] + ["", "--", "a a a", "ab-cd", "Äb cd"]
    names = match._Names(texts)
    for least in (40, 60, 90, 100):
        for t in texts:
            want = {k for k, n in enumerate(texts) if match.weighted_score(t, n) >= least}
            assert want <= set(names.may_reach(t, least))
    pruned = sum(len(names.may_reach(t, 90)) for t in texts)
    assert pruned < 0.5 * len(texts) ** 2
    left, right = spark.createDataFrame([(t,) for t in texts], "a string"), spark.createDataFrame([(t,) for t in texts[::2]], "b string")
    got = {r.a: r.matches for r in match.fuzzy_matches(left, right, "a", "b", 60, block=7).collect()}
    for t in texts:
        best = sorted((-match.weighted_score(t, n), n) for n in {*texts[::2]})[:2]
        assert got[t] == ", ".join(n for s, n in best if -s >= 60)


def test_relations_inside_each_other(spark):
    kind = "type string, id bigint, lon double, lat double, tags map<string, string>, nds array<bigint>, members array<struct<type: string, ref: bigint>>"
    rel = lambda i, *m: ("relation", i, None, None, {"name": f"r{i}"}, None, [{"type": t, "ref": r} for t, r in m])
    rows = [("node", 1, 2.0, 4.0, {"name": "n"}, None, None), rel(1, ("node", 1)), rel(2, ("relation", 1)), rel(3, ("relation", 2), ("relation", 99)), rel(4, ("relation", 5)), rel(5, ("relation", 4))]
    got = sorted((r.name, r.id, r.lon) for r in osm.places(spark.createDataFrame(rows, kind)).collect())
    assert got == [("n", 3, 2.0), ("r1", 3, 2.0), ("r2", 3, 2.0), ("r3", 3, 2.0)]


def test_long_names_and_the_index_of_a_shapefile(spark, tmp_path):
    import struct

    import pytest

    from wayline.sources import binary

    name = "é" * 100 + "tail"
    rows = [{"name": name}, {"name": ""}]
    assert [dict(f) for _, f in binary.parse_table(binary.table_bytes(rows))] == rows
    with pytest.raises(ValueError, match="255 bytes"):
        binary.table_bytes([{"name": "x" * 255}])
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    shapes = binary.shape_bytes([(5, [square]), (5, [square, square]), (5, [square])])
    index = binary.index_bytes(shapes)
    assert index[:24] == shapes[:24] and struct.unpack(">i", index[24:28])[0] * 2 == len(index)
    for k in range(3):
        at, words = struct.unpack_from(">2i", index, 100 + 8 * k)
        assert struct.unpack_from(">2i", shapes, 2 * at) == (k + 1, words)
    df = spark.createDataFrame([([[{"x": x, "y": y} for x, y in square]], name)], "parts array<array<struct<x: double, y: double>>>, name string")
    assert binary.write_shapes(df, f"{tmp_path}/shapes").count() == 1
    assert sorted(p.suffix for p in (tmp_path / "shapes").iterdir()) == [".dbf", ".shp", ".shx"]
    assert binary.shapes(spark, f"{tmp_path}/shapes").first()["fields"]["name"] == name


def test_relations_of_any_depth(spark):
    from wayline.operators import osm

    refs = spark.createDataFrame([(1, "node", 7), (2, "relation", 1), (3, "relation", 2), (4, "relation", 3), (5, "relation", 6), (6, "relation", 5)], "id long, t string, ref long")
    refs = refs.selectExpr("'relation' as type", "id", "array('n' || id) as names", "'city' as kind", "struct(t as type, ref as ref) as m")
    held = spark.createDataFrame([("node", 7, 1.0, 2.0, ["x"], "city")], "type string, id long, lon double, lat double, names array<string>, kind string")
    got = {r.id: (r.lon, r.lat) for r in osm._relations(refs, held, True).collect()}
    assert got == {1: (1.0, 2.0), 2: (1.0, 2.0), 3: (1.0, 2.0), 4: (1.0, 2.0), 5: (None, None), 6: (None, None)}


def test_bands_and_tiles_of_images_and_grids(spark, tmp_path):
    rng = np.random.default_rng(2)
    for bands in (2, 3):
        image = rng.normal(size=(7, 5, bands))
        for band in range(bands):
            got = np.full((7, 5), np.nan)
            for row, col, block, _ in binary.parse_tiff(binary.tiff_bytes(image, 0, 0, 1.0, True, 3), band):
                got[row : row + block.shape[0], col : col + block.shape[1]] = block
            assert (got == image[:, :, band]).all()
    pixels = [(t, b, r, c, float(100 * t + 10 * b + r + c / 10)) for t in (1, 2) for b in (0, 1) for r in range(3) for c in range(4) if (r + c) % 3]
    frame = spark.createDataFrame([*pixels, (1, 0, 0, 1, -5.0)], "tile int, band int, row int, col int, value double")
    assert sorted(r.n for r in binary.write_tiffs(frame, f"{tmp_path}/t", (3, 4), 0.0, 3.0, 1.0).collect()) == [16, 17]
    got = {(int(r.file[-5]), r.row, r.col): r.value for r in binary.tiff_pixels(spark, f"file://{tmp_path}/t", band=1).collect()}
    assert got == {(t, r, c): v for t, b, r, c, v in pixels if b == 1}
    cells = frame.selectExpr("tile", "band as time", "row", "col", "value")
    binary.write_grids(cells, f"{tmp_path}/g", [5.0, 6.0], [2.0, 1.0, 0.0], [0.0, 1.0, 2.0, 3.0]).collect()
    got = {(r.file[-4], r.x, 2 - r.y): r.value for r in binary.grid_cells(spark, f"file://{tmp_path}/g", "value", 6.0).collect()}
    assert got == {(str(t), float(c), float(r)): v for t, b, r, c, v in pixels if b == 1}

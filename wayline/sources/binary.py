"""Readers and writers of shapefiles, GeoTIFF and classic netCDF, after their public descriptions.

A file is one row of Spark's binaryFile source and is parsed in one task, so a file must fit a task's memory and stay below
2 GB; a folder's files are read in parallel. Rows go out in batches. Not supported, with an error that says so: measured or
three-dimensional shapes beyond their x and y, TIFF compressions other than none and deflate, netCDF-4 (which is HDF5).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch.
ROWS = 1 << 16


def files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """path, content of the files below a folder, by suffix."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path).select("path", "content")


# Shapefiles

#: Shape types with points only, with parts, and bare lists of points, each also with z and m.
POINT, PARTS, POINTS = (1, 11, 21), (3, 5, 13, 15, 23, 25), (8, 18, 28)


def parse_shapes(content: bytes) -> Iterator[tuple[int, int, list[list[tuple[float, float]]]]]:
    """(row, type, parts) of a .shp file."""
    if struct.unpack(">i", content[:4])[0] != 9994:
        raise ValueError("not a shapefile")
    at, row = 100, 0
    while at + 8 <= len(content):
        size = 2 * struct.unpack(">i", content[at + 4 : at + 8])[0]
        body, at = content[at + 8 : at + 8 + size], at + 8 + size
        kind = struct.unpack("<i", body[:4])[0]
        if kind == 0:
            parts = []
        elif kind in POINT:
            parts = [[struct.unpack("<2d", body[4:20])]]
        elif kind in PARTS:
            n, m = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{n}i", body[44 : 44 + 4 * n]), m]
            xy = np.frombuffer(body, "<f8", 2 * m, 44 + 4 * n).reshape(-1, 2).tolist()
            parts = [[tuple(p) for p in xy[a:b]] for a, b in zip(starts, starts[1:])]
        elif kind in POINTS:
            m = struct.unpack("<i", body[36:40])[0]
            parts = [[tuple(p)] for p in np.frombuffer(body, "<f8", 2 * m, 40).reshape(-1, 2).tolist()]
        else:
            raise ValueError(f"shape type {kind} is not supported")
        yield row, kind, parts
        row += 1


def parse_table(content: bytes, encoding: str = "utf-8") -> Iterator[tuple[int, list[tuple[str, str]]]]:
    """(row, fields as texts) of a .dbf file."""
    n, head, size = struct.unpack("<ihh", content[4:12])
    fields, at = [], 32
    while content[at : at + 1] not in (b"\r", b""):
        fields.append((content[at : at + 11].split(b"\0")[0].decode(encoding, "replace"), content[at + 16]))
        at += 32
    for row in range(n):
        line, at, out = content[head + row * size : head + (row + 1) * size], 1, []
        for name, width in fields:
            out.append((name, line[at : at + width].decode(encoding, "replace").strip(" \0")))
            at += width
        yield row, out


RING = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))


def shapes(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """file (without its suffix), row, type, parts (arrays of points x, y) and fields (a map of texts) of shapefiles and their
    tables below a folder."""

    def bodies(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = list(parse_shapes(content.as_buffer().to_pybytes()))
                for a in range(0, len(found), 4096):
                    own = found[a : a + 4096]
                    parts = pa.array([[[{"x": x, "y": y} for x, y in part] for part in s[2]] for s in own], RING)
                    yield pa.RecordBatch.from_arrays([pa.array([name[:-4]] * len(own)), pa.array([s[0] for s in own], pa.int64()), pa.array([s[1] for s in own], pa.int32()), parts], ["file", "row", "type", "parts"])

    def tables(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = list(parse_table(content.as_buffer().to_pybytes(), encoding))
                yield pa.RecordBatch.from_arrays([pa.array([name[:-4]] * len(found), pa.string()), pa.array([r for r, _ in found], pa.int64()), pa.array([f for _, f in found], pa.map_(pa.string(), pa.string()))], ["file", "row", "fields"])

    body = files(spark, path, ".shp").mapInArrow(bodies, "file string, row bigint, type int, parts array<array<struct<x: double, y: double>>>")
    table = files(spark, path, ".dbf").mapInArrow(tables, "file string, row bigint, fields map<string, string>")
    return body.join(table, ["file", "row"], "left")


def shape_bytes(rows: list[tuple[int, list[list[tuple[float, float]]]]]) -> bytes:
    """A .shp file of points (type 1), lines (3) or polygons (5): (type, parts) of each shape, all of one type."""
    kind = rows[0][0] if rows else 5
    every = np.array([p for _, parts in rows for part in parts for p in part], dtype=float).reshape(-1, 2)
    box = [*every.min(axis=0), *every.max(axis=0)] if every.size else [0.0] * 4
    out = []
    for k, (_, parts) in enumerate(rows):
        if kind in POINT:
            body = struct.pack("<i2d", kind, *parts[0][0])
        else:
            xy = np.array([p for part in parts for p in part], dtype="<f8").reshape(-1, 2)
            starts = np.cumsum([0, *[len(p) for p in parts[:-1]]])
            own = [*xy.min(axis=0), *xy.max(axis=0)]
            body = struct.pack("<i4d2i", kind, *own, len(parts), len(xy)) + struct.pack(f"<{len(parts)}i", *starts) + xy.tobytes()
        out.append(struct.pack(">2i", k + 1, len(body) // 2) + body)
    size = 100 + sum(map(len, out))
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i", 1000, kind) + struct.pack("<8d", *box, 0, 0, 0, 0) + b"".join(out)


#: The widest text field of a .dbf file, in bytes.
WIDEST = 254


def table_bytes(rows: list[dict[str, str]]) -> bytes:
    """A .dbf file of text fields, each as wide as its longest text; a text of more than WIDEST bytes raises an error."""
    names = list(rows[0]) if rows else ["name"]
    cells = {n: [(r[n] or "").encode() for r in rows] for n in names}
    width = {n: max(1, *map(len, c)) if c else 1 for n, c in cells.items()}
    for n, w in width.items():
        if w > WIDEST:
            raise ValueError(f"a text of {w} bytes in {n}: a .dbf field holds {WIDEST}")
    head = struct.pack("<4BIHH20x", 3, 100, 1, 1, len(rows), 32 + 32 * len(names) + 1, 1 + sum(width.values()))
    fields = b"".join(struct.pack("<11sc4xB15x", n.encode()[:10], b"C", width[n]) for n in names)
    return head + fields + b"\r" + b"".join(b" " + b"".join(cells[n][k].ljust(width[n]) for n in names) for k in range(len(rows))) + b"\x1a"


def index_bytes(shapes: bytes) -> bytes:
    """The .shx file of a .shp file: the place and length of each record, in 16-bit words."""
    at, places = 100, []
    while at < len(shapes):
        words = struct.unpack_from(">i", shapes, at + 4)[0]
        places.append(struct.pack(">2i", at // 2, words))
        at += 8 + 2 * words
    return shapes[:24] + struct.pack(">i", (100 + 8 * len(places)) // 2) + shapes[28:100] + b"".join(places)


def write_shapes(df: DataFrame, path: str, kind: int = 5) -> DataFrame:
    """Writes df (parts and a column `name`) as shapefiles with index and table, one for each partition, in a folder that driver and
    executors share. A partition's file has its number for a name, so that a repeated task writes it anew."""
    from pyarrow import fs

    def run(batches):
        from pyspark import TaskContext

        parts, names = [], []
        for batch in batches:
            parts += batch.column(0).to_pylist()
            names += batch.column(1).to_pylist()
        if parts:
            store, folder = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
            store.create_dir(folder, recursive=True)
            name = f"{folder}/part-{TaskContext.get().partitionId():05d}"
            rows = [(kind, [[(p["x"], p["y"]) for p in part] for part in shape]) for shape in parts]
            shapes = shape_bytes(rows)
            for suffix, content in ((".shp", shapes), (".shx", index_bytes(shapes)), (".dbf", table_bytes([{"name": n} for n in names]))):
                with store.open_output_stream(name + suffix) as f:
                    f.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(parts)], pa.int64())], ["file", "rows"])

    return df.select("parts", "name").mapInArrow(run, "file string, rows bigint")


# GeoTIFF

#: Numbers of the tags that are read, and bytes of a tag's types.
TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 273: "offsets", 277: "samples", 278: "rows", 279: "sizes", 317: "predictor", 322: "tile_width", 323: "tile_height", 324: "offsets", 325: "sizes", 339: "format", 33550: "scale", 33922: "tie", 42113: "nodata"}
SIZES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


def parse_tiff(content: bytes, band: int = 0) -> Iterator[tuple[int, int, np.ndarray, dict]]:
    """(first row, first column, block, facts) of a band of the first image, whose bands lie pixel by pixel."""
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None or struct.unpack(order + "H", content[2:4])[0] != 42:
        raise ValueError("not a classic TIFF file")
    at = struct.unpack(order + "I", content[4:8])[0]
    facts: dict = {"compression": (1,), "format": (1,), "samples": (1,), "predictor": (1,)}
    for k in range(struct.unpack(order + "H", content[at : at + 2])[0]):
        entry = content[at + 2 + 12 * k : at + 14 + 12 * k]
        tag, kind, n = struct.unpack(order + "HHI", entry[:8])
        if tag in TAGS and kind in SIZES:
            size = struct.calcsize(order + SIZES[kind]) * n
            raw = entry[8 : 8 + size] if size <= 4 else content[(p := struct.unpack(order + "I", entry[8:])[0]) : p + size]
            facts[TAGS[tag]] = raw.rstrip(b"\0").decode("ascii", "replace") if kind == 2 else struct.unpack(order + SIZES[kind] * n, raw)
    if facts["compression"][0] not in (1, 8, 32946):
        raise ValueError(f"TIFF compression {facts['compression'][0]} is not supported")
    width, height, samples = facts["width"][0], facts["height"][0], facts["samples"][0]
    if not 0 <= band < samples:
        raise ValueError(f"band {band} of {samples}")
    kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[facts['format'][0]] }{facts['bits'][0] // 8}")
    tiled = "tile_width" in facts
    wide, high = (facts["tile_width"][0], facts["tile_height"][0]) if tiled else (width, facts.get("rows", (height,))[0])
    across = -(-width // wide)
    for k, (start, size) in enumerate(zip(facts["offsets"], facts["sizes"])):
        row, col = k // across * high, k % across * wide
        if row >= height:
            break  # further bands
        raw = content[start : start + size]
        raw = raw if facts["compression"][0] == 1 else zlib.decompress(raw)
        rows = high if tiled else min(high, height - row)
        block = np.frombuffer(raw, kind, rows * wide * samples).reshape(rows, wide, samples)[:, :, band]
        if facts["predictor"][0] == 2:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
        elif facts["predictor"][0] != 1:
            raise ValueError("TIFF predictors of floating point are not supported")
        yield row, col, block[: height - row, : width - col], facts


def tiff_pixels(spark: SparkSession, path: str, positive: bool = False, box: tuple[float, float, float, float] | None = None, band: int = 0) -> DataFrame:
    """file, row, col, x, y (a pixel's centre), value of a band of the images below a folder; no-data pixels are left out. positive:
    values above 0 only. box: left, right, down, up, all closed, none for the whole world. Rows are cut while reading."""
    whole = box is None or tuple(box) == (-180, 180, -90, 90)

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                for row, col, block, facts in parse_tiff(content.as_buffer().to_pybytes(), band):
                    step, tie = facts.get("scale", (1.0, 1.0, 0.0)), facts.get("tie", (0.0,) * 6)
                    keep = ~np.isnan(block) if block.dtype.kind == "f" else np.ones(block.shape, dtype=bool)
                    if facts.get("nodata"):
                        keep &= block != float(facts["nodata"])
                    if positive:
                        keep &= block > 0
                    r, c = np.nonzero(keep)
                    value = block[r, c].astype(float)
                    r, c = r + row, c + col
                    x, y = tie[3] + (c + 0.5 - tie[0]) * step[0], tie[4] - (r + 0.5 - tie[1]) * step[1]
                    if not whole:
                        fits = (x >= box[0]) & (x <= box[1]) & (y >= box[2]) & (y <= box[3])
                        r, c, x, y, value = (v[fits] for v in (r, c, x, y, value))
                    for a in range(0, r.size, ROWS):
                        own = slice(a, a + ROWS)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * r[own].size), pa.array(r[own].astype(np.int64)), pa.array(c[own].astype(np.int64)), pa.array(x[own]), pa.array(y[own]), pa.array(value[own])], ["file", "row", "col", "x", "y", "value"])

    return files(spark, path, ".tif").mapInArrow(run, "file string, row bigint, col bigint, x double, y double, value double")


def tiff_bytes(image: np.ndarray, left: float, up: float, step: float, deflate: bool = False, rows: int = 16) -> bytes:
    """A GeoTIFF of float64 values in strips; image: rows, columns, and bands if there are several."""
    image = np.ascontiguousarray(image, dtype="<f8")
    bands = image.shape[2] if image.ndim == 3 else 1
    strips = [image[a : a + rows].tobytes() for a in range(0, image.shape[0], rows)]
    strips = [zlib.compress(s) for s in strips] if deflate else strips
    starts = np.cumsum([8, *map(len, strips)])
    n, end = len(strips), int(starts[-1])
    extra = struct.pack(f"<{n}I", *starts[:-1]) + struct.pack(f"<{n}I", *map(len, strips)) + struct.pack("<3d", step, step, 0) + struct.pack("<6d", 0, 0, 0, left, up, 0) + struct.pack(f"<{bands}H", *[64] * bands) + struct.pack(f"<{bands}H", *[3] * bands)
    at = [end, end + 4 * n, end + 8 * n, end + 8 * n + 24, end + 8 * n + 72]
    one = lambda tag, kind, value: struct.pack("<HHII", tag, kind, 1, value)
    many = lambda tag, kind, count, value: struct.pack("<HHII", tag, kind, count, value)
    where = at[:2] if n > 1 else [int(starts[0]), len(strips[0])]
    entries = [one(256, 4, image.shape[1]), one(257, 4, image.shape[0]), many(258, 3, bands, at[4] if bands > 2 else 64 * 0x10001 if bands == 2 else 64), one(259, 3, 8 if deflate else 1), many(273, 4, n, where[0]), one(277, 3, bands), one(278, 4, rows), many(279, 4, n, where[1]), many(339, 3, bands, at[4] + 2 * bands if bands > 2 else 3 * 0x10001 if bands == 2 else 3), many(33550, 12, 3, at[2]), many(33922, 12, 6, at[3])]
    table = end + len(extra)
    return b"II*\0" + struct.pack("<I", table) + b"".join(strips) + extra + struct.pack("<H", len(entries)) + b"".join(entries) + struct.pack("<I", 0)


def _store(folder: str):
    """(file system, path) of a folder that driver and executors share, for use in tasks."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
    store.create_dir(path, recursive=True)
    return store, path


def write_tiffs(pixels: DataFrame, path: str, shape: tuple[int, int], left: float, up: float, step: float, deflate: bool = False) -> DataFrame:
    """Writes pixels (tile, band, row, col, value) as a GeoTIFF of `shape` for each tile, in a folder that driver and executors
    share: file, n. Pixels that are not there become nan; a tile is written in one task, which holds its image. Of repeated
    pixels the largest value counts."""

    def run(pdf):
        import pandas as pd

        store, folder = _store(path)
        image = np.full((*shape, int(pdf["band"].max()) + 1), np.nan)
        pdf = pdf.sort_values("value")
        image[pdf["row"], pdf["col"], pdf["band"]] = pdf["value"]
        name = f"{folder}/tile-{pdf['tile'].iloc[0]}.tif"
        with store.open_output_stream(name) as f:
            f.write(tiff_bytes(image, left, up, step, deflate))
        return pd.DataFrame({"file": [name], "n": [len(pdf)]})

    return pixels.select("tile", "band", "row", "col", "value").groupBy("tile").applyInPandas(run, "file string, n bigint")


# Classic netCDF

#: The types of the format.
KINDS = {1: ">i1", 2: ">S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}


class Grid:
    """The header of a classic netCDF file, and its variables."""

    def __init__(self, content: bytes):
        if content[:3] != b"CDF" or content[3] not in (1, 2):
            raise ValueError("not a classic netCDF file")
        self.content, self.at, self.wide = content, 4, content[3] == 2
        self.records = self.number()
        self.dims = [(self.name(), self.number()) for _ in range(self.list())]
        self.attributes()
        self.variables = {}
        for _ in range(self.list()):
            name, dims = self.name(), [self.number() for _ in range(self.number())]
            own = self.attributes()
            kind, size = KINDS[self.number()], self.number()
            begin = struct.unpack(">q" if self.wide else ">i", self.take(8 if self.wide else 4))[0]
            self.variables[name] = (dims, own, kind, size, begin)
        self.stride = sum(v[3] for v in self.variables.values() if v[0] and self.dims[v[0][0]][1] == 0)

    def take(self, n: int) -> bytes:
        self.at += n
        return self.content[self.at - n : self.at]

    def number(self) -> int:
        return struct.unpack(">i", self.take(4))[0]

    def list(self) -> int:
        self.number()  # the kind of list, or 0 for an empty one
        return self.number()

    def name(self) -> str:
        n = self.number()
        return self.take(n + -n % 4)[:n].decode("utf-8", "replace")

    def attributes(self) -> dict:
        out = {}
        for _ in range(self.list()):
            name, kind, n = self.name(), KINDS[self.number()], self.number()
            size = np.dtype(kind).itemsize * n
            out[name] = np.frombuffer(self.take(size + -size % 4)[:size], kind)
        return out

    def record(self, name: str, k: int) -> np.ndarray:
        """The k-th slice along the first dimension, without the others."""
        dims, _, kind, _, begin = self.variables[name]
        shape = [self.dims[d][1] for d in dims]
        each = int(np.prod(shape[1:]))
        far = self.stride if shape[0] == 0 else each * np.dtype(kind).itemsize
        return np.frombuffer(self.content, kind, each, begin + k * far).reshape(shape[1:])

    def values(self, name: str) -> np.ndarray:
        dims, _, kind, size, begin = self.variables[name]
        shape = [self.dims[d][1] for d in dims]
        if dims and shape[0] == 0:
            each = int(np.prod(shape[1:]))
            return np.stack([np.frombuffer(self.content, kind, each, begin + k * self.stride).reshape(shape[1:]) for k in range(self.records)]) if self.records else np.zeros((0, *shape[1:]))
        return np.frombuffer(self.content, kind, int(np.prod(shape)), begin).reshape(shape)


def grid_cells(spark: SparkSession, path: str, value: str, time: float | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """file, x, y, value of the variable `value` (of lat, lon, or of time, lat, lon, of which the slice at `time` is taken) of
    the files below a folder; positive values inside the box (left, right, down, up), which is open in the east."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                grid = Grid(content.as_buffer().to_pybytes())
                dims = [grid.dims[d][0] for d in grid.variables[value][0]]
                if len(dims) == 3:
                    hit = np.flatnonzero(grid.values(dims[0]) == time)
                    if not hit.size:
                        continue
                    field, dims = grid.record(value, int(hit[0])).astype(float), dims[1:]
                else:
                    field = grid.values(value).astype(float)
                fill = grid.variables[value][1].get("_FillValue")
                keep = (field > 0) & (True if fill is None else field != fill[0])
                r, c = np.nonzero(keep)
                x, y, v = grid.values(dims[1])[c].astype(float), grid.values(dims[0])[r].astype(float), field[r, c]
                if box is not None:
                    fits = (x >= box[0]) & (x < box[1]) & (y >= box[2]) & (y <= box[3])
                    x, y, v = x[fits], y[fits], v[fits]
                for a in range(0, v.size, ROWS):
                    own = slice(a, a + ROWS)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * v[own].size), pa.array(x[own]), pa.array(y[own]), pa.array(v[own])], ["file", "x", "y", "value"])

    return files(spark, path, ".nc").mapInArrow(run, "file string, x double, y double, value double")


def grid_bytes(times: np.ndarray, lats: np.ndarray, lons: np.ndarray, field: np.ndarray) -> bytes:
    """A classic netCDF file with the variables time (unlimited), lat, lon and value."""
    text = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    sizes = [("time", 0), ("lat", lats.size), ("lon", lons.size)]
    dims = struct.pack(">2i", 10, 3) + b"".join(text(n) + struct.pack(">i", s) for n, s in sizes)
    shapes_ = [("lat", [1], 8 * lats.size), ("lon", [2], 8 * lons.size), ("time", [0], 8), ("value", [0, 1, 2], 8 * lats.size * lons.size)]
    heads = [text(n) + struct.pack(f">{1 + len(d)}i", len(d), *d) + struct.pack(">2i", 0, 0) + struct.pack(">2i", 6, size) for n, d, size in shapes_]
    start = 4 + 4 + len(dims) + 8 + 8 + sum(len(h) + 4 for h in heads)
    begins = np.cumsum([start, shapes_[0][2], shapes_[1][2], shapes_[2][2]])
    variables = struct.pack(">2i", 11, 4) + b"".join(h + struct.pack(">i", int(b)) for h, b in zip(heads, begins))
    records = b"".join(np.array(t, ">f8").tobytes() + f.astype(">f8").tobytes() for t, f in zip(times, field))
    return b"CDF\x01" + struct.pack(">i", len(times)) + dims + struct.pack(">2i", 0, 0) + variables + lats.astype(">f8").tobytes() + lons.astype(">f8").tobytes() + records


def write_grids(cells: DataFrame, path: str, times: list[float], lats: list[float], lons: list[float]) -> DataFrame:
    """Writes cells (tile, time, row, col, value; time, row and col are places in the lists) as a classic netCDF file for each tile, in
    a folder that driver and executors share: file, n. Cells that are not there are 0; of repeated ones the largest counts."""

    def run(pdf):
        import pandas as pd

        store, folder = _store(path)
        field = np.zeros((len(times), len(lats), len(lons)))
        pdf = pdf.sort_values("value")
        field[pdf["time"], pdf["row"], pdf["col"]] = pdf["value"]
        name = f"{folder}/tile-{pdf['tile'].iloc[0]}.nc"
        with store.open_output_stream(name) as f:
            f.write(grid_bytes(np.array(times), np.array(lats), np.array(lons), field))
        return pd.DataFrame({"file": [name], "n": [len(pdf)]})

    return cells.select("tile", "time", "row", "col", "value").groupBy("tile").applyInPandas(run, "file string, n bigint")


def with_point(cells: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Cells with a geometry column, a struct of x and y."""
    point: Column = F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return cells.withColumn("point", point)


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """Writes a small file through Hadoop's file systems."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()

"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are 64-bit majorities over the XXH64 of 3-word shingles. Equal fingerprints form one class;
the classes are sorted by population counts, written as files of the shared folder, and every file is
compared with the files whose counts are within the radius, tile by tile, with exclusive-or and bit
counts in numpy. A tile pair is skipped if the population counts of the whole fingerprints, or of their
four 16-bit parts together, must differ by more than the radius: no link is lost. Whole files are skipped by the
same rule before they are opened. A task gives a spanning forest of the links that it found, not all pairs. The links are
between fingerprints, so that ids of any range, repeated ones and rows without an id need no numbers of their own.

Defined results: a null or empty text has fingerprint zero and is linked like any other; texts of fewer
than three words have one shingle; repeated rows share a class. A component's id is its smallest doc_id;
rows without a doc_id are compared too, and their component's id is null if none in it has a doc_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, join_spread
from .shared import column, open_fs, small_batches, staged

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Classes in a file, and in a tile; tiles of one file in a row that are compared at once.
FILE_ROWS, TILE, RUN = 16_384, 128, 32
#: Links that a task holds before it reduces them to a forest.
HELD = 1 << 20


def fingerprint(text: str | None) -> int:
    """The fingerprint, unsigned."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if len(words) >= SHINGLE:
        starts, ends = starts[: 1 - SHINGLE], ends[SHINGLE - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, set_ = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    n = starts.size
    for k in range(0, n, 8192):
        h = np.array([digest(line[s:e], SEED) for s, e in zip(starts[k : k + 8192].tolist(), ends[k : k + 8192].tolist())], dtype="<u8")
        set_ += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_ > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns: key, fp (the fingerprint's bits as a bigint)."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    data = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t) for t in column(batch, "text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["key", "fp"])

    return data.mapInArrow(run, f"key {kind}, fp bigint").withColumnRenamed("key", key)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components, one for each node but the smallest of each component."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    u, v = at[: a.size], at[a.size :]
    label = np.arange(nodes.size)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        for side in (u, v):
            np.minimum.at(new, label[side], low)
            np.minimum.at(new, side, low)
        while (shorter := new[new]).tobytes() != new.tobytes():
            new = shorter
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(nodes.size)
    return nodes[moved], nodes[label[moved]]


def _apart(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray, radius: int) -> np.ndarray:
    """Which boxes of population counts (whole, four parts; one along the first axis) can hold no link; the arrays broadcast."""
    gap = np.maximum(0, np.maximum(low - other_high, other_low - high))
    return (gap[0] > radius) | (gap[1:].sum(axis=0) > radius)


class _File:
    """A file of classes with its tiles' boxes of population counts."""

    def __init__(self, path: str):
        import pyarrow.parquet as pq

        fs, inner = open_fs(path)
        held = pq.read_table(inner, filesystem=fs, columns=["fp", "rep"])
        self.fp = held["fp"].to_numpy().view(np.uint64)
        self.rep = held["rep"].to_numpy()
        parts = [np.bitwise_count(self.fp)] + [np.bitwise_count((self.fp >> np.uint64(s)) & np.uint64(0xFFFF)) for s in (48, 32, 16, 0)]
        self.starts = np.arange(0, self.fp.size, TILE)
        counts = np.stack(parts).astype(np.int64)
        self.low = np.minimum.reduceat(counts, self.starts, axis=1) if self.fp.size else counts
        self.high = np.maximum.reduceat(counts, self.starts, axis=1) if self.fp.size else counts

    def near(self, other: _File, radius: int) -> np.ndarray:
        """Tile pairs that may hold a link."""
        return np.argwhere(~_apart(self.low[:, :, None], self.high[:, :, None], other.low[:, None, :], other.high[:, None, :], radius))


def _links(left: _File, right: _File, radius: int):
    """Arrays of linked representatives."""
    same = left is right
    pairs = left.near(right, radius)
    if same:
        pairs = pairs[pairs[:, 0] <= pairs[:, 1]]
    if not pairs.size:
        return
    # Tiles that follow each other in the right file are compared together.
    new = np.r_[True, (np.diff(pairs[:, 0]) != 0) | (np.diff(pairs[:, 1]) != 1)]
    first = np.flatnonzero(new)
    place = np.arange(len(pairs)) - np.repeat(first, np.diff(np.r_[first, len(pairs)]))
    first = np.flatnonzero(place % RUN == 0)
    last = np.r_[first[1:], len(pairs)] - 1
    for i, j, k in zip(pairs[first, 0].tolist(), pairs[first, 1].tolist(), pairs[last, 1].tolist()):
        x, y = left.starts[i], right.starts[j]
        far = np.bitwise_count(left.fp[x : x + TILE, None] ^ right.fp[None, y : right.starts[k] + TILE])
        a, b = np.nonzero(far <= radius)
        a, b = a + x, b + y
        if same:
            a, b = a[a < b], b[a < b]
        if a.size:
            yield left.rep[a], right.rep[b]


def linked(classes: DataFrame, radius: int = RADIUS, file_rows: int = FILE_ROWS) -> DataFrame:
    """classes: fp (distinct), rep. Links a, b with the components of all pairs of classes whose fp differ
    in at most radius bits."""
    spark = classes.sparkSession
    part = lambda s: F.bit_count(F.shiftrightunsigned("fp", s).bitwiseAND(F.lit(0xFFFF)))
    order = classes.withColumns({"p": F.bit_count("fp"), "p0": part(48), "p1": part(32), "p2": part(16), "p3": part(0)})
    keys = ["p", "p0", "p1", "p2", "fp"]
    tiles = staged(order.repartitionByRange(*keys).sortWithinPartitions(*keys), "tiles", file_rows)
    counts = ["p", "p0", "p1", "p2", "p3"]
    spans = tiles.groupBy(F.col("_metadata.file_path").alias("path")).agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in counts])
    # A row for each file of file_rows classes: names and counts, no fingerprints.
    files = sorted(tuple(r) for r in spans.collect())
    n = len(files)
    if not n:
        return spark.createDataFrame([], "a bigint, b bigint")
    paths, boxes = [f[0] for f in files], np.array([f[1:] for f in files], dtype=np.int64).T
    low, high = boxes[:5], boxes[5:]

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                left = _File(paths[i])
                held, size = [], 0
                apart = _apart(low[:, i, None], high[:, i, None], low, high, radius)
                for step in range(n // 2 + 1):
                    j = (i + step) % n
                    if 2 * step == n and i > j or apart[j]:
                        continue
                    for pair in _links(left, left if j == i else _File(paths[j]), radius):
                        held.append(pair)
                        size += pair[0].size
                        if size >= HELD:
                            held = [forest(*map(np.concatenate, zip(*held)))]
                            size = held[0][0].size
                if held:
                    a, b = forest(*map(np.concatenate, zip(*held)))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return spark.range(0, n, 1, n).mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """Columns: key, fp, component_id, for each row of docs. key is an integer column."""
    fps = staged(fingerprints(docs, key, text), "simhash")
    classes = staged(fps.groupBy("fp").agg(F.min(F.col(key).cast("bigint")).alias("id"), F.count("*").alias("n")), "classes")
    found = staged(components(staged(linked(classes.select("fp", F.col("fp").alias("rep")), radius), "links")), "components")
    least = found.join(classes, found["node"] == classes["fp"]).groupBy("component").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    named = join_spread(found, least, "component", found.count()).select("node", "least")
    named = staged(classes.join(named, classes["fp"] == named["node"], "left").select("fp", F.coalesce("least", "id").alias("component_id"), "n"), "named")
    rows = named.agg(F.sum("n")).first()[0] or 0
    return join_spread(fps, named, "fp", rows).select(key, "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of docs with one document of each group of near duplicates: that with the smallest id. Rows
    that repeat an id are told apart by their fingerprints; of those that are their group's smallest id, the
    one whose text has the smallest digest stays, of all groups together. Rows without an id all stay, as no
    group can name them. Columns are those of docs."""
    groups = staged(near_duplicates(docs, key, text, radius), "groups").select(F.col(key).cast("bigint").alias("_id"), "fp", "component_id")
    own = F.col("_id") == F.col("component_id")
    kept = staged(groups.groupBy("_id").agg(F.count("*").alias("n"), F.max(own).alias("kept")).where("kept").select("_id", "n"), "kept")
    # Columns of docs travel in a struct, clear of the names here.
    rows = docs.select(F.col(key).cast("bigint").alias("_id"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    found = join_spread(rows, kept, "_id", kept.agg(F.sum("n")).first()[0] or 0, wide=True)
    out = rows.where("_id is null").select("_row.*").unionByName(found.where("n = 1").select("_row.*"))
    if kept.where("n > 1").limit(1).count() == 0:
        return out
    repeated = found.where("n > 1").select("_row", F.col(f"_row.{text}").alias("_text"))
    repeated = fingerprints(repeated, "_row", "_text").withColumn("_id", F.col(f"_row.{key}").cast("bigint"))
    places = groups.where(own).groupBy("_id", "fp").agg(F.count("*").alias("n")).withColumn("_place", F.struct("_id", "fp"))
    repeated = join_spread(repeated.select("_row", F.struct("_id", "fp").alias("_place")), places.select("_place", "n"), "_place", places.agg(F.sum("n")).first()[0] or 0)
    first = F.min(F.struct(F.sha2(F.col(f"_row.{text}").cast("binary"), 256).alias("_digest"), "_row")).alias("_first")
    return out.unionByName(repeated.groupBy("_place._id").agg(first).select("_first._row.*"))

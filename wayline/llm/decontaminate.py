"""Benchmark decontamination: windows of documents within a small edit distance of a benchmark item.

Texts are normalised (A-Z to lower case, white space runs to one space). An item of n characters may differ by
k = (1 - SIMILARITY) n edits; it is cut into k + 1 pieces, and k edits leave at least one of them whole, wherever
they stand. So the first characters of every piece (as many as the item's shortest piece has, LONGEST at most) are
looked up at every character of a document, and no window within the limit is missed. Where a piece is found, the
item can only stand on the piece's diagonal, give or take k; the region is verified: a count of 4-grams rules out
most, and the edit distance between the item and the best text in the region, by bit-parallel dynamic programming,
must be at most k.

Items of fewer than LEAST characters after normalisation are found exactly, and not inside words. The items are taken in blocks against all documents, so the driver and the executors hold one block of bounded size at a time.

Defined results: null and empty texts hold no item; repeated rows of one doc_id are searched each, and
the best hit of (doc_id, item_id), that of least distance, then of least start, stays; equal items are all
reported; item ids may be of any type, those without an id keep none; a text of any length is searched whole, in parts that read on into the next one. Windows start
at any character, glued to other text or not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import runs, small_batches

SIMILARITY, LEAST = 0.9, 24
#: Characters of a piece that are looked up, at most. Diagonals of an item that are verified together.
LONGEST, NEAR = 16, 64
#: Items of a block, and their characters together; a longer item is a block of its own.
BLOCK, BLOCK_CHARS = 4_096, 4 << 20
PART = 1 << 19
#: First and last code points of scripts that are written without spaces.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0xA4CF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def normalise(text: str | None) -> np.ndarray:
    """Code points of the text, lower-cased and with single spaces."""
    chars = np.frombuffer((text or "").encode("utf-32-le", "replace"), dtype=np.uint32)
    space = (chars == 32) | ((chars >= 9) & (chars <= 13))
    upper = (chars >= 65) & (chars <= 90)
    chars = np.where(space, np.uint32(32), np.where(upper, chars + np.uint32(32), chars))
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    chars = chars[keep]
    if chars.size and chars[0] == 32:
        chars = chars[1:]
    return chars[:-1] if chars.size and chars[-1] == 32 else chars


def one_word(a: int, b: int) -> bool:
    """Whether two neighbouring characters stand inside one word."""
    return chr(a).isalnum() and chr(b).isalnum() and not any(low <= c <= high for c in (a, b) for low, high in UNSPACED)


def small(chars: np.ndarray) -> np.ndarray:
    """A byte for each code point, for the look-up."""
    return ((chars * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def grams(bytes_: np.ndarray) -> np.ndarray:
    """A number for each 4 bytes in a row."""
    b = bytes_.astype(np.uint32)
    return b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24


def edit_distance(item: list[int], text: list[int], most: int) -> tuple[int, int]:
    """Smallest distance of item to a prefix of text, and that prefix's length; bit-parallel, over whole
    columns. Only prefixes whose length is within `most` of the item's are tried."""
    n = len(item)
    masks: dict[int, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best = (score, 0)
    for j, c in enumerate(text[: n + most], start=1):
        eq = masks.get(c, 0)
        x = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (full & ~(x | plus)), plus & x
        score += 1 if up & top else -1 if down & top else 0
        up = (up << 1 | 1) & full
        down = (down << 1) & full
        eq |= minus
        plus, minus = down | (full & ~(eq | up)), up & eq
        if score < best[0] or score == best[0] and abs(j - n) < abs(best[1] - n):
            best = (score, j)
    return best


def start_of_best(item: list[int], text: list[int]) -> tuple[int, int]:
    """Smallest distance of item to any part of text, and the first start of such a part: the table of edit_distance
    from the end, with a free end."""
    n = len(item)
    masks: dict[int, int] = {}
    for i, c in enumerate(reversed(item)):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best = (n, len(text))
    for at in range(len(text) - 1, -1, -1):
        eq = masks.get(text[at], 0)
        x = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (full & ~(x | plus)), plus & x
        score += 1 if up & top else -1 if down & top else 0
        up = (up << 1) & full
        down = (down << 1) & full
        eq |= minus
        plus, minus = down | (full & ~(eq | up)), up & eq
        if score <= best[0]:
            best = (score, at)
    return best


def numbers(bytes_: np.ndarray, q: int) -> np.ndarray:
    """A number for each q bytes in a row, q up to LONGEST; bytes_ has a margin of LONGEST at its end, which gives none."""
    eight = np.lib.stride_tricks.as_strided(bytes_, (bytes_.size - 7, 8), (1, 1)).copy().view("<u8").ravel()
    n = bytes_.size - LONGEST
    if q < 8:
        held = eight[:n] & np.uint64((1 << 8 * q) - 1)
    else:
        held = eight[:n] ^ eight[q - 8 : q - 8 + n] * np.uint64(0x9E3779B97F4A7C15) if q > 8 else eight[:n]
    return held * np.uint64(0xD6E8FEB86659FD93)


class _Table:
    """The pieces of the items whose shortest pieces have q characters: their numbers, sorted, with items and offsets."""

    def __init__(self, q: int, keys: np.ndarray, item: np.ndarray, offset: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.q, self.item, self.offset = q, item[order], offset[order]
        self.keys, self.first, self.count = np.unique(keys[order], return_index=True, return_counts=True)
        self.shift = np.uint64(64 - min(max(int(self.keys.size * 256).bit_length(), 16), 24))
        self.bits = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.bits[(self.keys >> self.shift).astype(np.int64)] = True

    def find(self, bytes_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in bytes_ where a piece's first q characters stand, the piece's item and its offset there."""
        keys = numbers(bytes_, self.q)
        at = np.flatnonzero(self.bits.take((keys >> self.shift).astype(np.int64)))
        slot = np.minimum(np.searchsorted(self.keys, keys[at]), self.keys.size - 1)
        same = self.keys[slot] == keys[at]
        at, slot = at[same], slot[same]
        many = self.count[slot]
        piece = np.repeat(self.first[slot] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum()) if at.size else at
        return np.repeat(at, many), self.item[piece], self.offset[piece]


class Pieces:
    """The pieces of one block of items."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY):
        self.ids, self.chars = [], []
        for item_id, text in items:
            chars = normalise(text)
            if chars.size:
                self.ids.append(item_id)
                self.chars.append(chars)
        self.most = [int(c.size * (1 - similarity) + 1e-9) if c.size >= LEAST else 0 for c in self.chars]
        # Every place of a short item is verified by itself.
        self.near = np.array([NEAR if c.size >= LEAST else 1 for c in self.chars])
        self.grams = [grams(small(c)) for c in self.chars]
        held: dict[int, list] = {}
        for i, (chars, most) in enumerate(zip(self.chars, self.most)):
            q = min(chars.size // (most + 1), LONGEST)
            offset = np.arange(most + 1, dtype=np.int64) * chars.size // (most + 1)
            keys = numbers(np.r_[small(chars), np.zeros(LONGEST, np.uint8)], q)[offset]
            held.setdefault(q, []).append((keys, np.full(offset.size, i), offset))
        self.tables = [_Table(q, *map(np.concatenate, zip(*rows))) for q, rows in sorted(held.items())]

    def may(self, item: int, window: np.ndarray) -> bool:
        """False only if the window lacks more of the item's 4-grams than its allowed edits can break."""
        held = np.sort(grams(window))
        own = self.grams[item]
        if not held.size:
            return own.size <= 4 * self.most[item]
        at = np.minimum(np.searchsorted(held, own), held.size - 1)
        return own.size - np.count_nonzero(held[at] == own) <= 4 * self.most[item]

    def regions(self, view: np.ndarray, part: int, begin: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, least and greatest start by its pieces) for the pieces in view, which starts at `part`. The
        starts are counted from the document's first character, and may lie before it."""
        at, item, offset = map(np.concatenate, zip(*[t.find(view) for t in self.tables]))
        doc = np.searchsorted(begin, part + at, "right") - 1
        start = part + at - offset - begin[doc]
        order = np.lexsort((start, item, doc))
        doc, item, start = doc[order], item[order], start[order]
        new = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(start // self.near[item]) != 0)][: doc.size])
        yield from zip(doc[new].tolist(), item[new].tolist(), start[new].tolist(), start[np.r_[new[1:], doc.size][: new.size] - 1].tolist())

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
        """(index of the text, item_id, start, length, distance) of verified windows, the best for each text and item."""
        if not self.ids:
            return
        for first, block in runs(texts, PART):
            chars = [normalise(t) for t in block]
            line = np.concatenate([np.concatenate([c, [0]]) for c in chars]).astype(np.uint32)
            begin = np.r_[0, np.cumsum([c.size + 1 for c in chars])]
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            bytes_ = np.r_[small(line), np.zeros(LONGEST, np.uint8)]
            for part in range(0, line.size, PART):
                for doc, item, low, high in self.regions(bytes_[part : part + PART + LONGEST], part, begin):
                    own, most, key = self.chars[item], self.most[item], (first + doc, item)
                    if key in best and best[key][0] == 0 and best[key][1] <= low:
                        continue
                    # An exact copy lies on the diagonal of its pieces.
                    a, b = int(begin[doc]), int(begin[doc + 1]) - 1
                    if low >= 0 and a + low + own.size <= b and (line[a + low : a + low + own.size] == own).all():
                        if own.size < LEAST and (low and one_word(line[a + low - 1], own[0]) or a + low + own.size < b and one_word(own[-1], line[a + low + own.size])):
                            continue
                        hit = (0, low, own.size)
                    elif own.size < LEAST:
                        continue
                    else:
                        start, end = max(a, a + low - most), min(b, a + high + own.size + most)
                        if end - start < own.size - most or not self.may(item, bytes_[start:end]):
                            continue
                        text, letters = line[start:end].tolist(), own.tolist()
                        distance, at = start_of_best(letters, text)
                        if distance > most:
                            continue
                        distance, size = edit_distance(letters, text[at:], most)
                        hit = (distance, start + at - a, size)
                    best[key] = min(best.get(key, hit), hit)
            for (doc, item), (distance, start, size) in sorted(best.items()):
                yield doc, self.ids[item], start, int(size), int(distance)


#: The class's name at the time of the walks.
Walks = Pieces


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, in blocks of BLOCK rows and BLOCK_CHARS characters."""
    held, size = [], 0
    for row in benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").toLocalIterator():
        if held and (len(held) == BLOCK or size + len(row.text) > BLOCK_CHARS):
            yield held
            held, size = [], 0
        held.append((row.item_id, row.text))
        size += len(row.text)
    if held:
        yield held


def hits(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document and item that it holds: key, item_id, start and length (in characters of
    the normalised text), edit_distance, similarity."""
    spark = docs.sparkSession
    small_batches(spark)
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema["item_id"].dataType
    item_arrow, item_kind = to_arrow_type(item_kind), item_kind.simpleString()
    data = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    out = None
    for block in blocks(benchmark):
        shared = spark.sparkContext.broadcast(Pieces(block, similarity))

        def run(batches, shared=shared):
            for batch in batches:
                found = list(shared.value.search(batch.column(1).to_pylist()))
                keys = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                rest = [pa.array([f[k] for f in found], item_arrow if k == 1 else pa.int64()) for k in range(1, 5)]
                yield pa.RecordBatch.from_arrays([keys, *rest], ["key", "item_id", "start", "length", "edit_distance"])

        own = data.mapInArrow(run, f"key {kind}, item_id {item_kind}, start bigint, length bigint, edit_distance bigint")
        out = own if out is None else out.union(own)
    if out is None:
        out = data.limit(0).select("key", F.lit(None).cast(item_kind).alias("item_id"), *[F.lit(None).cast("bigint").alias(c) for c in ("start", "length", "edit_distance")])
    best = out.groupBy("key", "item_id").agg(F.min(F.struct("edit_distance", "start", "length")).alias("best"))
    size = F.greatest("best.length", F.lit(1))
    return best.select(F.col("key").alias(key), "item_id", "best.start", "best.length", "best.edit_distance", (1 - F.col("best.edit_distance") / size).alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, text: str = "text") -> DataFrame:
    """The rows of docs that hold no item, with the columns of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    at = docs.columns.index(text)
    for block in blocks(benchmark):
        shared = spark.sparkContext.broadcast(Pieces(block, similarity))

        def run(batches, shared=shared):
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[f[0] for f in shared.value.search(batch.column(at).to_pylist())]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def recall(rate: float, trials: int = 400, size: int = 160, seed: int = 1, at_head: bool = False) -> float:
    """Share of passages with size * rate random edits that are found at SIMILARITY. at_head: all edits stand in
    the passage's first characters, twice as many as there are edits."""
    rng = np.random.default_rng(seed)
    words = ["".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(4_000)]
    got = 0
    for _ in range(trials):
        item = " ".join(rng.choice(words, size // 5))[:size].strip()
        edited, edits = list(item), int(rate * len(item) + 1e-9)
        for _ in range(edits):
            at = int(rng.integers(0, 2 * edits if at_head else len(edited)))
            what = rng.integers(0, 3)
            if what == 0:
                edited[at] = chr(rng.integers(97, 123))
            elif what == 1:
                edited.insert(at, chr(rng.integers(97, 123)))
            else:
                del edited[at]
        before = " ".join(rng.choice(words, 20))
        got += any(True for _ in Pieces([(0, item)]).search([f"{before} {''.join(edited)} {before}"]))
    return got / trials

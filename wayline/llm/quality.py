"""Document quality by supervised subword embeddings.

Words, pairs of neighbouring words, and the character n-grams inside words are hashed to learned vectors; a pair's
hash is of the difference of its words' numbers, so that all pairs of one word with itself have one vector. A
document is the mean of its features' vectors, and a softmax over two classes gives the score. The vectors and the output are learned
together in numpy by stochastic gradient descent with per-weight step sizes. As the output is linear in
the mean, scoring needs one number for each bucket: that table, of fixed size, is what executors get.

The model is fitted on a bounded sample: SAMPLE labelled documents outside the held-out fold, those with
the smallest hash of doc_id, or as many of them in this order as have SAMPLE_BYTES of bucket counts together; their
texts are counted whole, on executors. Everything else, scoring too, covers whole texts of all rows.

Defined results: a null or empty text has no features and gets the score of the mean alone (the bias);
equal texts get equal scores; of several labels of one doc_id the mean decides, from a half on; labels
without a value, and rows without a doc_id, teach nothing. Words of over BLOCK characters count as several. A column
of the documents that has the score's name gives way to it; other columns stay.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .shared import column, fold, runs, small_batches, staged

BITS, GRAMS, WIDTH = 16, (3, 4), 10
SAMPLE, SAMPLE_BYTES, ROUNDS, PORTION, RATE = 4_000, 128 << 20, 12, 32, 0.3
THRESHOLD = 0.7
BLOCK = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX, PAIR = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2**64."""
    back = np.uint64(pow(int(BASE), -1, 1 << 64))
    out = []
    for b in (BASE, back):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _pieces(texts: list[str]):
    """(first index, texts) of about BLOCK characters; longer texts are cut at white space into parts of their own."""
    for start, block in runs(texts, BLOCK):
        if len(block) > 1 or len(block[0]) <= BLOCK:
            yield start, block
            continue
        text, at = block[0], 0
        while at < len(text):
            end = at + BLOCK
            if end < len(text):
                gap = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end))
                end = gap + 1 if gap > at else end
            yield start, [text[at:end]]
            at = end


def features(block: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words, for pairs of words, and for each n-gram size: buckets in the order of the texts, and where each text's begin."""
    line = " " + " ".join(block) + " "
    chars = np.frombuffer(line.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    space = (chars <= 32) | (chars == 0x85) | (chars == 0xA0)
    chars[space] = 32
    power, back = _powers(1 << (chars.size - 1).bit_length())
    total = np.r_[np.uint64(0), np.cumsum(chars * power[: chars.size])]
    starts = np.r_[0, np.cumsum([len(t) + 1 for t in block])]
    blanks = np.r_[0, np.cumsum(space)]

    def spread(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(31))) * MIX
        return (h >> np.uint64(64 - BITS)).astype(np.int64)

    def number(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (total[b] - total[a]) * back[a]

    first = np.flatnonzero(~space[1:] & space[:-1]) + 1
    last = np.flatnonzero(~space[:-1] & space[1:]) + 1
    words = number(first, last)
    heads = np.searchsorted(first, starts)
    follows = np.ones(first.size, dtype=bool)
    follows[heads[heads < first.size]] = False  # a text's first word follows none
    second = np.flatnonzero(follows)
    pairs = (words[second] - words[second - 1]) * PAIR + np.uint64(2)
    found = [(spread(words + np.uint64(1)), heads), (spread(pairs), np.searchsorted(second, heads))]
    for n in GRAMS:
        a = np.arange(chars.size - n + 1) if chars.size >= n else np.arange(0)
        a = a[blanks[a + n - 1] == blanks[a + 1]]  # white space at the ends at most
        found.append((spread(number(a, a + n) + np.uint64(n)), np.searchsorted(a, starts)))
    return found


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text and how often each occurs."""
    own = np.zeros(1 << BITS, dtype=np.int64)
    for _, block in _pieces([text or ""]):
        for ids, _ in features(block):
            own += np.bincount(ids, minlength=own.size)
    at = np.flatnonzero(own)
    return at, own[at]


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> tuple[np.ndarray, float]:
    """rows: buckets, counts, class of each document. Returns each bucket's number and the bias, so that
    sigmoid(mean of numbers + bias) is the softmax of class 1."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (1 << BITS, WIDTH)).astype(np.float32)
    output, bias = np.zeros((WIDTH, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    grown_v, grown_o, grown_b = np.full(1 << BITS, 1e-6, dtype=np.float32), np.full(output.shape, 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    rows = [(i, (c / c.sum()).astype(np.float32), y) for i, c, y in rows if i.size]
    for _ in range(ROUNDS if rows else 0):
        order = rng.permutation(len(rows))
        for k in range(0, len(rows), PORTION):
            own = [rows[i] for i in order[k : k + PORTION]]
            ids, weight = np.concatenate([r[0] for r in own]), np.concatenate([r[1] for r in own])
            size = np.array([r[0].size for r in own])
            at = np.r_[0, np.cumsum(size)[:-1]]
            mean = np.add.reduceat(vectors[ids] * weight[:, None], at, axis=0)
            z = mean @ output + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), [r[2] for r in own]] -= 1
            back = (p @ output.T) / len(own)
            step_o, step_b = mean.T @ p / len(own), p.mean(axis=0)
            grown_o += step_o**2
            grown_b += step_b**2
            output -= RATE * step_o / np.sqrt(grown_o)
            bias -= RATE * step_b / np.sqrt(grown_b)
            # Gradients of one bucket in several documents are summed before the step.
            where, slot = np.unique(ids, return_inverse=True)
            doc = np.repeat(np.arange(len(own)), size)
            step = np.stack([np.bincount(slot, weights=weight * back[doc, d], minlength=where.size) for d in range(WIDTH)], axis=1).astype(np.float32)
            grown_v[where] += (step**2).mean(axis=1)
            vectors[where] -= RATE * step / np.sqrt(grown_v[where])[:, None]
    return (vectors @ (output[:, 1] - output[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out: Column | None = None, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Learns from at most `sample` labelled rows of docs (doc_id, text) that are not held out."""
    small_batches(docs.sparkSession)
    out = fold(F.col("doc_id"), 4) == 2 if held_out is None else held_out
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~out).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    # The documents that are there, by id; TakeOrdered sends `sample` ids of each task at most.
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    known = known.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(sample)
    chosen = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").select("doc_id", "text", "y")

    def run(batches):
        for batch in batches:
            found = [counts(t) for t in column(batch, "text")]
            ids = pa.array([i.astype(np.uint16).tobytes() for i, _ in found], pa.binary())
            often = pa.array([c.astype(np.uint32).tobytes() for _, c in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, often, batch.column(2)], ["doc_id", "ids", "often", "y"])

    counted = staged(chosen.mapInArrow(run, "doc_id bigint, ids binary, often binary, y int"), "sample")
    # A line over the sample's rows alone, without their buckets: SAMPLE rows, and copies of them.
    size = counted.groupBy("doc_id").agg(F.sum(F.octet_length("ids") + F.octet_length("often")).alias("bytes"))
    upto = F.sum("bytes").over(Window.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id"))
    fits = size.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_BYTES).select("doc_id")
    rows = counted.join(F.broadcast(fits), "doc_id", "left_semi").toArrow().sort_by([("doc_id", "ascending"), ("ids", "ascending"), ("often", "ascending")])
    # Views of the received bytes, not wider copies: the driver's memory is the smallest.
    return train([(np.frombuffer(i.as_buffer(), np.uint16), np.frombuffer(c.as_buffer(), np.uint32), y.as_py()) for i, c, y in zip(rows["ids"], rows["often"], rows["y"])])


def probabilities(texts: list[str | None], number: np.ndarray, bias: float) -> np.ndarray:
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for start, block in _pieces(texts):
        own = slice(start, start + len(block))
        for ids, bounds in features(block):
            run = np.r_[0.0, np.cumsum(number[ids], dtype=np.float64)]
            total[own] += np.diff(run[bounds])
            n[own] += np.diff(bounds)
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + bias, -60, 60)))


def score(docs: DataFrame, model: tuple[np.ndarray, float], name: str = "score", text: str = "text", least: float | None = None) -> DataFrame:
    """docs with a column `name`, which replaces one of docs that is called so; with `least`, only the rows that reach
    it, with the columns of docs alone."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    if least is None:
        docs = docs.drop(name)
    at = docs.columns.index(text)
    schema = StructType([*docs.schema.fields, *([StructField(name, DoubleType())] if least is None else [])])

    def run(batches):
        number, bias = shared.value
        for batch in batches:
            p = probabilities(batch.column(at).to_pylist(), number, bias)
            if least is not None:
                yield batch.filter(pa.array(p >= least))
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold."""
    return score(docs, fit(docs, labels), least=threshold)

"""The language of a text, as that of the nearest of several centroids for each language.

A text is a vector of the character n-grams inside its words (1 to 3 characters, word ends included, letters lower-cased one
by one), hashed to BUCKETS numbers, each weighted by (1 + log tf) * idf and the whole of length 1. The document frequencies
are those of all documents that may teach. For each language spherical k-means gives CENTROIDS centres of a bounded
sample: the SAMPLE documents of the language with the smallest hash, clustered in one task for each language. A text gets the language of
its nearest centre by cosine; its score is that cosine. Its distance 1 - cosine rejects it where it lies beyond the centre's
radius, which is SLACK times the distance that QUANTILE of the language's sample keep to their nearest centre, or where it is 1.

Everything but the sample covers all rows and whole texts. Executors get the model, CENTROIDS * BUCKETS numbers for each
language: 256 KB. A corpus with more than MOST_LANGUAGES values of lang raises an error before any centre is learned.

Defined results: a text that is null or has no letter is `und` with score 0, and rejected. A text with letters gets a learned
language even where it is rejected; `rejected` says so. Equal texts get equal results, and of equally near centres that of the
language that is less in UTF-8 wins. Rows without a lang or a text, and texts without letters, teach nothing. A row without
a doc_id counts as one with the empty id. Repeated rows teach as often as they are there. If nothing teaches, all are `und`. A
long text is read in slices of SLICE characters that go on where the last one ended. Columns of the documents that have the
names of results give way to them; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .shared import fold, runs, small_batches

BITS, GRAMS = 14, 3
BUCKETS = 1 << BITS
CENTROIDS, SAMPLE, ROUNDS, MOST_LANGUAGES = 4, 1_000, 8, 500
QUANTILE, SLACK = 0.99, 1.25
#: Characters of short texts that are read together, and of one slice of a long text.
TOGETHER, SLICE, TEXTS = 1 << 18, 1 << 20, 64
UNKNOWN = "und"
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point its lower-case letter, 0 where it is no letter."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def _codes(text: str) -> np.ndarray:
    return letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


def _counts(codes: np.ndarray, owner: np.ndarray, texts: int, fresh: int = 0) -> np.ndarray:
    """n-grams of codes (0: no letter) of several texts by text and bucket. owner: the text of each code. Those that end in
    the first `fresh` codes are not counted."""
    total = np.zeros(texts * BUCKETS, dtype=np.int64)
    hashed = np.zeros(codes.size, dtype=np.uint64)
    wide = codes.astype(np.uint64)
    for n in range(1, GRAMS + 1):
        # The hash of the n codes that end at each place.
        hashed[n - 1 :] += wide[: codes.size - n + 1] * MIX[n - 1]
        ends = np.arange(n - 1, codes.size)
        # A word's end may be the first or the last of a gram, no gram has one inside, and none is an end alone.
        good = np.ones(ends.size, dtype=bool) if n > 1 else codes > 0
        for k in range(1, n - 1):
            good &= codes[ends - k] > 0
        good[: max(0, fresh - n + 1)] = False
        at = ends[good]
        own = hashed[at] * (MIX[0] ^ np.uint64(2 * n))
        total += np.bincount(owner[at].astype(np.int64) * BUCKETS + (own >> np.uint64(64 - BITS)).astype(np.int64), minlength=total.size)
    return total.reshape(texts, BUCKETS)


def _squeezed(codes: np.ndarray) -> np.ndarray:
    """Which codes stay when each run of 0 becomes one."""
    return (codes > 0) | np.r_[True, codes[:-1] > 0]


def text_counts(texts: list[str]) -> np.ndarray:
    """Counts of the buckets of each text; texts of more than SLICE characters alone."""
    if len(texts) == 1 and len(texts[0]) > SLICE:
        total, held = np.zeros((1, BUCKETS), dtype=np.int64), np.zeros(1, dtype=np.uint32)
        for at in range(0, len(texts[0]) + 1, SLICE):
            last = at + SLICE > len(texts[0])
            codes = np.r_[held, _codes(texts[0][at : at + SLICE]), np.zeros(int(last), np.uint32)]
            codes = np.r_[held, codes[held.size :][_squeezed(codes)[held.size :]]]
            total += _counts(codes, np.zeros(codes.size, np.int64), 1, held.size)
            held = codes[-(GRAMS - 1) :]
        return total
    # The texts between zeros; the zero after a text is its own, the first of all the first one's.
    parts = [_codes(t) for t in texts]
    size = np.array([p.size + 1 for p in parts])
    codes = np.zeros(size.sum() + 1, dtype=np.uint32)
    at = np.r_[1, 1 + np.cumsum(size)[:-1]]
    for p, k in zip(parts, at):
        codes[k : k + p.size] = p
    owner = np.r_[0, np.repeat(np.arange(len(texts)), size)]
    stays = _squeezed(codes)
    return _counts(codes[stays], owner[stays], len(texts))


def blocks(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(first text, counts) of runs of texts; null: empty."""
    for start, run in runs(texts, TOGETHER):
        for k in range(0, len(run), TEXTS):
            yield start + k, text_counts(run[k : k + TEXTS])


def weighted(counts: np.ndarray, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row of counts its buckets and their TF-IDF, of length 1; of a text without letters none. Row by row, so that
    a text's numbers do not depend on those beside it."""
    for row in counts:
        at = np.flatnonzero(row)
        found = (1 + np.log(row[at])) * idf[at]
        yield at, found / max(np.sqrt(found @ found), 1e-30)


@dataclass
class Model:
    """Languages in UTF-8 order; for each centre its language's number, its unit vector (a column) and its radius."""

    languages: list[str]
    idf: np.ndarray
    owner: np.ndarray
    centres: np.ndarray
    radius: np.ndarray


def cluster(vectors: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Centres of unit vectors by cosine, at most k, and the number of each vector's centre. The first is the vector nearest
    to the mean, each further one that which is farthest from those before; ties go to the first."""
    mean = vectors.mean(axis=0)
    chosen = [int(np.argmax(vectors @ mean))]
    near = vectors @ vectors[chosen[0]]
    while len(chosen) < min(k, len(vectors)) and near.min() < 1 - 1e-6:
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, vectors @ vectors[chosen[-1]])
    centres = vectors[chosen].copy()
    for _ in range(rounds):
        own = np.argmax(vectors @ centres.T, axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                total = vectors[own == c].sum(axis=0)
                centres[c] = total / max(float(np.sqrt(total @ total)), 1e-30)
    return centres, np.argmax(vectors @ centres.T, axis=1)


def _teaching(docs: DataFrame, lang: str, held_out: Column | None) -> DataFrame:
    out = fold(F.col("doc_id"), 5) == 0 if held_out is None else held_out
    return docs.where(~out & F.col(lang).isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))


def frequencies(taught: DataFrame) -> tuple[np.ndarray, dict[str, int]]:
    """The documents that hold each bucket, and the documents with letters of each language, over all of `taught`."""

    def run(batches):
        total, of_lang = np.zeros(BUCKETS, dtype=np.int64), {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for start, counts in blocks(batch.column(0).to_pylist()):
                total += (counts > 0).sum(axis=0)
                for lang, some in zip(langs[start : start + len(counts)], counts.any(axis=1)):
                    if some:
                        of_lang[lang] = of_lang.get(lang, 0) + 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([None] * at.size + list(of_lang), pa.string()), pa.array([*at.tolist(), *[-1] * len(of_lang)], pa.int32()), pa.array([*total[at].tolist(), *of_lang.values()], pa.int64())], ["lang", "bucket", "docs"])

    found = taught.select("text", "lang").mapInArrow(run, "lang string, bucket int, docs bigint").groupBy("lang", "bucket").agg(F.sum("docs").alias("docs"))
    # BUCKETS rows, and one for each language, of which there may be MOST_LANGUAGES.
    rows = found.limit(BUCKETS + MOST_LANGUAGES + 1).collect()
    if len(rows) > BUCKETS + MOST_LANGUAGES or sum(r.lang is not None for r in rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    often = np.zeros(BUCKETS, dtype=np.int64)
    for r in rows:
        if r.lang is None:
            often[r.bucket] = r.docs
    return often, {r.lang: r.docs for r in rows if r.lang is not None}


def fit(docs: DataFrame, lang: str = "lang", held_out: Column | None = None, sample: int = SAMPLE) -> Model:
    """Learns from the rows of docs (doc_id, text and the column `lang`) that are not held out."""
    small_batches(docs.sparkSession)
    taught = _teaching(docs, lang, held_out)
    often, size = frequencies(taught)
    languages = sorted(size, key=str.encode)
    idf = 1 + np.log((1 + sum(size.values())) / (1 + often))
    if not languages:
        return Model([], idf, np.zeros(0, int), np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        for batch in batches:
            found = []
            for _, counts in blocks(batch.column(0).to_pylist()):
                found += [(at.astype(np.uint16).tobytes(), v.astype(np.float32).tobytes()) for at, v in weighted(counts, shared.value)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([a for a, _ in found], pa.binary()), pa.array([v for _, v in found], pa.binary())], ["lang", "order", "at", "weight"])

    def of_language(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "at", "weight"])
        vectors = np.zeros((len(pdf), BUCKETS), dtype=np.float32)
        for row, at, weight in zip(vectors, pdf["at"], pdf["weight"]):
            row[np.frombuffer(at, np.uint16)] = np.frombuffer(weight, np.float32)
        centres, own = cluster(vectors)
        far = 1 - np.einsum("ij,ij->i", vectors, centres[own])
        radius = SLACK * float(np.quantile(far, QUANTILE))
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "number": range(len(centres)), "centre": [c.tobytes() for c in centres], "radius": radius})

    # About twice the sample by hash, then the first of them: both for each language, and the rows with the
    # smallest hash in any task are enough for the second.
    order = F.xxhash64("doc_id", "text", F.lit(17))
    share = F.lit(1.0)
    for name, n in size.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, 2.0 * sample / n))).otherwise(share)
    some = taught.select("text", "lang", order.alias("order")).where(F.pmod(F.shiftright("order", 11), F.lit(1 << 30)) < share * (1 << 30))
    vectors = some.mapInArrow(run, "lang string, order bigint, at binary, weight binary").where(F.octet_length("at") > 0)
    first = Window.partitionBy("lang").orderBy("order", "at", "weight")
    chosen = vectors.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= sample).drop("_k")
    found = chosen.groupBy("lang").applyInPandas(of_language, "lang string, number int, centre binary, radius double").toArrow()
    rows = sorted(zip(found["lang"].to_pylist(), found["number"].to_pylist(), found["centre"].to_pylist(), found["radius"].to_pylist()), key=lambda r: (r[0].encode(), r[1]))
    place = {name: i for i, name in enumerate(languages)}
    return Model(languages, idf, np.array([place[r[0]] for r in rows]), np.stack([np.frombuffer(r[2], np.float32) for r in rows], axis=1), np.array([r[3] for r in rows]))


def nearest(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, cosine and whether it is rejected, for each text."""
    found, cosine, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
    for start, counts in blocks(texts) if model.languages else ():
        for k, (at, v) in enumerate(weighted(counts, model.idf), start):
            if at.size:
                near = v @ model.centres[at]
                best = int(np.argmax(near))
                found[k], cosine[k] = model.languages[model.owner[best]], min(max(float(near[best]), 0.0), 1.0)
                rejected[k] = 1 - cosine[k] > model.radius[best] or cosine[k] == 0
    return found, cosine, rejected


def predict(docs: DataFrame, model: Model, name: str = "lang_pred", text: str = "text") -> DataFrame:
    """docs with `name`, score and rejected."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in (name.lower(), "score", "rejected")])
    at = docs.columns.index(text)
    schema = StructType([*docs.schema.fields, StructField(name, StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])

    def run(batches):
        for batch in batches:
            langs, score, rejected = nearest(batch.column(at).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score), pa.array(rejected)], [*batch.schema.names, name, "score", "rejected"])

    return docs.mapInArrow(run, schema)

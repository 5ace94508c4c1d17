"""Helpers that several operators share: tables, the shared folder, batches of texts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an Arrow batch may hold when texts travel in it.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder. Where
    neither is set, a folder of our own, which the context then keeps, if driver and executors are one process, and an
    error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    held = sc.getCheckpointDir()
    if not root and held:
        root = held
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="wayline-shared-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    if not held:
        sc.setCheckpointDir(root)
    return with_scheme(root)


def with_scheme(path: str) -> str:
    """file:/a, /a -> file:///a; other URIs stay."""
    if path.startswith("/"):
        return f"file://{path}"
    if path.startswith("file:/") and not path.startswith("file://"):
        return f"file://{path[5:]}"
    return path.rstrip("/")


#: Paths that this driver has given out and not released.
_GIVEN: list[str] = []


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    _GIVEN.append(f"{shared_root(spark)}/wayline-{what}-{uuid.uuid4().hex}")
    return _GIVEN[-1]


def given() -> int:
    """How many paths are given out, for release()."""
    return len(_GIVEN)


def release(spark: SparkSession, since: int, keep: str = "") -> None:
    """Deletes what lies at the paths given out since then, but for one. For when all that reads them has run."""
    for path in [p for p in _GIVEN[since:] if p != keep]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _GIVEN.remove(path)


def staged(df: DataFrame, what: str, rows_per_file: int = 0) -> DataFrame:
    """Writes df to the shared folder and reads it again, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch(spark, what)
    writer = df.write.option("compression", "zstd")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_fs(uri: str):
    """(file system, path) of a URI in the shared folder, on a driver or an executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(with_scheme(uri))


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts small; a smaller session setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, mod modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def runs(texts: list[str | None], most: int) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts (null: empty) of about `most` characters together, with the first one's index."""
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text or ""
        if held and size + len(text) > most:
            yield start, held
            start, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield start, held


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()

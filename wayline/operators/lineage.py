"""Cutting lineage in iterative plans."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder. Where
    neither is set, a folder of our own, which the context then keeps, if driver and executors are one process, and an
    error on a cluster."""
    sc = spark.sparkContext
    root, held = spark.conf.get("spark.checkpoint.dir", None), sc.getCheckpointDir()
    if not root and not held:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="wayline-shared-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    if not held:
        sc.setCheckpointDir(root)
    return (root or held).rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/wayline-{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint()


@contextmanager
def _set(spark: SparkSession, **values: str):
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


#: A checkpoint keeps what its plan knows about columns; in loops that grows with the rounds until planning takes most of the time.
_NO_FACTS = {"spark.sql.constraintPropagation.enabled": "false"}
#: Without adaptive changes a checkpoint keeps the partitioning that was asked for.
_AS_PLANNED = {"spark.sql.adaptive.enabled": "false"}


def turn(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, for a table that is made anew from itself in each round of a loop: what
    is read knows nothing of the plan that made it, whereas a checkpoint keeps what its plan knows about columns."""
    path = scratch(df.sparkSession, "turn")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held(df: DataFrame, *keys: str) -> DataFrame:
    """A checkpoint that is partitioned by the keys and sorted by them inside its partitions, and known to be: joins on the keys
    move and sort the other side only, however often it is read."""
    shared_root(df.sparkSession)
    with _set(df.sparkSession, **_AS_PLANNED):
        return df.repartition(*keys).sortWithinPartitions(*keys).checkpoint()


def kept_in_place(df: DataFrame) -> DataFrame:
    """turn(), with the partitioning that df's plan has."""
    shared_root(df.sparkSession)
    with _set(df.sparkSession, **_AS_PLANNED, **_NO_FACTS):
        return df.checkpoint()


def numbered(df: DataFrame, *keys: str, name: str = "place") -> DataFrame:
    """df with the place of each row, from 0, in the order of the keys, which tell all rows apart. Places come from sorted
    range partitions and their sizes, not from one sorted task."""
    part = cut(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    # A row for each partition.
    sizes = part.groupBy("_part").agg(F.count("*").alias("_c"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1 + F.col("_base")
    return part.join(F.broadcast(offset), "_part").withColumn(name, place).drop("_part", "_base")

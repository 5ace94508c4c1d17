"""Size-tiered compaction of immutable Parquet shards under a versioned manifest.

An arrival is appended as small shard files. Shards whose sizes are within a factor of FANOUT form a tier;
once a tier below the target holds FANOUT shards or more, they are merged into files of about the target's
size, without a shuffle: the partitions that read them are coalesced. Every change is a new manifest
version, a JSON file; it is written aside and renamed, which fails if another
writer has taken the version, and then the change is tried again on the new state. Readers use one
version and never see half a change. vacuum() removes files that the last versions do not list.

A version's file holds the shards that came and went; every SNAPSHOT-th one lists all live shards, so that a commit
writes as much as it changes and a reader reads SNAPSHOT files at most. An entry is a shard file's name, bytes and
version, never rows; files of failed or repeated tasks are in none. The rename must fail where the target exists: it does
on HDFS and local file systems; an object store needs a connector that gives the same.

Defined results: an empty arrival makes a version without shards; null and repeated rows are kept as they
are, texts of any length too; all columns are kept, and arrivals must have the columns of the first; a store without an
arrival cannot be read.
"""

from __future__ import annotations

import json
import math
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .shared import with_scheme

TARGET, FANOUT, SMALLEST = 128 << 20, 4, 1 << 16
#: Versions from one full list to the next.
SNAPSHOT = 32


class Taken(Exception):
    """Another writer has committed this version."""


class Store:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.fanout = spark, with_scheme(root), target, fanout
        jvm = spark._jvm
        self.path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)
        self.fs.mkdirs(self.path("manifest"))

    # Manifest

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path("manifest"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            return {"version": 0, "schema": None, "shards": []}
        version = known[-1] if version is None else version
        changes = []
        while "shards" not in (found := self.load(version - len(changes))):
            changes.append(found)
        shards = {x["file"]: x for x in found["shards"]}
        for change in reversed(changes):
            for name in change["removed"]:
                del shards[name]
            shards |= {x["file"]: x for x in change["added"]}
        return {"version": version, "schema": (changes[0] if changes else found)["schema"], "shards": list(shards.values())}

    def load(self, version: int) -> dict:
        stream = self.fs.open(self.path(f"manifest/v{version:012d}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def commit(self, state: dict, before: dict | None = None) -> None:
        """Makes the state its version's manifest, or raises Taken. before: the version's predecessor, where only the
        difference is to be written."""
        if before is not None and before["version"] and state["version"] % SNAPSHOT != 1:
            old, new = {x["file"] for x in before["shards"]}, {x["file"] for x in state["shards"]}
            state = {"version": state["version"], "schema": state["schema"], "added": [x for x in state["shards"] if x["file"] not in old], "removed": sorted(old - new)}
        aside, final = self.path(f"manifest/.{uuid.uuid4().hex}"), self.path(f"manifest/v{state['version']:012d}.json")
        stream = self.fs.create(aside, False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.conf).rename(aside, final, options)
        except Py4JJavaError as e:
            self.fs.delete(aside, False)
            if "AlreadyExists" in str(e.java_exception.getClass().getName()):
                raise Taken(state["version"]) from None
            raise

    def change(self, apply) -> dict:
        """Commits apply(state), again on newer states if others are faster."""
        while True:
            state = self.manifest()
            new = apply(state)
            if new is None:
                return state
            new["version"] = state["version"] + 1
            try:
                self.commit(new, state)
                return new
            except Taken:
                continue

    # Shards

    def write(self, df: DataFrame, rows: int = 0) -> list[dict]:
        folder = f"data/{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        (writer.option("maxRecordsPerFile", rows) if rows else writer).parquet(f"{self.root}/{folder}")
        found = [(s.getPath().getName(), s.getLen()) for s in self.fs.listStatus(self.path(folder))]
        return [{"file": f"{folder}/{n}", "bytes": size} for n, size in sorted(found) if n.endswith(".parquet")]

    def append(self, df: DataFrame, rows: int = 0) -> dict:
        """Adds an arrival as shards of at most `rows` rows."""
        shards = self.write(df, rows)
        schema = json.loads(df.schema.json())
        names = df.columns

        def apply(state):
            if state["schema"] and [f["name"] for f in state["schema"]["fields"]] != names:
                raise ValueError("an arrival must have the columns of the store")
            return {"schema": state["schema"] or schema, "shards": state["shards"] + [s | {"since": state["version"] + 1} for s in shards]}

        return self.change(apply)

    def tier(self, size: int) -> int:
        return int(math.log(max(size, SMALLEST) / SMALLEST, self.fanout))

    def due(self, state: dict) -> list[dict] | None:
        """The shards of the lowest tier that is full."""
        tiers: dict[int, list[dict]] = {}
        for s in state["shards"]:
            if 2 * s["bytes"] <= self.target:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        full = [t for t, own in tiers.items() if len(own) >= self.fanout]
        return tiers[min(full)] if full else None

    def frame(self, schema: dict, shards: list[dict]) -> DataFrame:
        kind = StructType.fromJson(schema)
        if not shards:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.root}/{s['file']}" for s in shards])

    def compact(self) -> dict:
        """Merges until no tier is full."""
        while True:
            state = self.manifest()
            run = self.due(state)
            if run is None:
                return state
            files = max(1, math.ceil(sum(s["bytes"] for s in run) / self.target))
            made = self.write(self.frame(state["schema"], run).coalesce(files))
            gone = {s["file"] for s in run}

            def apply(now, gone=gone, made=made):
                if not gone <= {s["file"] for s in now["shards"]}:
                    return None  # another writer has merged some of them: its result stands
                return now | {"shards": [s for s in now["shards"] if s["file"] not in gone] + [s | {"since": now["version"] + 1} for s in made]}

            self.change(apply)

    def vacuum(self, keep: int = 1) -> None:
        """Removes data files that none of the last `keep` versions lists. For times without writers."""
        listed = {s["file"] for v in self.versions()[-keep:] for s in self.manifest(v)["shards"]}
        folders = {f.rpartition("/")[0] for f in listed}
        if not self.fs.exists(self.path("data")):
            return
        for folder in self.fs.listStatus(self.path("data")):
            name = f"data/{folder.getPath().getName()}"
            if name not in folders:
                self.fs.delete(folder.getPath(), True)
                continue
            for s in self.fs.listStatus(folder.getPath()):
                if f"{name}/{s.getPath().getName()}" not in listed:
                    self.fs.delete(s.getPath(), False)

    def read(self, version: int | None = None) -> DataFrame:
        state = self.manifest(version)
        if not state["schema"]:
            raise ValueError("the store has no arrival yet")
        return self.frame(state["schema"], state["shards"])

"""WARC archives as a chunked record table.

A record's payload travels as rows of at most CHUNK bytes, (record_id, chunk, data), in order, each with
the SHA-1 of the payload so far; neither the writer nor the reader holds a whole record. Archives are
gzip files with a member for each record, about ROLL bytes each, in the folder that driver and executors
share. A task writes files under names of its own and gives their names as rows; only the names in the
committed list are read, so that files of lost or repeated tasks count for nothing.

Of records with equal payloads of at least LEAST bytes the one with the largest page_id is the response
and the others revisit it. Payloads are compared by SHA-256; the comparison moves digests only, a group of
copies is reduced to its largest id before the join, groups of one are left out, and no group's rows meet in
one task. The revisits, ids and digests, are then joined to the rows: as long as the planner finds them small
enough to be broadcast the payloads stay where they are read, beyond that they are shuffled once, by id and digest.

Every record has an id of its own, a random UUID, also where page_ids repeat or are null; the page_id and the
page that a revisit refers to are header fields of their own, beside the address of that page.

Defined results: a null html is an empty payload; rows without a page_id rank below all others in their
group, so they are responses only where no row of the group has an id; rows that repeat both the largest
page_id and the payload are all responses; other columns of the table are not archived. A null url is
written as about:blank.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import join_spread
from .shared import open_fs, scratch, small_batches, staged

CHUNK, ROLL, LEAST = 1 << 16, 64 << 20, 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Header fields of the page_id and of the page_id that a revisit refers to; a record without the first has none.
PAGE, REFERS = "Wayline-Page-ID", "Wayline-Refers-To-Page-ID"


FACTS = ["page_id", "url", "bytes", "sha1", "kind", "refers_to", "refers_url"]


def records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages: page_id, url, html. Adds nothing to the rows but digests and the decision: page_id, url,
    payload, bytes, sha1, kind, refers_to, refers_url."""
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    facts = rows.select("page_id", "url", F.octet_length("payload").cast("bigint").alias("bytes"), F.sha2("payload", 256).alias("same")).where(F.col("bytes") >= least)
    top = F.max(F.struct("page_id", "url")).alias("top")
    groups = staged(facts.groupBy("same").agg(top, F.count("*").alias("n")).where("n > 1 and top.page_id is not null"), "groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    moved = join_spread(facts.select("page_id", "same"), groups, "same", total).where("page_id is null or page_id < top.page_id")
    moved = staged(moved.select("page_id", "same", "top").distinct(), "revisits").select(F.col("page_id").alias("other"), F.col("same").alias("digest"), "top")
    rows = rows.withColumns({"bytes": F.octet_length("payload").cast("bigint"), "sha1": F.sha1("payload"), "same": F.sha2("payload", 256)})
    joined = rows.join(moved, rows["page_id"].eqNullSafe(moved["other"]) & (rows["same"] == moved["digest"]), "left")
    return joined.select("page_id", "url", "payload", "bytes", "sha1", F.when(F.col("top").isNull(), "response").otherwise("revisit").alias("kind"), F.col("top.page_id").alias("refers_to"), F.col("top.url").alias("refers_url"))


def chunks(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunked record table of records(): a row for each chunk, one without data for an empty or revisited payload."""
    last = F.when((F.col("kind") == "revisit") | (F.col("bytes") == 0), 0).otherwise(F.floor((F.col("bytes") - 1) / size)).cast("int")
    cut = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
    data = F.when(F.col("kind") == "revisit", F.lit(b"")).otherwise(F.substring("payload", F.col("chunk") * size + 1, F.lit(size)))
    return cut.select(*FACTS, "chunk", data.alias("data"))


def _uri(url: str | None) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url) if url else "about:blank"


def head(row: dict, date: str) -> bytes:
    """A record's WARC header and the HTTP header that begins its block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
    block = len(http) + (row["bytes"] if row["kind"] == "response" else 0)
    digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
    lines = ["WARC/1.1", f"WARC-Type: {row['kind']}", f"WARC-Record-ID: <{uuid.uuid4().urn}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_uri(row['url'])}"]
    lines += [] if row["page_id"] is None else [f"{PAGE}: {row['page_id']}"]
    lines += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if row["kind"] == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Target-URI: {_uri(row['refers_url'])}", f"WARC-Refers-To-Date: {date}", f"{REFERS}: {row['refers_to']}"]
    return ("\r\n".join([*lines, f"Content-Length: {block}"]) + "\r\n\r\n").encode() + http


class _Writer:
    """Archive files of one task."""

    def __init__(self, folder: str, roll: int):
        self.folder, self.roll, self.out, self.made = folder, roll, None, []

    def begin(self, first: bytes) -> None:
        if self.out is None:
            self.uri = f"{self.folder}/{uuid.uuid4().hex}.warc.gz"
            fs, path = open_fs(self.uri)
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            self.out, self.count = fs.open_output_stream(path, compression=None), 0
        self.member = zlib.compressobj(1, zlib.DEFLATED, 31)
        self.out.write(self.member.compress(first))
        self.digest, self.size = hashlib.sha1(), 0

    def add(self, data: bytes) -> None:
        self.digest.update(data)
        self.size += len(data)
        self.out.write(self.member.compress(data))

    def end(self, row: dict) -> None:
        if row["kind"] == "response" and (self.digest.hexdigest() != row["sha1"] or self.size != row["bytes"]):
            raise ValueError(f"page {row['page_id']}: the chunks are not the payload")
        self.out.write(self.member.compress(b"\r\n\r\n") + self.member.flush())
        self.count += 1
        if self.out.tell() >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            size = self.out.tell()
            self.out.close()
            self.made.append((self.uri, self.count, size))
            self.out = None


def write(table: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z", roll: int = ROLL) -> DataFrame:
    """Writes a chunked record table, whose chunks follow each other in their partition, as archives.
    Returns the committed list: uri, records, bytes."""
    small_batches(table.sparkSession)
    def run(batches):
        writer, open_row = _Writer(folder, roll), None
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                if columns["chunk"][i].as_py() == 0:
                    if open_row:
                        writer.end(open_row)
                    open_row = {n: columns[n][i].as_py() for n in FACTS}
                    writer.begin(head(open_row, date))
                writer.add(columns["data"][i].as_py())
        if open_row:
            writer.end(open_row)
        writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in writer.made], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["uri", "records", "bytes"])

    return staged(table.mapInArrow(run, "uri string, records bigint, bytes bigint"), "archives")


def _headers(stream) -> tuple[str, dict[str, str]]:
    first = stream.readline()
    found = {}
    while (line := stream.readline()) not in (b"\r\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return first.decode("ascii", "replace").strip(), found


def parse(stream, size: int = CHUNK):
    """Chunks of the records of an archive: (page_id, kind, refers_to, bytes, declared digest, chunk, last, data, digest so far).
    bytes: of the full payload, also for revisits."""
    number = lambda x: None if x is None else int(x)
    while True:
        version, warc = _headers(stream)
        if not version:
            return
        if not version.startswith("WARC/"):
            raise ValueError(f"no record begins with {version[:40]!r}")
        before = stream.tell()
        _, http = _headers(stream)
        left = int(warc["content-length"]) - (stream.tell() - before)
        full = int(http["content-length"])
        declared = base64.b32decode(warc["warc-payload-digest"].rpartition(":")[2]).hex()
        digest, chunk = hashlib.sha1(), 0
        while True:
            data = stream.read(min(size, left))
            if left and not data:
                raise ValueError("an archive ends inside a record")
            left -= len(data)
            digest.update(data)
            yield number(warc.get(PAGE.lower())), warc["warc-type"], number(warc.get(REFERS.lower())), full, declared, chunk, not left, data, digest.hexdigest()
            chunk += 1
            if not left:
                break
        if stream.readline() != b"\r\n" or stream.readline() != b"\r\n":
            raise ValueError("a record lacks its end")


FIELDS = [("page_id", pa.int64()), ("kind", pa.string()), ("refers_to", pa.int64()), ("bytes", pa.int64()), ("declared", pa.string()), ("chunk", pa.int64()), ("last", pa.bool_()), ("data", pa.binary()), ("sha1", pa.string())]


def read(spark: SparkSession, archives: DataFrame, size: int = CHUNK, batch_bytes: int = 4 << 20) -> DataFrame:
    """The chunked record table of the archives in the list: FIELDS. sha1 is of the payload up to the chunk."""

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = open_fs(uri)
                with fs.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    held, room = [], batch_bytes
                    for row in parse(stream, size):
                        held.append(row)
                        room -= len(row[7]) + 200
                        if room <= 0:
                            yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in held], t) for k, (_, t) in enumerate(FIELDS)], [n for n, _ in FIELDS])
                            held, room = [], batch_bytes
                    yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in held], t) for k, (_, t) in enumerate(FIELDS)], [n for n, _ in FIELDS])

    uris = archives.select("uri")
    dealt = uris.repartition(max(1, uris.count()))
    return dealt.mapInArrow(run, "page_id bigint, kind string, refers_to bigint, bytes bigint, declared string, chunk bigint, last boolean, data binary, sha1 string")


def round_trip(pages: DataFrame, least: int = LEAST, size: int = CHUNK, roll: int = ROLL) -> DataFrame:
    """Writes the pages and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    table = read(spark, write(chunks(records(pages, least), size), scratch(spark, "warc"), roll=roll), size)
    whole = table.where("last").select("page_id", "kind", "refers_to", "bytes", "declared", "sha1")
    checked = F.when((F.col("kind") == "response") & (F.col("sha1") != F.col("declared")), F.raise_error(F.lit("a payload read back differs from its digest"))).otherwise(F.col("declared"))
    return whole.select("page_id", F.col("bytes").alias("payload_bytes"), checked.alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")

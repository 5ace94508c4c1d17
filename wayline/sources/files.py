"""Readers. Every schema is stated; nothing is inferred, so codes keep their leading zeros."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATION = "_name string, _lon string, _lat string, _country string, _UTC string"
TRAIN = (
    "_id string, _tableNumber string, _country string, _fileName string, _daySign string, _trainType string, trainNumber array<string>, refNumber array<string>, "
    "station array<struct<_stop_id: string, _name: string, _arrive: string, _depart: string, _UTC: string, _table_from: string, ref: array<string>>>"
)
TAGS = "tag array<struct<_k: string, _v: string>>"
OSM = {
    "node": f"_id bigint, _lon double, _lat double, {TAGS}",
    "way": f"_id bigint, nd array<struct<_ref: bigint>>, {TAGS}",
    "relation": f"_id bigint, member array<struct<_type: string, _ref: bigint>>, {TAGS}",
}
#: Names that a timetable file may use for our columns.
TIMETABLE = {"train_code": "train", "stop_id": "stop_id", "station_name": "station", "arrive_time": "arr", "depart_time": "dep"}


def csv(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8") -> DataFrame:
    """CSV, also gzipped. Spreadsheets have no reader here."""
    if path.lower().endswith((".xls", ".xlsx")):
        raise ValueError("spreadsheets must be turned into CSV first")
    allow_charset(spark, encoding)
    return spark.read.csv(path, schema=schema, header=True, encoding=encoding)


def allow_charset(spark: SparkSession, encoding: str) -> None:
    """Lets the session use an encoding beyond Spark's own short list, such as GBK."""
    if not encoding.lower().startswith(("utf", "us-ascii", "iso-8859-1")):
        spark.conf.set("spark.sql.legacy.javaCharsets", True)


def lookup(table: DataFrame, key: str, value: str, row: str) -> DataFrame:
    """key, value; of repeated keys the last row counts."""
    return table.groupBy(key).agg(F.max_by(value, row).alias(value))


def repeated_keys(table: DataFrame, key: str) -> DataFrame:
    return table.groupBy(key).count().where("count > 1")


def missing_keys(rows: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Keys of rows that the dimension lacks, for inner look-ups that must not lose rows unseen."""
    return rows.select(key).distinct().join(dim.select(key), key, "left_anti")


def is_known(rows: DataFrame, dim: DataFrame, key: str, other: str, name: str = "known") -> DataFrame:
    """rows with whether their key is in the dimension."""
    held = dim.select(F.col(other).alias(key)).distinct().withColumn(name, F.lit(True))
    return rows.join(held, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def two_way(table: DataFrame, a: str, b: str, row: str) -> tuple[DataFrame, DataFrame]:
    """a -> b and b -> a; of repeated keys the last row counts, on each side."""
    return lookup(table, a, b, row), lookup(table, b, a, row)


def fast_trains(stops: DataFrame, train: str = "train") -> DataFrame:
    return stops.where(F.col(train).rlike("^(C|D|G)"))


def stations_xml(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", "station").schema(STATION).load(path)
    return rows.select(*[F.col(c).alias(c[1:].lower() if c != "_UTC" else "time_zone") for c in rows.columns])


def trains_xml(spark: SparkSession, path: str) -> DataFrame:
    """A row for each stop of each train, times as HHMM integers in UTC, null where missing."""
    from ..functions.timeops import to_utc

    rows = spark.read.format("xml").option("rowTag", "train").schema(TRAIN).load(path)
    stops = rows.select(F.col("_id").alias("train"), F.coalesce("_daySign", F.lit("1234567")).alias("day_sign"), F.coalesce("_trainType", F.lit("")).alias("train_type"), "trainNumber", F.posexplode("station").alias("seq", "s"))
    clock = lambda c: F.when(F.col(c).try_cast("int") >= 0, to_utc(F.col(c).try_cast("int"), F.coalesce(F.col("s._UTC").try_cast("int"), F.lit(0))))
    return stops.select("train", "day_sign", "train_type", F.col("trainNumber").alias("numbers"), "seq", F.col("s._name").alias("station"), clock("s._arrive").alias("arr"), clock("s._depart").alias("dep"), F.col("s._UTC").try_cast("int").alias("zone"))


def train_links_xml(spark: SparkSession, path: str) -> DataFrame:
    """For each train the records that it was merged with and those it may be connected with."""
    link = "array<struct<_id: string, _tableNumber: string, _country: string, _fileName: string>>"
    rows = spark.read.format("xml").option("rowTag", "train").schema(f"_id string, merge_with {link}, possibly_connected_with {link}").load(path)
    named = lambda c: F.transform(F.coalesce(c, F.array().cast(link)), lambda m: F.struct(*[m[f"_{f}"].alias(f) for f in ("id", "tableNumber", "country", "fileName")]))
    return rows.select(F.col("_id").alias("train"), named("merge_with").alias("merged"), named("possibly_connected_with").alias("possible"))


def trains_json(answers: DataFrame, kind: str = "K", column: str = "json") -> DataFrame:
    """Trains of one kind from answers that list them by day and kind, each once: code, source, target, number."""
    from ..functions.text import station_pair

    days = F.map_values(F.from_json(column, "map<string, map<string, array<struct<station_train_code: string, train_no: string>>>>"))
    one = F.flatten(F.transform(days, lambda d: F.coalesce(d[kind], F.array().cast("array<struct<station_train_code: string, train_no: string>>"))))
    pair = station_pair(F.col("t.station_train_code"))
    rows = answers.select(F.explode(one).alias("t")).select(*[F.get(pair, F.lit(k)).alias(c) for k, c in enumerate(("code", "source", "target"))], F.col("t.train_no").alias("number"))
    return rows.where(F.startswith("code", F.lit(kind))).distinct()


def osm_xml(spark: SparkSession, path: str) -> DataFrame:
    """Elements with type, id, lon, lat, tags, nds, members."""
    out = None
    for kind, schema in OSM.items():
        rows = spark.read.format("xml").option("rowTag", kind).schema(schema).load(path)
        tags = F.map_from_entries(F.array_distinct(F.transform(F.coalesce("tag", F.array().cast(TAGS.split(" ", 1)[1])), lambda t: F.struct(t["_k"], t["_v"]))))
        some = lambda c, e, t: e if c in rows.columns else F.lit(None).cast(t)  # noqa: E731, B023
        own = rows.select(
            F.lit(kind).alias("type"), F.col("_id").alias("id"), some("_lon", F.col("_lon") if "_lon" in rows.columns else None, "double").alias("lon"),
            some("_lat", F.col("_lat") if "_lat" in rows.columns else None, "double").alias("lat"), tags.alias("tags"),
            some("nd", F.transform("nd", lambda n: n["_ref"]) if "nd" in rows.columns else None, "array<bigint>").alias("nds"),
            some("member", F.transform("member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"))) if "member" in rows.columns else None, "array<struct<type: string, ref: bigint>>").alias("members"),
        )
        out = own if out is None else out.unionByName(own)
    return out


def leg_lines(spark: SparkSession, path: str) -> DataFrame:
    """code, seq, dep, dep_t, arr, arr_t, info from lines like ('K1', [['a', 10, 'b', 20, 'A->B'], ...]); the text is
    matched, never evaluated. Of lines with one code the last in file order counts."""
    lines = spark.read.text(path).withColumn("at", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()))
    rows = lines.select(F.regexp_extract("value", "^\\s*\\(\\s*'([^']*)'", 1).alias("code"), "value", "at").where("code <> ''")
    rows = rows.groupBy("code").agg(F.max_by("value", "at").alias("value"))
    leg = "\\[\\s*('?[^',\\[\\]]+'?)\\s*,\\s*(-?[0-9]+)\\s*,\\s*('?[^',\\[\\]]+'?)\\s*,\\s*(-?[0-9]+)\\s*,\\s*'([^']*)'\\s*\\]"
    parts = rows.select("code", F.posexplode(F.regexp_extract_all("value", F.lit(leg), F.lit(0))).alias("seq", "leg"))
    part = lambda k: F.regexp_extract("leg", leg, k)
    return parts.select("code", "seq", F.btrim(part(1), F.lit("'")).alias("dep"), part(2).cast("int").alias("dep_t"), F.btrim(part(3), F.lit("'")).alias("arr"), part(4).cast("int").alias("arr_t"), part(5).alias("info"))


def paths(spark: SparkSession, root: str, suffix: str = "") -> DataFrame:
    """Files below a folder, by suffix."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root).select("path")


def find_file(found: DataFrame, name: str) -> DataFrame:
    """The first path that has the name as a part."""
    return found.where(F.array_contains(F.split("path", "/"), name)).orderBy("path").limit(1)


def json_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", True).json(path, multiLine=True)


def outlines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rings of one region from a table of nested list texts: lons, lats as arrays of arrays."""
    rows = csv(spark, path, "name string, lons string, lats string").where(F.col("name") == name)
    return rows.select("name", F.from_json("lons", "array<array<double>>").alias("lons"), F.from_json("lats", "array<array<double>>").alias("lats"))


def raster(pixels: DataFrame, positive: bool, box: tuple[float, float, float, float] | None = None, open_east: bool = False) -> DataFrame:
    """Pixel rows (row, col, value, x, y) by value and box; the pushed-down filter of image readers."""
    from ..functions.geo import in_box, in_box_open_east

    out = pixels.where("value > 0") if positive else pixels
    if box is None or box == (-180, 180, -90, 90):
        return out
    return out.where((in_box_open_east if open_east else in_box)(F.col("x"), F.col("y"), *box))


def table_rows(pages: DataFrame, width: int = 6) -> DataFrame:
    """Cells of the rows of HTML tables, rows of another width left out: page_id, pos, cells."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("pos", "row"))
    cells = F.transform(F.regexp_extract_all("row", F.lit("(?s)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda c: F.btrim(F.regexp_replace(c, "<[^>]*>", "")))
    return rows.withColumn("cells", cells).where(F.size("cells") == width).select("page_id", "pos", "cells")


def without_rows(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """Pages that gave no rows, to be asked for again."""
    return pages.select("page_id").join(rows.select("page_id").distinct(), "page_id", "left_anti")


def info_box(pages: DataFrame) -> DataFrame:
    """dt and dd texts of a page as a map; of repeated names the last counts."""
    texts = lambda tag: F.transform(F.regexp_extract_all("html", F.lit(f"(?s)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1)), lambda c: F.btrim(F.regexp_replace(c, "<[^>]*>", "")))
    pairs = pages.select("page_id", F.posexplode(F.arrays_zip(texts("dt").alias("k"), texts("dd").alias("v"))).alias("pos", "p")).where("p.k is not null and p.v is not null")
    last = pairs.groupBy("page_id", F.col("p.k").alias("k")).agg(F.max_by("p.v", "pos").alias("v"))
    return last.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("facts"))


FLIGHT = "struct<flightNumber: string, departureAirportInfo: struct<cityName: string, cityTlc: string, airportName: string, airportTlc: string>, arrivalAirportInfo: struct<cityName: string, cityTlc: string, airportName: string, airportTlc: string>, departureDate: string, arrivalDate: string, punctualityRate: string>"
SEARCH = f"data struct<routeList: array<struct<legs: array<struct<flight: {FLIGHT}, characteristic: struct<lowestPrice: string>>>>>>"


def flights_json(answers: DataFrame, column: str = "json") -> DataFrame:
    """Flights of search answers, of routes with exactly one leg."""
    from ..functions.timeops import iso_clock

    routes = answers.select(F.explode(F.from_json(column, SEARCH)["data"]["routeList"]).alias("r")).where("size(r.legs) = 1").select(F.col("r.legs")[0].alias("leg"))
    f = "leg.flight"
    return routes.select(
        F.col(f"{f}.flightNumber").alias("flight"), F.col(f"{f}.departureAirportInfo.airportTlc").alias("source"), F.col(f"{f}.arrivalAirportInfo.airportTlc").alias("target"),
        iso_clock(F.col(f"{f}.departureDate")).alias("depart"), iso_clock(F.col(f"{f}.arrivalDate")).alias("arrive"), F.col("leg.characteristic.lowestPrice").alias("price"),
    )

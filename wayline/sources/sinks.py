"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import timeops as T
from .files import allow_charset


def csv(df: DataFrame, path: str, gzip: bool = False, encoding: str = "UTF-8") -> None:
    allow_charset(df.sparkSession, encoding)
    df.write.csv(path, header=True, compression="gzip" if gzip else "none", encoding=encoding)


def json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def json_document(df: DataFrame, path: str, rows: int = 10_000) -> None:
    """Indented JSON documents, each an array of about `rows` rows, in a folder for each."""
    part = F.floor(F.monotonically_increasing_id() / rows)
    held = df.select(part.alias("part"), F.struct(*df.columns).alias("row")).groupBy("part").agg(F.collect_list("row").alias("rows"))
    held.select("part", F.to_json("rows", {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).write.partitionBy("part").text(path)


def xml(df: DataFrame, path: str, row: str, root: str) -> None:
    """Columns that begin with _ are attributes."""
    df.write.format("xml").option("rowTag", row).option("rootTag", root).save(path)


def parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def osm_xml(elements: DataFrame, path: str) -> None:
    """Elements (type, id, lon, lat, tags, nds, members) as OSM XML, a folder below path for each kind."""
    tag = F.transform(F.map_entries("tags"), lambda e: F.struct(e["key"].alias("_k"), e["value"].alias("_v"))).alias("tag")
    own = {
        "node": [F.col("lon").alias("_lon"), F.col("lat").alias("_lat")], "way": [F.transform("nds", lambda n: F.struct(n.alias("_ref"))).alias("nd")],
        "relation": [F.transform("members", lambda m: F.struct(m["type"].alias("_type"), m["ref"].alias("_ref"))).alias("member")],
    }
    for kind, columns in own.items():
        xml(elements.where(F.col("type") == kind).select(F.col("id").alias("_id"), *columns, tag), f"{path}/{kind}", kind, "osm")


def service_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """Drops and makes the table anew, in the warehouse or at a path."""
    writer = df.write.mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def point_text(lon: str = "lon", lat: str = "lat"):
    return F.concat(F.lit("POINT ("), F.col(lon).cast("string"), F.lit(" "), F.col(lat).cast("string"), F.lit(")"))


def line_text(line):
    """WKT of an array of structs lon, lat."""
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(line, lambda p: F.concat(p["lon"].cast("string"), F.lit(" "), p["lat"].cast("string"))), ", "), F.lit(")"))


def edge_lines(edges: DataFrame, places: DataFrame) -> DataFrame:
    """Edges as WKT lines; both ends must have places."""
    from ..operators.graph import located

    ends = F.array(*[F.struct(F.col(f"lon{k}").alias("lon"), F.col(f"lat{k}").alias("lat")) for k in (1, 2)])
    return located(edges, places).withColumn("wkt", line_text(ends))


def with_names(places: DataFrame, names: DataFrame, key: str, other: str) -> DataFrame:
    """Places with another name, '' where there is none."""
    return places.join(names.select(key, other), key, "left").withColumn(other, F.coalesce(other, F.lit("")))


def train_rows(stops: DataFrame, countries: DataFrame | None = None) -> DataFrame:
    """Stops as printed rows: hh:mm in UTC, '--' where missing, stop ids from 0, the true code of type and first number
    (train_type, numbers), and the station's country (countries: station, country; '' where unknown)."""
    optional = lambda c, e: e if c in stops.columns else F.lit("")
    number = F.coalesce(F.get("numbers", F.lit(0)), F.lit("")) if "numbers" in stops.columns else F.lit("")
    rows = stops.withColumn("country", F.lit("")) if countries is None else stops.join(countries, "station", "left").withColumn("country", F.coalesce("country", F.lit("")))
    return rows.select(
        F.col("train").alias("train_code"), F.col("seq").alias("stop_id"), F.col("station").alias("station_name"), T.hhmm_clock("arr").alias("arrive_time"), T.hhmm_clock("dep").alias("depart_time"),
        optional("zone", F.col("zone")).alias("time_zone"), F.concat(optional("train_type", F.col("train_type")), number).alias("true_train_code"), "country",
    )


#: What a record may say of the trains it was merged with, or may be connected with; all texts.
LINK = ["id", "tableNumber", "country", "fileName"]


def trains_xml(stops: DataFrame, path: str, meta: DataFrame | None = None) -> None:
    """Trains with their stops in local time, four digits. meta: train and any of train_type, day_sign, numbers, references
    (arrays of texts), merged, possible (arrays of structs of LINK's fields, of which different ones are written once)."""
    from ..functions.text import without_marks

    local = lambda c: T.zero_filled(T.to_local(c, F.coalesce("zone", F.lit(0))), 4)
    stop = F.struct("seq", without_marks(F.col("station")).alias("_name"), local("arr").alias("_arrive"), local("dep").alias("_depart"), F.col("zone").cast("string").alias("_UTC"))
    trains = stops.groupBy("train").agg(F.array_sort(F.collect_list(stop)).alias("s"))
    if meta is not None:
        trains = trains.join(meta, "train", "left")
    held = lambda c, e: [e] if c in trains.columns else []

    def links(c: str, tag: str) -> list:
        if c not in trains.columns:
            return []
        fields = [f.name for f in trains.schema[c].dataType.elementType.fields if f.name in LINK]
        return [F.transform(F.array_distinct(c), lambda m: F.struct(*[m[f].cast("string").alias(f"_{f}") for f in fields])).alias(tag)]

    number = lambda x: without_marks(x.cast("string"))
    station = F.transform("s", lambda x: F.struct(x["seq"].cast("string").alias("_stop_id"), x["_name"], x["_arrive"], x["_depart"], x["_UTC"]))
    xml(
        trains.select(
            F.col("train").alias("_id"), *held("day_sign", F.col("day_sign").alias("_daySign") if "day_sign" in trains.columns else None),
            *held("train_type", without_marks(F.col("train_type")).alias("_trainType") if "train_type" in trains.columns else None),
            *links("merged", "merge_with"), *links("possible", "possibly_connected_with"),
            *held("numbers", F.transform("numbers", number).alias("trainNumber") if "numbers" in trains.columns else None),
            *held("references", F.transform("references", lambda r: r.cast("string")).alias("refNumber") if "references" in trains.columns else None), station.alias("station"),
        ),
        path, "train", "trains",
    )

"""OSM elements: type, id, lon, lat, tags map, nds array of ids, members array of structs type, ref."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as N
from . import lineage

# Tag names and values of OpenStreetMap here and in the filters below, among them a misspelt one.
ROADS = ["motorway", "trunk", "primary", "secondary", "tertiary"]


def _tag(name: str) -> Column:
    return F.coalesce(F.col("tags")[name], F.lit(""))


def _city_rail() -> Column:
    return F.greatest(*[(_tag(k) == "yes").cast("int") for k in ("subway", "light_rail", "tram", "bus", "monorail")]) == 1


def is_station() -> Column:
    """Railway stops, without those of city rail; the misspelt value is one that occurs."""
    bad = _tag("railway").isin("abandoned", "disused", "ligh_rail", "subway") | _tag("station").isin("light_rail", "subway", "monorail")
    return ~_city_rail() & ~bad & _tag("railway").isin("stop", "station", "halt", "stop_position")


def is_railway() -> Column:
    return ~_city_rail() & ((_tag("route") == "rail") | (_tag("railway") == "rail"))


def roads(elements: DataFrame) -> DataFrame:
    return elements.where(_tag("highway").isin(*ROADS, *[f"{r}_link" for r in ROADS]))


def with_tags(elements: DataFrame, keys: list[str], pairs: dict[str, list[str]]) -> DataFrame:
    """Elements with any of the keys, or a key with one of its values; distinct by type and id."""
    held = F.lit(False)
    for k in keys:
        held = held | F.map_contains_key("tags", k)
    for k, values in pairs.items():
        held = held | _tag(k).isin(values)
    return elements.where(held).dropDuplicates(["type", "id"])


def merged(*tables: DataFrame) -> DataFrame:
    """Union without repeated (type, id); of repeated ones that of the first table stays."""
    out = None
    for k, t in enumerate(tables):
        own = t.select(*tables[0].columns).withColumn("_table", F.lit(k))
        out = own if out is None else out.union(own)
    columns = [c for c in tables[0].columns if c not in ("type", "id")]
    held = out.groupBy("type", "id").agg(F.min_by(F.struct(*columns), "_table").alias("_s")) if columns else out.select("type", "id").distinct()
    return held.select("type", "id", *[f"_s.{c}" for c in columns]).select(*tables[0].columns)


def way_lines(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """id and line: places of the way's nodes in order; nodes that are not there are left out."""
    refs = ways.select("id", F.posexplode("nds").alias("pos", "ref"))
    found = refs.join(nodes.select(F.col("id").alias("ref"), "lon", "lat"), "ref")
    return found.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("line"))


def _named(elements: DataFrame) -> DataFrame:
    names = F.array_distinct(F.transform(F.filter(F.map_entries("tags"), lambda e: F.contains(e["key"], F.lit("name"))), lambda e: e["value"]))
    sign = N.distance_sign(F.col("tags"))
    kind = F.when(sign, "useless").otherwise(_tag("railway"))
    return elements.withColumns({"kind": kind, "names": F.when(sign, F.array().cast("array<string>")).otherwise(F.coalesce(names, F.array().cast("array<string>")))})


def places(elements: DataFrame, own_names: bool = True) -> DataFrame:
    """name, id, lon, lat, type, element: a row for each name of nodes, ways and relations that are no other's member.
    A way stands at the component-wise median of its nodes, a relation at that of its nodes, ways and relations, and both
    have their members' names and, with own_names, their own. Kilometre signs are left out. Relations are worked out from
    the innermost outwards, in rounds; of relations that hold each other none has a place."""
    named = _named(elements.where("type in ('node', 'way', 'relation')"))
    nodes = named.where("type = 'node'").select("type", "id", "lon", "lat", "names", "kind")
    refs = named.where("type = 'way'").select("type", "id", "names", "kind", F.explode_outer(F.transform("nds", lambda r: F.struct(F.lit("node").alias("type"), r.alias("ref")))).alias("m"))
    ways = _joined(refs, nodes, own_names)
    refs2 = named.where("type = 'relation'").select("type", "id", "names", "kind", F.explode_outer("members").alias("m"))
    relations = _relations(refs2, nodes.union(ways), own_names)
    members = refs.select("m.*").union(refs2.select("m.*")).select(F.col("type"), F.col("ref").alias("id")).distinct()
    whole = nodes.union(ways).union(relations).where("lon is not null and kind <> 'useless'").join(members, ["type", "id"], "left_anti")
    return whole.select(F.explode("names").alias("name"), "id", "lon", "lat", F.col("kind").alias("type"), F.col("type").alias("element"))


def _relations(refs: DataFrame, held: DataFrame, own_names: bool) -> DataFrame:
    """Relations whose relations are all worked out, round by round until none is ready, however deep they lie; those that
    wait for each other come last, without a place."""
    refs = lineage.cut(refs)
    inner = refs.where("m.type = 'relation'").select("id", F.col("m.ref").alias("ref")).join(refs.select(F.col("id").alias("ref")).distinct(), "ref", "left_semi").distinct()
    if inner.isEmpty():
        return _joined(refs, held, own_names)
    done = None
    left = refs
    while True:
        waits = inner if done is None else inner.join(done.select(F.col("id").alias("ref")), "ref", "left_anti")
        ready = left.join(waits.select("id").distinct(), "id", "left_anti")
        if ready.isEmpty():
            break
        found = _joined(ready, held if done is None else held.unionByName(done), own_names)
        done = lineage.cut(found if done is None else done.unionByName(found))
        left = lineage.cut(left.join(done.select("id"), "id", "left_anti"))
    rest = _joined(left, held.limit(0), own_names)
    return rest if done is None else done.unionByName(rest)


def _joined(refs: DataFrame, held: DataFrame, own_names: bool) -> DataFrame:
    inner = held.select(F.col("type").alias("m_type"), F.col("id").alias("m_id"), "lon", "lat", F.col("names").alias("m_names"))
    rows = refs.join(inner, (F.col("m.type") == F.col("m_type")) & (F.col("m.ref") == F.col("m_id")), "left")
    out = rows.groupBy("type", "id", "kind", "names").agg(F.median("lon").alias("lon"), F.median("lat").alias("lat"), F.flatten(F.collect_list("m_names")).alias("more"))
    every = F.array_union(F.col("more"), F.col("names")) if own_names else F.array_distinct("more")
    return out.select("type", "id", "lon", "lat", F.sort_array(every).alias("names"), "kind")


def modal_level(units: DataFrame) -> DataFrame:
    """folder, level, kind: the most common kind of unit of each level, ties to the first by position."""
    counted = units.groupBy("folder", "level", "kind").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return counted.groupBy("folder", "level").agg(F.max_by("kind", F.struct("n", -F.col("first"))).alias("kind"))


def chosen_level(modal: DataFrame) -> DataFrame:
    """The level of each folder whose modal kind is District or County, or else the one before the first Commune or
    Municipal level; else the last."""
    fine = F.min(F.when(F.col("kind").isin("District", "County"), F.col("level")))
    before = F.min(F.when(F.col("kind").isin("Commune", "Municipal"), F.col("level"))) - 1
    return modal.groupBy("folder").agg(F.coalesce(fine, before, F.max("level")).alias("level"))


def numbered(elements: DataFrame) -> DataFrame:
    """Elements in the order of (type, id), with their place in it."""
    return lineage.numbered(elements, "type", "id")


def by_id(elements: DataFrame, wanted: int) -> DataFrame:
    """The first element with the id, nodes before ways before relations."""
    order = F.when(F.col("type") == "node", 0).when(F.col("type") == "way", 1).otherwise(2)
    return elements.where(F.col("id") == wanted).orderBy(order).limit(1)


def of_country(rows: DataFrame, country) -> DataFrame:
    return rows.where(F.col("country") == country)


def boundaries(rows: DataFrame) -> DataFrame:
    """rows: file (its level stands before the first '.'), row, code, names and types by level from 0. All files as one
    table: code, country, name (names of levels 1 to the file's, a ';' after each), type, row; of a file of level 0 only the
    first row, whose name is the country's."""
    level = N.level_of_file(F.col("file")).cast("int")
    first = F.when(F.col("level") == 0, F.row_number().over(Window.partitionBy("file").orderBy("row"))).otherwise(1)
    rows = rows.withColumn("level", level).withColumn("_first", first).where("_first = 1")
    inner = F.aggregate(F.slice("names", F.lit(2), F.greatest("level", F.lit(1))), F.lit(""), lambda s, x: F.concat(s, x, F.lit(";")))
    country = F.get("names", F.lit(0))
    name, kind = F.when(F.col("level") == 0, country).otherwise(inner), F.when(F.col("level") == 0, "Country").otherwise(F.get("types", F.col("level")))
    return rows.select("code", country.alias("country"), name.alias("name"), kind.alias("type"), "row")


def after_first(files: DataFrame) -> DataFrame:
    """Files of each folder in the order of their names, without the first."""
    return files.withColumn("_k", F.row_number().over(Window.partitionBy("folder").orderBy("file"))).where("_k > 1").drop("_k")

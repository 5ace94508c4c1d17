"""Queries of single functions and small operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import text as N
from ..operators import graph, linkage, osm, spatial, stats, timetable
from ..sources import files, sinks
from . import views as V
from .catalogue import ORACLE_SQL, _distance, query

# Filters and look-ups


@query(f"{V.sql('stops')} select train, seq, station from stops where train = 7")
def one_train(spark, d):
    return timetable.of_train(V.stops(spark, d), 7).select("train", "seq", "station")


@query("select c_custkey as id, c_name as name from customer where c_nationkey = 3")
def one_country(spark, d):
    c = V.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("country"))
    return osm.of_country(c, 3).select("id", "name")


@query("select 'node' as type, c_custkey as id from customer where c_custkey = 5")
def element_by_id(spark, d):
    return osm.by_id(V.elements(spark, d), 5).select("type", "id")


@query("select event_id, case when value >= 20.5 then value end as value from events")
def masked_small(spark, d):
    return V.table(spark, d, "events").select("event_id", spatial.masked(F.col("value"), 20.5).alias("value"))


@query("""with p as (select c_custkey as pid, c_custkey % 7 / 4.0 as x, c_custkey % 5 / 4.0 as y, c_custkey % 3 / 4.0 as sx, c_custkey % 11 / 4.0 as sy from customer)
select pid, pow(x - sx, 2) + pow(y - sy, 2) <= 1 as open, case when pid % 2 = 0 then pow(x - sx, 2) + pow(y - sy, 2) <= 1 else pow(sx - x, 2) + pow(sy - y, 2) <= 1 and pow(x - y, 2) + pow(y - x, 2) <= 1 end as ok from p""")
def route_valid(spark, d):
    k = F.col("c_custkey")
    p = V.table(spark, d, "customer").select(k.alias("pid"), *[(k % n / 4.0).cast("double").alias(c) for n, c in ((7, "x"), (5, "y"), (3, "sx"), (11, "sy"))])
    at = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    none = F.array().cast("array<struct<lon: double, lat: double>>")
    steps = F.when(F.col("pid") % 2 == 0, none).otherwise(F.array(at("sx", "sy"), at("y", "x")))
    # Without steps the ends are compared; with steps both ends of the way.
    return p.select("pid", G.route_ends_fit(at("x", "y"), at("sx", "sy"), none, 1.0).alias("open"), F.when(F.col("pid") % 2 == 0, G.route_ends_fit(at("x", "y"), at("sx", "sy"), steps, 1.0)).otherwise(G.route_ends_fit(at("x", "y"), at("x", "y"), steps, 1.0)).alias("ok"))


def _stations(spark, d):
    k = F.col("s_suppkey")
    return V.table(spark, d, "supplier").select(k.alias("station"), (k % 360 - 180).cast("double").alias("lon"), (k % 120 - 60).cast("double").alias("lat"))


_ST = "st as (select s_suppkey as station, (s_suppkey % 360 - 180)::double as lon, (s_suppkey % 120 - 60)::double as lat from supplier)"


@query(f"with {_ST}, q as (select distinct l_suppkey % 150 as a, l_partkey % 150 as b from lineitem) select q.a, q.b, x.station is not null as known, case when x.station is null or y.station is null then -1 else round({_distance('x.lon', 'x.lat', 'y.lon', 'y.lat')}, 6) end as km from q left join st x on x.station = q.a left join st y on y.station = q.b")
def station_distance(spark, d):
    q = V.table(spark, d, "lineitem").select((F.col("l_suppkey") % 150).alias("a"), (F.col("l_partkey") % 150).alias("b")).distinct()
    known = files.is_known(q, _stations(spark, d), "a", "station")
    return timetable.station_distances(known, _stations(spark, d)).select("a", "b", "known", F.round("km", 6).alias("km"))


@query(f"with {_ST} select distinct l_partkey % 1500 as station from lineitem where l_partkey % 1500 not in (select station from st)")
def unknown_stations(spark, d):
    return files.missing_keys(V.table(spark, d, "lineitem").select((F.col("l_partkey") % 1500).alias("station")), _stations(spark, d), "station")


@query(f"{V.sql('edges')} select src, count(*) as count from edges group by src having count(*) > 1")
def repeated_ids(spark, d):
    return files.repeated_keys(V.edges(spark, d), "src")


@query("select s_suppkey as id, s_nationkey as code, (select max(b.s_suppkey) from supplier b where b.s_nationkey = a.s_nationkey) as back from supplier a")
def two_way_codes(spark, d):
    s = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("code"), F.col("s_suppkey").alias("row"))
    forward, back = files.two_way(s, "id", "code", "row")
    return forward.join(back.select("code", F.col("id").alias("back")), "code").select("id", "code", "back")


# Clocks, geography and texts


@query("with p as (select pid, x * 50000 as mx, y * 80000 as my from (select c_custkey as pid, ((c_custkey * 7919) % 36000)::double / 100 - 180 as x, ((c_custkey * 104729) % 14000)::double / 100 - 70 as y from customer)), t as (select *, asin(my / (6378137.0 * sqrt(2::double))) as theta from p) select pid, round(degrees(pi() * mx / (2 * 6378137.0 * sqrt(2::double) * cos(theta))), 6) as lon, round(degrees(asin((2 * theta + sin(2 * theta)) / pi())), 6) as lat from t")
def mollweide(spark, d):
    lon, lat = G.mollweide_to_degrees(F.col("x") * 50000, F.col("y") * 80000)
    return V.points(spark, d).select("pid", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("""with p as (select event_id, (event_id * 7919 % 5000 - 1)::double as f, event_id % 3 <> 0 as fo, (event_id * 104729 % 7000 - 1)::double as b, event_id % 4 <> 0 as bo, (event_id % 90)::double as km from events),
q as (select *, nullif(f, -1) as g, nullif(b, -1) as h from p)
select event_id, case when fo and (g = 0 or km / (nullif(g, 0) / 3600) > 40) then g when bo and h is not null then least(g, h, km / 5 * 3600) else -1 end as seconds from q""")
def drive_time(spark, d):
    k = F.col("event_id")
    f, b = (k * 7919 % 5000 - 1).cast("double"), (k * 104729 % 7000 - 1).cast("double")
    return V.table(spark, d, "events").select("event_id", G.drive_time(f, k % 3 != 0, b, k % 4 != 0, (k % 90).cast("double")).alias("seconds"))


@query("select event_id, round(case when value - 20 > 0 then ln(value - 20 + 1) end, 9) as shade, (event_id % 7 - 3) * (event_id % 11 - 5) - (event_id % 5 - 2) * (event_id % 13 - 6) as turn from events")
def shade_and_turn(spark, d):
    k, z = F.col("event_id"), F.lit(0)
    turn = G.turn(z, z, k % 7 - 3, k % 5 - 2, k % 13 - 6, k % 11 - 5)
    return V.table(spark, d, "events").select("event_id", F.round(G.log_shade(F.col("value") - 20), 9).alias("shade"), turn.alias("turn"))


@query("""with p as (select p_partkey, p_name || case when p_partkey % 3 = 0 then ' Hbf' when p_partkey % 3 = 1 then ' Hbf x' else '' end as s, 'K' || p_partkey || '(' || split_part(p_name, ' ', 1) || '-' || split_part(p_name, ' ', 2) || ')' as c from part)
select p_partkey, case when ends_with(s, 'Hbf') then replace(s, 'Hbf', 'Hauptbahnhof') else s end as full_name, 'K' || p_partkey as code, 'K' || p_partkey || '|' || split_part(p_name, ' ', 1) || '|' || split_part(p_name, ' ', 2) as pair,
'上海' || (p_partkey % 3) as cjk, (p_partkey % 6)::varchar as level from p join part using (p_partkey)""")
def text_parts(spark, d):
    p = V.table(spark, d, "part").select("p_partkey", "p_name", F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " Hbf").when(F.col("p_partkey") % 3 == 1, " Hbf x").otherwise("")).alias("s"))
    code = F.concat(F.lit("K"), F.col("p_partkey").cast("string"))
    first, second = (F.split_part("p_name", F.lit(" "), F.lit(k)) for k in (1, 2))
    pair = N.station_pair(F.concat(code, F.lit("("), first, F.lit("-"), second, F.lit(")")))
    runs = N.cjk_runs(F.concat(F.lit("a上海b"), F.col("p_name"), F.lit("上海")))
    path = F.concat(F.lit("/x.y/gadm_"), (F.col("p_partkey") % 6).cast("string"), F.lit(".shp.gz"))
    return p.select("p_partkey", N.full_station_name(F.col("s")).alias("full_name"), N.route_code(F.concat(code, F.lit(":a->b"))).alias("code"), F.array_join(F.filter(pair, lambda x: x != ""), "|").alias("pair"), F.concat(F.array_join(runs, "|"), (F.col("p_partkey") % 3).cast("string")).alias("cjk"), N.level_of_file(path).alias("level"))


@query("""select c_custkey as id, c_name as name, round(c_acctbal, 2) as lon, case when c_custkey % 4 <> 0 then (c_custkey % 90)::double end as lat, case when c_custkey % 5 = 0 then 'nan' else c_mktsegment end as country,
case when c_custkey % 3 = 0 then c_name || ';' else array_to_string(list_sort([c_name, c_mktsegment]), ';') || ';' end as synonyms, 'at ' || c_name as address from customer""")
def geocoder_results(spark, d):
    c = V.table(spark, d, "customer")
    k = F.col("c_custkey")
    text = lambda x: x.cast("string")
    details = F.when(k % 3 == 0, F.create_map(F.lit("name"), F.col("c_name"))).otherwise(F.create_map(F.lit("name"), F.col("c_name"), F.lit("alt"), F.col("c_mktsegment")))
    address = F.when(k % 5 != 0, F.create_map(F.lit("country"), F.col("c_mktsegment")))
    answer = F.to_json(F.struct(text(F.round("c_acctbal", 2)).alias("lon"), text(F.when(k % 4 != 0, k % 90)).alias("lat"), F.concat(F.lit("at "), F.col("c_name")).alias("display_name"), details.alias("namedetails"), address.alias("address")))
    return N.geocoder_fields(c.select(k.alias("id"), answer.alias("json")), "json").select("id", "name", "lon", "lat", "country", "synonyms", "address")


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, '{\"dep\":' || l_partkey || ',\"arr\":' || l_suppkey || '}' as key from lineitem")
def keys_as_text(spark, d):
    li = V.table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", N.key_text(F.col("l_partkey").alias("dep"), F.col("l_suppkey").alias("arr")).alias("key"))


# Grids, images and colours


@query(f"{V.sql('points')} select min(x) - 0.5 as left, max(x) + 0.5 as right, min(y) - 0.5 as down, max(y) + 0.5 as up, min(x) - 0.5 + (max(x) - min(x) + 1) / 2 as centre_lon, min(y) - 0.5 + (max(y) - min(y) + 1) / 2 as centre_lat from points")
def map_extent(spark, d):
    return spatial.extent(V.points(spark, d))


_PIXELS = "px as (select l_partkey % 40 as row, (l_suppkey + l_orderkey) % 50 as col, sum(l_quantity) - 60 as value from lineitem group by 1, 2)"


def _pixels(spark, d):
    li = V.table(spark, d, "lineitem")
    return li.groupBy((F.col("l_partkey") % 40).alias("row"), ((F.col("l_suppkey") + F.col("l_orderkey")) % 50).alias("col")).agg((F.sum("l_quantity") - 60).cast("double").alias("value"))


@query(f"with {_PIXELS} select row, array_to_string(list(coalesce((case when value > 0 then value end)::bigint::varchar, '-') order by col), ' ') as cells, (select max(row) - min(row) + 1 from px) as height, (select max(col) - min(col) + 1 from px) as width from px group by row")
def image_rows(spark, d):
    p = _pixels(spark, d)
    rows = spatial.dense(p).join(F.broadcast(spatial.image_shape(p)))  # one row
    return rows.select("row", F.array_join(F.transform("cells", lambda c: F.coalesce(c["value"].cast("bigint").cast("string"), F.lit("-"))), " ").alias("cells"), "height", "width")


@query(f"with {_PIXELS}, p as (select *, -180 + (col + 0.5) * 5 as x, 90 - (row + 0.5) * 4 as y from px) select row, col, x < 30 as open_east, value > 0 as positive from p where x between -120 and 30 and y between -40 and 60")
def raster_reads(spark, d):
    x, y = F.lit(-180.0) + (F.col("col") + 0.5) * 5, F.lit(90.0) - (F.col("row") + 0.5) * 4
    p = _pixels(spark, d).withColumns({"x": x, "y": y})
    box = (-120, 30, -40, 60)
    own = ["row", "col"]
    every, positive, east = files.raster(p, False, box), files.raster(p, True, box), files.raster(p, False, box, open_east=True)
    out = every.select(*own).join(positive.select(*own, F.lit(True).alias("positive")), own, "left").join(east.select(*own, F.lit(True).alias("open_east")), own, "left")
    return out.select(*own, F.coalesce("open_east", F.lit(False)).alias("open_east"), F.coalesce("positive", F.lit(False)).alias("positive"))


_SPLITS = "r as (select c_acctbal as value, row_number() over (order by c_acctbal) - 1 as place from customer), t as (select count(*) as n, max(c_acctbal) as top from customer), sp as (select k::int as k, value as split from (select unnest(range(1, 6)) as k), t join r on place = round_even(n / 6.0::double * k, 0)::bigint union all select 6, top from t)"


@query(f"with {_SPLITS} select s_suppkey as id, (select min(k) from sp where s_acctbal <= split) as bucket from supplier")
def colour_buckets(spark, d):
    splits = stats.split_points(V.table(spark, d, "customer").select(F.col("c_acctbal").alias("value")), 6)
    return stats.bucketed(V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("value")), splits).select("id", "bucket")


@query("select least(max(case when event_id % 2 = 0 then value end), 40)::double as top, min(value) as low, max(value) as high from events")
def colour_range(spark, d):
    e = V.table(spark, d, "events")
    whole = stats.value_range(e.select("value"))
    even = stats.value_range(e.where("event_id % 2 = 0").select("value"), high=None).select(F.least("high", F.lit(40.0)).alias("top"))
    return whole.select("low", "high").join(F.broadcast(even))  # one row


@query("""with m as (select min(o_totalprice) as low, max(o_totalprice) as high, count(*) as n from orders), b as (select least(floor((o_totalprice - low) / ((high - low) / 20)), 19)::int as bin, count(*) as c from orders, m group by 1)
select bin, round(low + bin * ((high - low) / 20), 4) as x, c as n, round(c / n / ((high - low) / 20), 12) as density from b, m""")
def value_histogram(spark, d):
    h = stats.histogram(V.table(spark, d, "orders").select(F.col("o_totalprice").cast("double").alias("value")), 20)
    return h.select("bin", F.round("x", 4).alias("x"), "n", F.round("density", 12).alias("density"))


@query("""with s as (select count(*) as n, stddev_samp(o_totalprice) as sd, min(o_totalprice)::double as low, max(o_totalprice)::double as high from orders), h as (select *, sd * pow(n, -0.2::double) as bw from s),
a as (select (o_totalprice - low) / (high - low) * 1000 as spot, low, high, bw, n from orders, h), i as (select *, least(floor(spot), 999) as i from a),
w as (select cell, low, high, bw, n, sum(w) as w from (select i as cell, 1 - (spot - i) as w, low, high, bw, n from i union all select i + 1, spot - i, low, high, bw, n from i) group by all),
g as (select *, unnest(range(0, 11)) as k from w)
select k::int as point, round(sum(w * exp(-pow((low + k * (high - low) / 10 - (low + cell * (high - low) / 1000)) / bw, 2) / 2)) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 12) as density from g group by k""")
def binned_density(spark, d):
    k = stats.binned_density(V.table(spark, d, "orders").select(F.col("o_totalprice").cast("double").alias("value")), 10)
    return k.select("point", F.round("density", 12).alias("density"))


@query("""with s as (select count(*) as n, stddev_samp(o_totalprice) as sd, min(o_totalprice) as low, max(o_totalprice) as high from orders), h as (select *, sd * pow(n, -0.2::double) as bw from s),
g as (select k, low + k * (high - low) / 10 as x, bw, n from h, (select unnest(range(0, 11)) as k))
select k::int as point, round(sum(exp(-pow((x - o_totalprice) / bw, 2) / 2)) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 12) as density from g, orders group by k""")
def value_density(spark, d):
    k = stats.density(V.table(spark, d, "orders").select(F.col("o_totalprice").cast("double").alias("value")), 10)
    return k.select("point", F.round("density", 12).alias("density"))


# Places, lines and graphs


@query(f"{V.sql('pairs2')}, {_ST} select a, b, w, 'LINESTRING (' || x.lon::varchar || ' ' || x.lat::varchar || ', ' || y.lon::varchar || ' ' || y.lat::varchar || ')' as wkt, case when abs(w) >= 100 then 'r' when abs(w) >= 50 then 'g' when abs(w) >= 15 then 'b' when abs(w) >= 2 then 'y' else 'lightgrey' end as shade from pairs2 join st x on x.station = a join st y on y.station = b")
def edge_lines(spark, d):
    places = _stations(spark, d).select(F.col("station").alias("node"), "lon", "lat")
    lines = sinks.edge_lines(graph.undirected(V.edges(spark, d)), places)
    return lines.select("a", "b", "w", "wkt", graph.shade(F.col("w")).alias("shade"))


@query(f"with {_ST} select station, 'POINT (' || lon::varchar || ' ' || lat::varchar || ')' as wkt, coalesce(n_name, '') as name from st left join nation on n_nationkey = station")
def place_texts(spark, d):
    names = V.table(spark, d, "nation").select(F.col("n_nationkey").alias("station"), F.col("n_name").alias("name"))
    return sinks.with_names(_stations(spark, d), names, "station", "name").select("station", sinks.point_text().alias("wkt"), "name")


@query(f"{V.sql('pairs2')}, u as (select a, b, w from pairs2 where a % 2 = 0 union all select a, b, w from pairs2 where a % 2 = 1), v as (select a, b, case when b % 3 = 0 then w + 1000 else w end as w from u) select coalesce(x.n_regionkey + 500, a) as a, coalesce(y.n_regionkey + 500, b) as b, w from v left join nation x on x.n_nationkey = a left join nation y on y.n_nationkey = b")
def composed_graph(spark, d):
    g = graph.undirected(V.edges(spark, d))
    both = graph.composed(g, g.where("b % 3 = 0").withColumn("w", F.col("w") + 1000))
    return graph.relabelled(both, V.table(spark, d, "nation").select(F.col("n_nationkey").alias("old"), (F.col("n_regionkey") + 500).alias("new"))).select("a", "b", "w")


@query(f"{V.sql('stops')}, {_ST} select train, array_to_string(list(lon::bigint::varchar || ' ' || lat::bigint::varchar order by seq), ', ') as line, count(*) as n from stops join st using (station) group by train")
def train_lines(spark, d):
    lines = timetable.train_lines(V.stops(spark, d), _stations(spark, d))
    return lines.select("train", F.array_join(F.transform("line", lambda p: F.concat(p["lon"].cast("bigint").cast("string"), F.lit(" "), p["lat"].cast("bigint").cast("string"))), ", ").alias("line"), F.size("line").cast("bigint").alias("n"))


@query(f"{V.sql('stops')}, {_ST} select distinct lon, lat from stops join st using (station)")
def train_points(spark, d):
    return timetable.train_points(V.stops(spark, d), _stations(spark, d))


@query(f"{V.sql('stops')}, o as (select distinct train, station, seq, lead(station) over (partition by train order by seq) as other from stops) select least(station, other) as a, greatest(station, other) as b, count(distinct train) as n from o where station <> other group by 1, 2")
def station_graph_direct(spark, d):
    return timetable.station_graph(V.stops(spark, d), "direct").groupBy("a", "b").agg(F.count("*").alias("n"))


@query(f"{V.sql('stops')} select 'trains' as kind, count(distinct train) as n from stops union all select 'stations', count(distinct station) from stops union all select 'fast', count(distinct train) from stops where train % 3 = 0")
def distinct_lists(spark, d):
    code = F.concat(F.when(F.col("train") % 3 == 0, "G").otherwise("K"), F.col("train").cast("string"))
    s = V.stops(spark, d).withColumn("code", code)
    trains, stations = timetable.train_list(s, "code"), timetable.station_list(s)
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count(trains, "trains").union(count(stations, "stations")).union(count(timetable.train_list(files.fast_trains(s, "code"), "code"), "fast"))


# OpenStreetMap elements and boundaries

_EL = "el as (select 'node' as type, c_custkey as id, (['motorway', 'primary_link', 'service', 'tertiary'])[c_custkey % 4 + 1] as highway, c_custkey % 3 = 0 as lit from customer union all select 'way', s_suppkey, 'trunk', false from supplier)"


def _road_elements(spark, d):
    k = F.col("c_custkey")
    kind = F.element_at(F.array(*map(F.lit, ["motorway", "primary_link", "service", "tertiary"])), (k % 4 + 1).cast("int"))
    tags = F.when(k % 3 == 0, F.create_map(F.lit("highway"), kind, F.lit("lit"), F.lit("yes"))).otherwise(F.create_map(F.lit("highway"), kind))
    nodes = V.table(spark, d, "customer").select(F.lit("node").alias("type"), k.alias("id"), tags.alias("tags"))
    return nodes, V.table(spark, d, "supplier").select(F.lit("way").alias("type"), F.col("s_suppkey").alias("id"), F.create_map(F.lit("highway"), F.lit("trunk")).alias("tags"))


@query(f"with {_EL} select type, id, highway from el where highway <> 'service'")
def road_filter(spark, d):
    nodes, ways = _road_elements(spark, d)
    return osm.roads(nodes.union(ways)).select("type", "id", F.col("tags")["highway"].alias("highway"))


@query(f"with {_EL} select type, id, row_number() over (order by type, id) - 1 as place from el where lit or highway in ('service', 'trunk')")
def transport_extract(spark, d):
    nodes, ways = _road_elements(spark, d)
    every = osm.merged(nodes, ways, nodes.where("id % 2 = 0"))
    found = osm.with_tags(every, ["lit"], {"highway": ["service", "trunk"]})
    return osm.numbered(found).select("type", "id", "place")


@query("""with u as (select c_custkey as pos, c_nationkey as folder, c_custkey % 4 as level, (['District', 'Province', 'Commune', 'Country'])[(c_custkey * 7 + c_nationkey) % 4 + 1] as kind from customer), c as (select folder, level, kind, count(*) as n, min(pos) as first from u group by 1, 2, 3),
m as (select folder, level, kind from c qualify row_number() over (partition by folder, level order by n desc, first) = 1)
select folder, coalesce(min(case when kind in ('District', 'County') then level end), min(case when kind in ('Commune', 'Municipal') then level end) - 1, max(level)) as level from m group by folder""")
def boundary_level(spark, d):
    k = F.col("c_custkey")
    kind = F.element_at(F.array(*map(F.lit, ["District", "Province", "Commune", "Country"])), ((k * 7 + F.col("c_nationkey")) % 4 + 1).cast("int"))
    u = V.table(spark, d, "customer").select(k.alias("pos"), F.col("c_nationkey").alias("folder"), (k % 4).alias("level"), kind.alias("kind"))
    return osm.chosen_level(osm.modal_level(u))


@query("""with f as (select 'gadm36_' || n_nationkey || '_' || (c_custkey % 3) || '.shp' as file, n_nationkey, n_name, c_custkey % 3 as level, c_custkey as row, 'N' || (c_custkey % 7) as name1, 'D' || c_custkey as name2 from customer join nation on n_nationkey = c_nationkey)
select n_nationkey as code, n_name as country, case level when 0 then n_name when 1 then name1 || ';' else name1 || ';' || name2 || ';' end as name, case level when 0 then 'Country' when 1 then 'Province' else 'District' end as type, row from f
qualify level > 0 or row_number() over (partition by file order by row) = 1""")
def boundary_union(spark, d):
    c, n = V.table(spark, d, "customer"), V.table(spark, d, "nation")
    k = F.col("c_custkey")
    rows = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.concat(F.lit("gadm36_"), F.col("n_nationkey").cast("string"), F.lit("_"), (k % 3).cast("string"), F.lit(".shp")).alias("file"), k.alias("row"), F.col("n_nationkey").alias("code"),
        F.array("n_name", F.concat(F.lit("N"), (k % 7).cast("string")), F.concat(F.lit("D"), k.cast("string"))).alias("names"), F.array(F.lit("Country"), F.lit("Province"), F.lit("District")).alias("types"),
    )
    return osm.boundaries(rows).select("code", "country", "name", "type", "row")


@query("with p as (select r_regionkey as poly, count(c_custkey)::double as population, (r_regionkey + 1) * 1000.0::double as area from region left join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey group by 1) select poly, population, area, round(population / area, 9) as density from p")
def population_table(spark, d):
    r, n, c = (V.table(spark, d, t) for t in ("region", "nation", "customer"))
    people = n.join(c, n.n_nationkey == c.c_nationkey).groupBy(F.col("n_regionkey").alias("poly")).agg(F.count("*").cast("double").alias("total"))
    areas = r.select(F.col("r_regionkey").alias("poly"), ((F.col("r_regionkey") + 1) * 1000.0).alias("area"))
    return spatial.population_table(areas, people).select("poly", "population", "area", F.round("density", 9).alias("density"))


@query("select event_type as file, min(event_id) as second from (select event_type, event_id, row_number() over (partition by event_type order by event_id) as k from events) where k > 1 group by 1")
def files_after_first(spark, d):
    e = V.table(spark, d, "events").select(F.col("event_type").alias("folder"), F.col("event_id").alias("file"))
    return osm.after_first(e).groupBy(F.col("folder").alias("file")).agg(F.min("file").alias("second"))


# Merged records


@query("""with m as (select user_id % 40 as train, event_id % 5 as ref from events), t as (select train, list_sort(list_distinct(list(ref))) as refs from m group by train)
select train, array_to_string(list_filter(refs, lambda x: x <> train % 5 and x <> (train + 1) % 5), ',') as refs from t""")
def open_references(spark, d):
    t = V.table(spark, d, "events").groupBy((F.col("user_id") % 40).alias("train")).agg(F.collect_set(F.col("event_id") % 5).alias("refs"))
    own = F.array(F.col("train") % 5, (F.col("train") + 1) % 5)
    return t.select("train", F.array_join(F.array_sort(linkage.open_references(F.slice("refs", 1, 2), F.col("refs"), own)), ",").alias("refs"))


@query("select user_id % 40 as train, count(distinct event_type || '|' || (event_id % 3)) as n from events group by 1")
def distinct_records(spark, d):
    meta = F.struct(F.col("event_type").alias("fileName"), (F.col("event_id") % 3).cast("string").alias("tableNumber"))
    t = V.table(spark, d, "events").groupBy((F.col("user_id") % 40).alias("train")).agg(F.collect_list(meta).alias("merged"))
    return t.select("train", F.size(linkage.distinct_records(F.col("merged"))).cast("bigint").alias("n"))


_MIN = "({0} // 100 * 60 + {0} % 100)"
_EVENTS = """e0 as (select train, seq, station, 'a.' as kind, arr as t0 from hhmm_stops where arr is not null union all select train, seq, station, 'd.', dep from hhmm_stops where dep is not null),
e1 as (select *, case when t0 < coalesce(lag(t0) over (partition by train order by seq, kind), 0) then 2400 else 0 end as back from e0),
e as (select train, seq, station, kind, (t0 + sum(back) over (partition by train order by seq, kind))::bigint as t from e1)"""


@query(f"""{V.sql("hhmm_stops")}, {_EVENTS}, m as (select train, coalesce(t > max(t) over (partition by train order by seq, kind rows between unbounded preceding and 1 preceding), true) as ok from e), k as (select train, bool_and(ok) as ok from m group by train),
{_ST}, r as (select train, seq, coalesce(arr, dep) as now, lag(coalesce(dep, arr)) over o as t, lon, lat, lag(lon) over o as lon0, lag(lat) over o as lat0 from hhmm_stops left join st using (station) window o as (partition by train order by seq)),
q as (select train, {_distance("lon0", "lat0", "lon", "lat")} as km, {_MIN.format("(case when now < t then now + 2400 else now end)")} - {_MIN.format("t")} as m from r), f as (select train, max(km / (m / 60.0)) as top from q where m > 0 and km > 0 group by train)
select k.train, ok and coalesce(top <= 2000, false) as ok, round(top, 6) as top from k left join f using (train)""")
def accepted_records(spark, d):
    s = V.hhmm_stops(spark, d)
    found, fastest = linkage.events(s), linkage.speeds(s, _stations(spark, d))
    ok = linkage.accepted(found, fastest, 2000.0)
    return ok.join(fastest.groupBy("train").agg(F.round(F.max("speed"), 6).alias("top")), "train", "left").select("train", "ok", "top")


@query(f"""{V.sql("hhmm_stops")}, z as (select *, station % 25 - 12 as zone from hhmm_stops), l as (select train, seq, station, case when arr + 100 * zone > 2400 then arr + 100 * zone - 2400 else arr + 100 * zone end as arr, case when dep + 100 * zone > 2400 then dep + 100 * zone - 2400 else dep + 100 * zone end as dep from z)
select train, seq, station, coalesce(arr, -1) as arrival, coalesce(dep, -1) as departure from l""")
def local_times(spark, d):
    return linkage.local_times(V.hhmm_stops(spark, d).withColumn("zone", F.col("station") % 25 - 12)).select("train", "seq", "station", "arrival", "departure")


@query("""with r as (select l_orderkey as train, l_suppkey as station, case when l_linenumber % 2 = 0 then 'a.' else 'd.' end as kind, case when l_linenumber % 5 = 0 then 'nan' else printf('%04d', (l_partkey * 7) % 24 * 100 + l_partkey % 60) end as time, l_orderkey * 10 + l_linenumber as row, l_suppkey % 9 - 4 as zone, l_returnflag = 'R' as italic, l_partkey % 30 as ref from lineitem),
u as (select *, case when time::int - 100 * zone < 0 then time::int - 100 * zone + 2400 else time::int - 100 * zone end as t from r where time <> 'nan')
select train, station, max(row * 10000 + t) filter (kind = 'a.') % 10000 as arr, max(row * 10000 + t) filter (kind = 'd.') % 10000 as dep, coalesce(array_to_string(list_sort(list_distinct(list(ref::varchar) filter (italic))), ','), '') as refs from u group by 1, 2""")
def records_from_rows(spark, d):
    k = F.col("l_partkey")
    time = F.when(F.col("l_linenumber") % 5 == 0, "nan").otherwise(F.format_string("%04d", (k * 7) % 24 * 100 + k % 60))
    rows = V.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("train"), F.col("l_suppkey").alias("station"), F.when(F.col("l_linenumber") % 2 == 0, "a.").otherwise("d.").alias("kind"), time.alias("time"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"), (F.col("l_suppkey") % 9 - 4).alias("zone"), (F.col("l_returnflag") == "R").alias("italic"), (k % 30).alias("ref"),
    )
    return linkage.from_rows(rows).select("train", "station", "arr", "dep", F.array_join(F.array_sort("refs"), ",").alias("refs"))


@query(f"{V.sql('stops')} select train, count(*) as n, true as observed from stops group by train")
def observed_rows(spark, d):
    rows, seen = stats.observed(V.stops(spark, d).groupBy("train").agg(F.count("*").alias("n")), "trains")
    return rows.withColumn("observed", F.lit(seen is not None))


@query(f"{V.sql('stops')}, w as (select *, lead(station) over (partition by train order by seq) as next from stops) select distinct station as parent, next as child from w where next is not null")
def scheme_tree(spark, d):
    from ..operators import routing

    return routing.scheme_tree(V.stops(spark, d).select(F.col("train").alias("scheme"), F.col("seq").alias("pos"), "station"))


_SIMS = """x as (select a.train as a, b.train as b, a.station, abs(({0}) - ({1})) as aa, abs(({2}) - ({3})) as dd, abs(({0}) - ({3})) as ad, abs(({2}) - ({1})) as da from records a join records b on a.station = b.station and a.train < b.train),
y as (select a, b, coalesce(aa, dd) as same, case when ad <= 25 then ad when da <= 25 then da end as near from x),
z as (select a, b, count(*) as shared, coalesce(sum((same <= 5)::int), 0) + max(case when same is null and near is not null then 1 else 0 end) as agree, sum(coalesce(same, near)) as off, bool_or(coalesce(same > 5, near is null)) as veto from y group by a, b)""".format(*[_MIN.format(c) for c in ("a.arr", "b.arr", "a.dep", "b.dep")])


@query(f"{V.sql('records')}, {_SIMS} select a, b, (case when a % 3 <> 0 and b % 3 <> 0 and a % 4 <> b % 4 then 100000.0 when veto or shared < 1 then 100000.0 when agree < 1 then 10000.0 else off / agree end)::double as score from z")
def similarity_by_number(spark, d):
    r = V.records(spark, d)
    numbers = r.select("train", (F.col("train") % 4).alias("number")).where("train % 3 <> 0")
    return linkage.similarity(r, 1, 5, 25, numbers)


@query(f"{V.sql('stops')}, s as (select distinct train, station from stops), p as (select distinct train as a, train + 1 as b from s where train % 2 = 0), x as (select a, b, station from p join s on train = a), y as (select a, b, station from p join s on train = b) select coalesce(x.a, y.a) as a, coalesce(x.b, y.b) as b, station, case when x.a is not null and y.a is not null then 'both' when x.a is not null then 'T' || x.a % 50 else 'T' || y.b % 50 end as table_from from x full join y using (a, b, station)")
def merged_sources(spark, d):
    s = V.stops(spark, d).select("train", "station")
    pairs = s.where("train % 2 = 0").select(F.col("train").alias("a"), (F.col("train") + 1).alias("b")).distinct()
    tables = s.select("train").distinct().select("train", F.concat(F.lit("T"), (F.col("train") % 50).cast("string")).alias("table"))
    return linkage.sources(pairs, s, tables)


@query("with t as (select distinct l_suppkey as source, l_partkey % 50 as target from lineitem), w as (select l_suppkey as source, l_partkey % 50 as target, min(l_quantity * 60) as seconds from lineitem where l_quantity > 25 group by 1, 2) select source, target, coalesce(seconds, -1)::double as seconds, case when seconds is null then 0 else 2 end as steps from t left join w using (source, target)")
def route_lookup(spark, d):
    from ..operators import routing

    li = V.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 50).alias("target"), "l_quantity")
    times = li.where("l_quantity > 25").select("source", "target", (F.col("l_quantity") * 60).cast("double").alias("seconds"), F.array(F.col("source").cast("double"), F.col("target").cast("double")).alias("steps"))
    found = routing.looked_up(li.select("source", "target").distinct(), times)
    return found.select("source", "target", "seconds", F.size("steps").alias("steps"))


@query("select p_partkey as page_id from part where p_partkey % 4 = 0")
def failed_pages(spark, d):
    p = V.table(spark, d, "part")
    cells = F.when(F.col("p_partkey") % 4 == 0, F.lit("<td>x</td>")).otherwise(F.repeat(F.lit("<td>x</td>"), 6))
    pages = p.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("<table><tr>"), cells, F.lit("</tr></table>")).alias("html"))
    return files.without_rows(pages, files.table_rows(pages))


@query("""select 'P' || p_partkey as name, min(case when p_partkey % 3 = 0 then 2 when p_partkey % 5 = 0 then 3 end) as place, -1.0::double as confidence from part where p_partkey % 3 = 0 or p_partkey % 5 = 0 group by 1""")
def gazetteer(spark, d):
    from ..operators import match

    p = V.table(spark, d, "part").select("p_partkey", F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("name"))
    far = F.array(F.lit("~~~~~~"), F.lit("?!"))
    own = F.array(F.lit("~~~~~~"), F.col("name"))
    k = F.col("p_partkey")
    places = [(1, 0, far), (2, 1, F.when(k % 3 == 0, own).otherwise(far)), (3, 2, F.when(k % 5 == 0, own).otherwise(far))]
    candidates = None
    for place, rank, names in places:
        rows = p.select("name", F.lit(place).alias("place"), F.lit(rank).alias("rank"), names.alias("names"))
        candidates = rows if candidates is None else candidates.union(rows)
    return match.accepted_candidates(candidates)


@query("""with n as (select c_custkey as id, (c_custkey % 360 - 180)::double as lon, (c_custkey % 120 - 60)::double as lat, c_nationkey as nation from customer), w as (select nation, median(lon) as lon, median(lat) as lat from n group by nation),
r as (select n_nationkey as id, n_regionkey as region, lon, lat from nation join w on nation = n_nationkey), g as (select region as id, median(lon) as lon, median(lat) as lat from r group by region)
select names.name, (g.id + 1000)::bigint as id, lon, lat, '' as type, 'relation' as element from g join (select n_regionkey as id, 'W' || n_nationkey as name from nation union select n_regionkey, 'R' || n_nationkey from nation union select r_regionkey, 'G' || r_regionkey from region) names on names.id = g.id""")
def nested_relations(spark, d):
    none = lambda t, c: F.lit(None).cast(t).alias(c)
    member = "array<struct<type: string, ref: bigint>>"
    c, n, r = (V.table(spark, d, t) for t in ("customer", "nation", "region"))
    named = lambda letter, key: F.create_map(F.lit("name"), F.concat(F.lit(letter), key.cast("string"))).alias("tags")
    k = F.col("c_custkey")
    nodes = c.select(F.lit("node").alias("type"), k.cast("bigint").alias("id"), (k % 360 - 180).cast("double").alias("lon"), (k % 120 - 60).cast("double").alias("lat"), F.create_map(F.lit("a"), F.lit("b")).alias("tags"), none("array<bigint>", "nds"), none(member, "members"))
    ways = c.groupBy("c_nationkey").agg(F.sort_array(F.collect_list(k.cast("bigint"))).alias("nds")).select(F.lit("way").alias("type"), F.col("c_nationkey").cast("bigint").alias("id"), none("double", "lon"), none("double", "lat"), named("W", F.col("c_nationkey")), "nds", none(member, "members"))
    of = lambda kind, key: F.struct(F.lit(kind).alias("type"), key.cast("bigint").alias("ref"))
    inner = n.select(F.lit("relation").alias("type"), F.col("n_nationkey").cast("bigint").alias("id"), none("double", "lon"), none("double", "lat"), named("R", F.col("n_nationkey")), none("array<bigint>", "nds"), F.array(of("way", F.col("n_nationkey"))).alias("members"))
    outer = n.groupBy("n_regionkey").agg(F.collect_list(of("relation", F.col("n_nationkey"))).alias("members")).select(F.lit("relation").alias("type"), (F.col("n_regionkey") + 1000).cast("bigint").alias("id"), none("double", "lon"), none("double", "lat"), named("G", F.col("n_regionkey")), none("array<bigint>", "nds"), "members")
    return osm.places(nodes.unionByName(ways).unionByName(inner).unionByName(outer))


@query("select (c_custkey % 360 - 180)::double as x, (c_custkey % 120 - 60)::double as y, c_name as label from customer")
def map_labels(spark, d):
    k = F.col("c_custkey")
    return spatial.labels(V.table(spark, d, "customer").select((k % 360 - 180).cast("double").alias("lon"), (k % 120 - 60).cast("double").alias("lat"), "c_name"), "c_name")


@query(f"{V.sql('stops')}, {_ST}, q as (select train, seq, lon, lat from stops join st using (station)) select train, (row_number() over w - 1)::int as pos, lon as x1, lat as y1, lead(lon) over w as x2, lead(lat) over w as y2 from q window w as (partition by train order by seq) qualify lead(lon) over w is not null")
def map_segments(spark, d):
    return spatial.segments(timetable.train_lines(V.stops(spark, d), _stations(spark, d)), "train")


@query("select p_partkey, p_name as stem, 'gadm36_' || (p_partkey % 6) as file, (p_partkey % 6)::varchar as level from part")
def file_names(spark, d):
    p = V.table(spark, d, "part")
    path = F.concat(F.lit("gadm36_"), (F.col("p_partkey") % 6).cast("string"), F.lit(".shp"))
    return p.select("p_partkey", N.without_end(F.concat("p_name", F.lit(".osm.pbf")), 8).alias("stem"), N.without_end(path, 4).alias("file"), N.level_of_file(path).alias("level"))


@query(f"with hulls as ({ORACLE_SQL['convex_hull']}), {V.sql('points').removeprefix('with ')}, names as (select c_nationkey as key, x, y, arg_min(c_name, c_custkey) as name from points join customer on c_custkey = pid group by 1, 2, 3) select key, pos, x, y, name from hulls join names using (key, x, y) where pos < (select max(pos) from hulls h where h.key = hulls.key)")
def hull_labels(spark, d):
    from ..operators import hull

    c = V.table(spark, d, "customer").select(F.col("c_custkey").alias("pid"), F.col("c_nationkey").alias("key"), F.col("c_name").alias("name"))
    points = V.points(spark, d).join(c, "pid")
    return hull.labelled(hull.convex_hulls(points), points.select("key", "x", "y", "name", F.col("pid").alias("row"))).select("key", "pos", "x", "y", "name")

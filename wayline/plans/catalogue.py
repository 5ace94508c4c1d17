"""Every query of the library by name, with its SQL for comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import text as N
from ..functions import timeops as T
from ..operators import flows, graph, hull, lineage, linkage, match, osm, routing, spatial, stats, tiles, timetable
from ..sources import files
from . import views as V

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _distance(x1, y1, x2, y2) -> str:
    return f"(2 * {G.RADIUS_KM} * asin(least(1.0, sqrt(pow(sin((radians({y2}) - radians({y1})) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin((radians({x2}) - radians({x1})) / 2), 2)))))"


PAIRS = f"pairs as (select a.name as org, b.name as dest, a.value as m, b.value as n, {_distance('a.lon', 'a.lat', 'b.lon', 'b.lat')} as d from places a join places b on a.name <> b.name)"


# Flows


@query(f"""{V.sql("places")}, {PAIRS}, s as (select *, coalesce(sum(n) over (partition by org order by d, dest rows between unbounded preceding and 1 preceding), 0) as s, (select sum(value) from places) as total from pairs)
select org, dest, s, round(1 / (1 - m / total) * (0.1 * m) * m * n / ((m + s) * (m + n + s)), 6) as flow from s""")
def radiation_flow(spark, d):
    return flows.radiation(V.places(spark, d)).withColumn("flow", F.round("flow", 6))


@query(f"{V.sql('places')}, {PAIRS} select org, dest, round(m * n / pow(d, 2), 6) as flow from pairs where dest < org and d <= 9000")
def gravity_flow(spark, d):
    return flows.gravity(V.places(spark, d), 9000).withColumn("flow", F.round("flow", 6))


#: Customers as places: those of the points, near the poles and the date line too.
_SPOTS = f"spots as (select pid as name, x as lon, y + case when y < 0 then -19 else 19 end as lat, abs(value)::double + 1 as value from points), near as (select * from (select a.name as org, b.name as dest, a.value as m, b.value as n, {_distance('a.lon', 'a.lat', 'b.lon', 'b.lat')} as d from spots a join spots b on a.name <> b.name) where d <= 350)"


def _spots(spark, d):
    y = F.col("y")
    return V.points(spark, d).select(F.col("pid").alias("name"), F.col("x").alias("lon"), (y + F.when(y < 0, -19).otherwise(19)).alias("lat"), (F.abs("value").cast("double") + 1).alias("value"))


@query(f"{V.sql('points')}, {_SPOTS} select org, dest, round(ln(m * n / nullif(pow(d, 2), 0)), 6) as log_flow from near where dest < org")
def gravity_within(spark, d):
    return flows.gravity(_spots(spark, d), 350.0).select("org", "dest", F.round(F.log("flow"), 6).alias("log_flow"))


@query(f"""{V.sql("points")}, {_SPOTS}, s as (select *, coalesce(sum(n) over (partition by org order by d, dest rows between unbounded preceding and 1 preceding), 0) as s, (select sum(value) from spots) as total from near)
select org, dest, round(s, 3) as s, round(ln(1 / (1 - m / total) * (0.1 * m) * m * n / ((m + s) * (m + n + s))), 6) as log_flow from s""")
def radiation_within(spark, d):
    return flows.radiation(_spots(spark, d), most=350.0).select("org", "dest", F.round("s", 3).alias("s"), F.round(F.log("flow"), 6).alias("log_flow"))


@query(f"{V.sql('places')}, {PAIRS} select org, dest, round(d, 6) as d, row_number() over (partition by org order by d, dest) as rank, round(exp(ln(m) + ln(n) - 2 * ln(d)) * 1e-4, 9) as pull from pairs")
def pair_distance(spark, d):
    p = flows.pair_distances(V.places(spark, d)).withColumn("pull", F.round(G.pull(F.col("m"), F.col("n"), F.col("d")), 9))
    ranked = flows.ranked_neighbours(V.places(spark, d)).select("org", "dest", "rank")
    return p.join(ranked, ["org", "dest"]).select("org", "dest", F.round("d", 6).alias("d"), "rank", "pull")


# Clocks

_M = "(try_cast(replace({0}, ':', '') as int) // 100 * 60 + try_cast(replace({0}, ':', '') as int) % 100)"


@query(f"""{V.sql("trips")}, p as (select event_id, clock as a, strftime(ts + interval 437 minute, '%H:%M') as b, event_id % 3 as k from trips),
g as (select event_id, a, b, k, {_M.format("b")} - {_M.format("a")} as m from p)
select event_id, case when m < 0 then m + 1440 else m end as gap, case when k <> 0 then m + 1440 * k when m < 0 then m + 1440 else m end as gap_days, (m + 1440 * k)::double as signed,
  lpad(((case when m < 0 then m + 1440 else m end) // 60)::varchar, 2, '0') || ':' || lpad(((case when m < 0 then m + 1440 else m end) % 60)::varchar, 2, '0') as text,
  round((case when m < 0 then m + 1440 else m end) / 60.0, 6)::double as hours from g""")
def delta_minutes(spark, d):
    p = V.trips(spark, d).select("event_id", F.col("clock").alias("a"), F.date_format(F.expr("ts + interval 437 minute"), "HH:mm").alias("b"), (F.col("event_id") % 3).alias("k"))
    return p.select("event_id", T.gap_minutes("a", "b").alias("gap"), T.gap_minutes("a", "b", F.col("k")).alias("gap_days"), T.signed_gap("a", "b", F.col("k")).alias("signed"), T.gap("a", "b", "h:m").alias("text"), F.round(T.gap("a", "b", "h"), 6).alias("hours"))


@query(f"""{V.sql("trips")} select event_id, round({_M.format("clock")} / 60.0, 9)::double as hours, {_M.format("clock")}::double as minutes, {_M.format("clock")} // 60 * 100 + {_M.format("clock")} % 60 as hhmm, clock as again,
regexp_replace(clock, '[-:]', '', 'g') similar to '[0-9]+' as valid from trips""")
def hhmm_convert(spark, d):
    t = V.trips(spark, d)
    return t.select("event_id", F.round(T.clock_number("clock"), 9).alias("hours"), T.clock_number("clock", "m").alias("minutes"), T.to_hhmm(T.to_minutes(T.hhmm("clock"))).alias("hhmm"), T.clock_text_carried(T.clock_number("clock")).alias("again"), T.is_clock("clock").alias("valid"))


@query("""with p as (select event_id, (event_id * 37) % 24 * 100 + (event_id * 11) % 60 as v, event_id % 25 - 12 as z from events)
select event_id, case when v - 100 * z < 0 then v - 100 * z + 2400 else v - 100 * z end as utc, case when v + 100 * z > 2400 then v + 100 * z - 2400 else v + 100 * z end as local,
printf('%02d:%02d', v // 100, v % 100) as clock from p""")
def tz_shift(spark, d):
    k = F.col("event_id")
    p = V.table(spark, d, "events").select("event_id", ((k * 37) % 24 * 100 + (k * 11) % 60).alias("v"), (k % 25 - 12).alias("z"))
    return p.select("event_id", T.to_utc("v", "z").alias("utc"), T.to_local("v", "z").alias("local"), T.hhmm_clock("v").alias("clock"))


@query("""with p as (select event_id, event_id * 97 - 5000 as m from events)
select event_id, printf('%02d:%02d', ((m % 1440 + 1440) % 1440) // 60, ((m % 1440 + 1440) % 1440) % 60) as clock, case when m % 1000 > 0 then m % 1000 else m % 1000 + 86400 end as ride, (m * 60 % 86400 + 86400) % 86400 as sec from p""")
def wrap_arrival(spark, d):
    p = V.table(spark, d, "events").select("event_id", (F.col("event_id") * 97 - 5000).alias("m"))
    return p.select("event_id", T.wrapped_clock("m").alias("clock"), T.ride(F.lit(0), F.col("m") % 1000).alias("ride"), T.of_day(F.col("m") * 60).alias("sec"))


# Timetables

_CLOCK = """ev as (select train, seq, station, 0 as k, arr as t from stops union all select train, seq, station, 1, dep from stops),
st as (select *, coalesce((t - lag(t) over o + 1440) % 1440, 0) as step from ev window o as (partition by train order by seq, k)),
ck as (select *, sum(step) over (partition by train order by seq, k) as clock from st),
ab as (select a.train, a.seq as sa, b.seq as sb, a.station as depart_station, b.station as arrive_station, a.t as depart, b.t as arrive, (b.clock - a.clock)::bigint as travel_time
 from ck a join ck b on a.train = b.train and a.seq < b.seq and a.k = 1 and b.k = 0 and a.station <> b.station)"""
_LAST = "select train, depart_station, arrive_station, depart, arrive, travel_time from {0} qualify row_number() over (partition by train, depart_station, arrive_station order by sa desc, sb desc) = 1"


@query(f"{V.sql('stops')}, {_CLOCK} {_LAST.format('ab')}")
def od_services_all(spark, d):
    return timetable.services(V.stops(spark, d))


@query(f"{V.sql('stops')}, {_CLOCK}, nx as (select * from ab qualify row_number() over (partition by train, sa order by sb) = 1) {_LAST.format('nx')}")
def od_services_direct(spark, d):
    return timetable.services(V.stops(spark, d), "direct")


@query(f"""{V.sql("stops")}, {_CLOCK}, nx as (select * from ab qualify row_number() over (partition by train, sa order by sb) = 1), s as ({_LAST.format("nx")})
select 't' || train || '_' || (row_number() over (partition by train order by depart_station, arrive_station) - 1) as id, depart_station, arrive_station, printf('%02d:%02d', depart // 60, depart % 60) as depart,
printf('%02d:%02d', arrive // 60, arrive % 60) as arrive, train::varchar as train_code, travel_time, 'train' as type from s""")
def service_table(spark, d):
    return timetable.service_rows(timetable.services(V.stops(spark, d), "direct"))


@query(f"{V.sql('stops')}, o as (select distinct train, station from stops) select distinct a.station as a, b.station as b, a.train as train from o a join o b on a.train = b.train and a.station < b.station")
def station_graph(spark, d):
    return timetable.station_graph(V.stops(spark, d))


@query(f"{V.sql('stops')} select distinct station, train from stops")
def trains_per_station(spark, d):
    return timetable.trains_of_stations(V.stops(spark, d))


@query("""with e as (select user_id as train, event_id as row, event_type as station from events), r as (select *, row - row_number() over (partition by train order by row) as run from e),
q as (select * from r qualify run = max(run) over (partition by train)) select train, row, station, row_number() over (partition by train order by row) - 1 as seq from q""")
def run_groups(spark, d):
    e = V.table(spark, d, "events").select(F.col("user_id").alias("train"), F.col("event_id").alias("row"), F.col("event_type").alias("station"))
    return timetable.last_runs(e)


@query(f"""{V.sql("legs")}, l as (select * from legs where arr is not null),
p as (select a.code, a.seq as i, b.seq as j, a.dep, a.dep_t, b.arr, b.arr_t, a.info as f, b.info as l from l a join l b on a.code = b.code and a.seq <= b.seq and not (b.seq > a.seq and a.dep = b.arr))
select code, dep, dep_t % 86400 as dep_t, arr, arr_t % 86400 as arr_t, case when arr_t - dep_t > 0 then arr_t - dep_t else arr_t - dep_t + 86400 end as during,
code || ':' || split_part(f, '->', 1) || '->' || split_part(l, '->', 2) as describe from p qualify row_number() over (partition by code, dep, arr order by i desc, j desc) = 1""")
def leg_expand(spark, d):
    return timetable.leg_services(_legs(spark, d))


def _legs(spark, d):
    from pyspark.sql import Window

    o = Window.partitionBy("train").orderBy("seq")
    legs = V.stops(spark, d).select(F.col("train").alias("code"), "seq", F.col("station").alias("dep"), (F.col("dep") * 60).alias("dep_t"), F.lead("station").over(o).alias("arr"), (F.lead("arr").over(o) * 60).alias("arr_t"))
    return legs.where("arr is not null").withColumn("info", F.concat_ws("->", F.col("dep").cast("string"), F.col("arr").cast("string")))


@query(f"""{V.sql("stops")}, w as (select train, seq, dep, arr, (arr + dep) % 60 as during, (dep - lag(arr) over (partition by train order by seq) + 1440) % 1440 as wait from stops)
select train as scheme, sum(during + coalesce(wait, 0))::bigint as minutes from w group by train""")
def scheme_minutes(spark, d):
    s = V.stops(spark, d).select(F.col("train").alias("scheme"), F.col("seq").alias("pos"), F.col("dep").alias("depart"), F.col("arr").alias("arrive"), ((F.col("arr") + F.col("dep")) % 60).alias("during"))
    return timetable.scheme_minutes(s)


# Linkage

_EVENTS = """e0 as (select train, seq, station, 'a.' as kind, arr as t0 from hhmm_stops where arr is not null union all select train, seq, station, 'd.', dep from hhmm_stops where dep is not null),
e1 as (select *, case when t0 < coalesce(lag(t0) over (partition by train order by seq, kind), 0) then 2400 else 0 end as back from e0),
e as (select train, seq, station, kind, (t0 + sum(back) over (partition by train order by seq, kind))::bigint as t from e1)"""


@query(f"{V.sql('hhmm_stops')}, {_EVENTS}, m as (select train, coalesce(t > max(t) over (partition by train order by seq, kind rows between unbounded preceding and 1 preceding), true) as ok from e) select train, bool_and(ok) as ok from m group by train")
def monotone_check(spark, d):
    return linkage.monotone(linkage.events(V.hhmm_stops(spark, d)))


@query(f"{V.sql('hhmm_stops')}, {_EVENTS} select train, arg_min(t, seq * 10 + (kind = 'd.')::int) as first, arg_max(t, seq * 10 + (kind = 'd.')::int) as last from e group by train")
def running_period(spark, d):
    return linkage.running_period(linkage.events(V.hhmm_stops(spark, d))).select("train", F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"))


_MIN = "({0} // 100 * 60 + {0} % 100)"


@query(f"""{V.sql("hhmm_stops")}, pl as (select s_suppkey as station, (s_suppkey % 360 - 180)::double as lon, (s_suppkey % 120 - 60)::double as lat from supplier),
r as (select train, seq, coalesce(arr, dep) as now, lag(coalesce(dep, arr)) over o as t, lon, lat, lag(lon) over o as lon0, lag(lat) over o as lat0 from hhmm_stops left join pl using (station) window o as (partition by train order by seq)),
q as (select train, seq, {_distance("lon0", "lat0", "lon", "lat")} as km, {_MIN.format("(case when now < t then now + 2400 else now end)")} - {_MIN.format("t")} as m from r)
select train, seq, round(km / (m / 60.0), 6)::double as speed from q where m > 0 and km > 0""")
def stop_speed(spark, d):
    k = F.col("s_suppkey")
    places = V.table(spark, d, "supplier").select(k.alias("station"), (k % 360 - 180).cast("double").alias("lon"), (k % 120 - 60).cast("double").alias("lat"))
    return linkage.speeds(V.hhmm_stops(spark, d), places).withColumn("speed", F.round("speed", 6))


_SIM = f"""x as (select a.train as a, b.train as b, a.station, abs({_MIN.format("a.arr")} - {_MIN.format("b.arr")}) as aa, abs({_MIN.format("a.dep")} - {_MIN.format("b.dep")}) as dd,
abs({_MIN.format("a.arr")} - {_MIN.format("b.dep")}) as ad, abs({_MIN.format("a.dep")} - {_MIN.format("b.arr")}) as da from records a join records b on a.station = b.station and a.train < b.train)"""


@query(f"""{V.sql("records")}, {_SIM}, y as (select a, b, coalesce(aa, dd) as same, case when ad <= 25 then ad when da <= 25 then da end as near from x),
z as (select a, b, count(*) as shared, coalesce(sum((same <= 5)::int), 0) + max(case when same is null and near is not null then 1 else 0 end) as agree, sum(coalesce(same, near)) as off, bool_or(coalesce(same > 5, near is null)) as veto from y group by a, b)
select a, b, (case when veto or shared < 1 then 100000.0 when agree < 1 then 10000.0 else off / agree end)::double as score from z""")
def train_similarity(spark, d):
    return linkage.similarity(V.records(spark, d), 1, 5, 25)


@query(f"""{V.sql("hhmm_stops")}, {_SIM.replace("records", "hhmm_stops")}, y as (select a, b, coalesce(aa, dd) as same, case when ad <= 9 then ad when da <= 9 then da end as near from x),
z as (select a, b, count(*) as shared, coalesce(sum((same <= 5)::int), 0) + max(case when same is null and near is not null then 1 else 0 end) as agree, sum(coalesce(same, near)) as off, bool_or(coalesce(same > 5, near is null)) as veto from y group by a, b)
select a, b, (off / agree)::double as score from z where not veto and shared >= 2 and agree >= 2""")
def similar_trains(spark, d):
    return linkage.similar(V.hhmm_stops(spark, d), 2, 5, 9)


@query(f"""{V.sql("hhmm_stops")}, {_SIM.replace("records", "hhmm_stops")}, o as (select distinct train, station from hhmm_stops), e as (select x.train as a, y.train as b from o x join o y on x.station = y.station and x.train < y.train group by 1, 2 having count(*) >= 3),
y as (select a, b, coalesce(aa, dd) as same, case when ad <= 25 then ad when da <= 25 then da end as near from x semi join e using (a, b)),
z as (select a, b, count(*) as shared, coalesce(sum((same <= 5)::int), 0) + max(case when same is null and near is not null then 1 else 0 end) as agree, sum(coalesce(same, near)) as off, bool_or(coalesce(same > 5, near is null)) as veto from y group by a, b)
select a, b, (case when veto or shared < 3 then 100000.0 when agree < 3 then 10000.0 else off / agree end)::double as score from z""")
def trains_in_common(spark, d):
    return linkage.close(V.hhmm_stops(spark, d), 3, 5, 25)


_LINKS = f"{_SIM}, l as (select a, b, sum((coalesce(aa, dd) <= 60)::int)::bigint as matches from x group by a, b having sum((coalesce(aa, dd) <= 60)::int) >= 2 and max(coalesce(aa, dd)) <= 60)"


_BUSY = _LINKS.replace("records", "hhmm_stops").replace("<= 60", "<= 9")


@query(f"{V.sql('hhmm_stops')}, {_BUSY} select * from l")
def train_links_busy(spark, d):
    return linkage.possible_links(V.hhmm_stops(spark, d), 2, 9)


@query(f"{V.sql('records')}, {_LINKS} select * from l")
def train_links(spark, d):
    return linkage.possible_links(V.records(spark, d), 2, 60)


_OWN = """e0 as (select train, seq, station, 'a.' as kind, arr as t0 from records where arr is not null union all select train, seq, station, 'd.', dep from records where dep is not null),
e1 as (select *, case when t0 < coalesce(lag(t0) over (partition by train order by seq, kind), 0) then 2400 else 0 end as back from e0),
e as (select train, seq, station, kind, (t0 + sum(back) over (partition by train order by seq, kind))::bigint as t from e1)"""
_DAY = "abs(t // 100 * 60 + t % 100 - (floor(({0}) / 100.0)::bigint * 60 + (({0}) % 100 + 100) % 100)) <= 60"


@query(f"""{V.sql("records")}, {_LINKS}, {_OWN}, sz as (select train, count(*) as n from e group by train),
ro as (select a, b, case when x.n > y.n then a else b end as base from l join sz x on x.train = a join sz y on y.train = b), rl as (select *, case when base = a then b else a end as other from ro),
ba as (select a, b, station, kind, t from rl join e on e.train = base), ot as (select a, b, station, kind, t as u from rl join e on e.train = other),
dy as (select a, b, case when {_DAY.format("u")} then 0 when {_DAY.format("u + 2400")} then 2400 when {_DAY.format("u - 2400")} then -2400 end as day from ba join ot using (a, b, station, kind) qualify row_number() over (partition by a, b order by station, kind, t, u) = 1),
mo as (select ot.a, ot.b, ot.station, ot.kind, u + coalesce(day, 0) as t from ot left join dy using (a, b) where not exists (select 1 from ba where ba.a = ot.a and ba.b = ot.b and ba.station = ot.station and ba.kind = ot.kind)),
al as (select * from ba union all select * from mo) select a, b, station, kind, t from al qualify row_number() over (partition by a, b, t order by station, kind) = 1""")
def merge_events(spark, d):
    rows = V.records(spark, d)
    pairs = lineage.turn(linkage.possible_links(rows, 2, 60).select("a", "b"))
    return linkage.merged(linkage.events(linkage.of_trains(rows, pairs)), pairs)


# Grids and polygons


def _cell(c: str, r: float) -> str:
    return f"round_even({c} / {r!r}::double + {0.5 * r!r}::double, 0)::bigint"


@query(f"{V.sql('points')} select pid, {_cell('x', 0.25)} as cx, {_cell('y', 0.25)} as cy from points")
def grid_snap(spark, d):
    return V.points(spark, d).select("pid", G.cell(F.col("x"), 0.25).alias("cx"), G.cell(F.col("y"), 0.25).alias("cy"))


@query(f"""{V.sql("points")}, c as (select distinct {_cell("x", 0.25)} as cx, {_cell("y", 0.25)} as cy from points), s as (select unnest([-1, 0, 1]) as i), n as (select a.i, b.i as j from s a, s b where a.i <> 0 or b.i <> 0)
select cx, cy, {_cell("(cx * 0.25::double + i * 0.25::double)", 0.25)} as nx, {_cell("(cy * 0.25::double + j * 0.25::double)", 0.25)} as ny from c, n""")
def grid_neighbors(spark, d):
    c = V.points(spark, d).select(G.cell(F.col("x"), 0.25).alias("cx"), G.cell(F.col("y"), 0.25).alias("cy")).distinct()
    near = c.select("cx", "cy", F.inline(G.around(F.col("cx") * 0.25, F.col("cy") * 0.25, 0.25)))
    return near.select("cx", "cy", F.rint(F.col("lon") / 0.25).cast("bigint").alias("nx"), F.rint(F.col("lat") / 0.25).cast("bigint").alias("ny"))


@query(f"""{V.sql("points")}, g as (select pid, x, y, {_cell("x", 0.5)} * 0.5::double as gx, {_cell("y", 0.5)} * 0.5::double as gy from points),
w as (select *, ceil(80 / {_distance("gx", "gy", "(gx + 0.5)", "gy")})::int + 1 as ni, ceil(80 / (radians(0.5) * {G.RADIUS_KM}))::int + 1 as nj from g),
i as (select *, unnest(range(-ni, ni + 1)) as i from w), j as (select *, unnest(range(-nj, nj + 1)) as j from i)
select pid, i::int as i, j::int as j from j where {_distance("x", "y", "(gx + i * 0.5)", "(gy + j * 0.5)")} <= 80""")
def grid_cover(spark, d):
    return spatial.cells_within(V.points(spark, d), 0.5, 80.0)


@query(f"{V.sql('points')} select {_cell('x', 5.0)} as cx, {_cell('y', 5.0)} as cy, round(sum(value), 4) as value from points group by 1, 2")
def downsample(spark, d):
    return spatial.downsample(V.points(spark, d), 5.0).withColumn("value", F.round("value", 4))


@query(f"{V.sql('points')} select pid, x < 50 as west from points where x between -50 and 50 and y between -30 and 30 and value > 0")
def bbox_filter(spark, d):
    p = V.points(spark, d).where(G.in_box(F.col("x"), F.col("y"), -50, 50, -30, 30) & (F.col("value") > 0))
    return p.select("pid", G.in_box_open_east(F.col("x"), F.col("y"), -50, 50, -30, 30).alias("west"))


@query(f"{V.sql('points')} select least(180, min(x)) as minx, greatest(-180, max(x)) as maxx, least(90, min(y)) as miny, greatest(-90, max(y)) as maxy from points")
def bbox_agg(spark, d):
    return spatial.bounds(V.points(spark, d))


@query("with p as (select l_orderkey, l_linenumber, l_partkey, l_partkey % 21600 as r, l_suppkey % 43200 as c from lineitem) select l_orderkey, l_linenumber, l_partkey, round(-180 + (c + 0.5) / 120, 9)::double as lon, round(90 - (r + 0.5) / 120, 9)::double as lat from p")
def rowcol_lonlat(spark, d):
    p = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") % 21600).alias("r"), (F.col("l_suppkey") % 43200).alias("c"))
    lon, lat = G.pixel_centre(F.col("r"), F.col("c"))
    return p.select("l_orderkey", "l_linenumber", "l_partkey", F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"))


@query(f"""{V.sql("points", "boxes")}, f as (select pid, value, min(poly) as poly from points join boxes on x >= x1 and x < x2 and y >= y1 and y < y2 where value > 0 group by pid, value)
select b.poly, round(coalesce(sum(value), 0), 4) as total, count(value) as n from boxes b left join f using (poly) group by b.poly""")
def pip_aggregate(spark, d):
    return spatial.polygon_sums(V.points(spark, d), V.polygons(spark, d)).withColumn("total", F.round("total", 4))


_E = G.ECC2**0.5
_QQ = f"({1 - G.ECC2} * (sin(radians({{0}})) / (1 - {G.ECC2} * pow(sin(radians({{0}})), 2)) - {1 / (2 * _E)} * ln((1 - {_E} * sin(radians({{0}}))) / (1 + {_E} * sin(radians({{0}}))))))"
_MM = f"(pow(cos(radians({{0}})), 2) / (1 - {G.ECC2} * pow(sin(radians({{0}})), 2)))"


@query(f"""{V.sql("boxes")}, k as (select *, ({_MM.format("y1")} - {_MM.format("y2")}) / nullif({_QQ.format("y2")} - {_QQ.format("y1")}, 0) as n from boxes where y1 <> -y2),
c as (select *, {_MM.format("y1")} + n * {_QQ.format("y1")} as c from k),
p as (select poly, i, x, y, n, {G.AXIS_M} * sqrt(c - n * {_QQ.format("y")}) / n as rho from (select *, unnest([0, 1, 2, 3, 4]) as i, unnest([x1, x2, x2, x1, x1]) as x, unnest([y1, y1, y2, y2, y1]) as y from c)),
f as (select poly, i, rho * sin(n * radians(x)) as u, -rho * cos(n * radians(x)) as v from p)
select a.poly, round(abs(sum(a.u * b.v - b.u * a.v)) / 2 / 1e6, 2) as km2 from f a join f b on a.poly = b.poly and b.i = a.i + 1 group by a.poly having sum(a.u * b.v - b.u * a.v) is not null""")
def area_albers(spark, d):
    return V.polygons(spark, d).select("poly", F.round(G.ring_area(F.col("ring"), "km2"), 2).alias("km2")).where("km2 is not null")


#: A ring's box holds its left and lower edges; holes and parts count by the even-odd rule.
_IN_SHAPES = """h as (select pid, value, poly from points p join shapes s on p.x >= x1 and p.x < x2 and p.y >= y1 and p.y < y2 group by pid, p.x, p.y, value, poly having count(*) % 2 = 1)"""


@query(f"""{V.sql("points", "shapes")}, {_IN_SHAPES}, s as (select distinct poly from shapes)
select poly, round(coalesce(sum(value), 0), 4)::double as total, count(value) as n from s left join (select * from h where value > 0) using (poly) group by poly""")
def pip_tiles(spark, d):
    return tiles.sums(V.points(spark, d), V.shapes(spark, d), 200).withColumn("total", F.round("total", 4))


@query(f"{V.sql('points', 'shapes')}, {_IN_SHAPES} select pid, min(poly) as poly from h group by pid")
def located_in_parts(spark, d):
    return tiles.locate(V.points(spark, d), V.shapes(spark, d)).select("pid", "poly")


@query(f"""{V.sql("shapes")}, b as (select *, y - r as lo, y + r as hi from shapes where r < 60), k as (select *, ({_MM.format("lo")} - {_MM.format("hi")}) / nullif({_QQ.format("hi")} - {_QQ.format("lo")}, 0) as n from b where lo <> -hi),
c as (select *, {_MM.format("lo")} + n * {_QQ.format("lo")} as c from k),
p as (select poly, ring, i, x, v, n, {G.AXIS_M} * sqrt(c - n * {_QQ.format("v")}) / n as rho from (select *, unnest([0, 1, 2, 3, 4]) as i, unnest([x1, x2, x2, x1, x1]) as x, unnest([y1, y1, y2, y2, y1]) as v from c)),
f as (select poly, ring, i, rho * sin(n * radians(x)) as u, -rho * cos(n * radians(x)) as w from p),
a as (select a.poly, a.ring, abs(sum(a.u * b.w - b.u * a.w)) / 2 / 1e6 as km2 from f a join f b on a.poly = b.poly and a.ring = b.ring and b.i = a.i + 1 group by 1, 2)
select poly, round(sum(case when ring = 1 then -km2 else km2 end), 1) as km2 from a group by poly""")
def area_parts(spark, d):
    shapes = V.shapes(spark, d).where(F.col("poly") % 5 != 0)
    return shapes.select("poly", F.round(G.polygon_area(F.col("parts"), "km2"), 1).alias("km2")).where("km2 is not null")


@query(f"""{V.sql("places")}, q as (select name, lon, lat, lon + 0.31 as lon2, lat + 0.17 as lat2 from places), w as (select *, {_distance("lon", "lat", "lon2", "lat2")} as km from q), u as (select *, ceil(km / 2)::int as n from w)
select name, i::int as pos, round(case when i = n then lon2 else lon + (lon2 - lon) * i / n end, 9) as x, round(case when i = n then lat2 else lat + (lat2 - lat) * i / n end, 9) as y from (select *, unnest(range(0, n + 1)) as i from u)""")
def interpolate_points(spark, d):
    p = V.places(spark, d).withColumns({"lon2": F.col("lon") + 0.31, "lat2": F.col("lat") + 0.17})
    line = p.select("name", F.posexplode(G.between_points(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"))).alias("pos", "p"))
    return line.select("name", "pos", F.round("p.lon", 9).alias("x"), F.round("p.lat", 9).alias("y"))


# Graphs and routes


@query(f"{V.sql('pairs2')}, c as (select * from pairs2 where w <= 20), n as (select a as node from c union select b from c) select a, b, w, (select count(*) from n) as nodes from c")
def cut_graph(spark, d):
    c = graph.cut(graph.undirected(V.edges(spark, d)), 20)
    return c.join(F.broadcast(graph.nodes(c).agg(F.count("*").alias("nodes"))))


#: Edges on a shortest path in the supplied tables are fewer; the query itself goes on until nothing changes.
_ROUNDS = 24
_STEP = "both2 as materialized (select a, b, w from pairs2 union all select b, a, w from pairs2), r0 as (select n_nationkey::bigint as origin, n_nationkey::bigint as node, 0.0::double as dist from nation)" + "".join(
    f", r{k} as materialized (select origin, node, min(dist) as dist from (select * from r{k - 1} union all select origin, b, dist + w from r{k - 1} join both2 on node = a) group by 1, 2)" for k in range(1, _ROUNDS + 1)
)


@query(f"{V.sql('pairs2')}, {_STEP} select origin, node, dist from r{_ROUNDS}")
def shortest_path(spark, d):
    starts = V.table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("origin"), F.col("n_nationkey").cast("bigint").alias("node"))
    return graph.distances(graph.undirected(V.edges(spark, d)), starts)


@query(f"{V.sql('pairs2')}, {_STEP}, q as (select distinct c_nationkey::bigint as origin, c_custkey % 300 as target from customer) select q.origin, target, coalesce(dist, -1) as dist from q left join r{_ROUNDS} on r{_ROUNDS}.origin = q.origin and node = target")
def travel_times(spark, d):
    pairs = V.table(spark, d, "customer").select(F.col("c_nationkey").cast("bigint").alias("origin"), (F.col("c_custkey") % 300).alias("target")).distinct()
    return graph.travel_time(graph.undirected(V.edges(spark, d)), pairs)


@query("with recursive e as (select distinct n_nationkey as src, n_nationkey + 1 + n_regionkey as dst from nation), r as (select 0 as node, 0 as depth union select dst, depth + 1 from r join e on src = node where depth < 30) select 0 as root, node, min(depth) as depth from r where node <> 0 group by node")
def descendants(spark, d):
    e = V.table(spark, d, "nation").select(F.col("n_nationkey").alias("src"), (F.col("n_nationkey") + 1 + F.col("n_regionkey")).alias("dst")).distinct()
    return graph.descendants(e, spark.createDataFrame([(0,)], "node int"))


_SERVICES = f"{_CLOCK}, nx as (select * from ab qualify row_number() over (partition by train, sa order by sb) = 1), sv as (select depart_station as dep, depart as dep_t, arrive_station as arr, arrive as arr_t, case when travel_time > 0 then travel_time else travel_time + 1440 end as during from ({_LAST.format('nx')}))"


def _layers(hops: int, low: int, high: int) -> str:
    seed = "l0 as (select n_nationkey::bigint as origin, n_nationkey::bigint + 1 as station, 0::bigint as total, 480::bigint as tod from nation)"
    layers = "".join(
        f", l{k} as (select origin, arr as station, min(total + (dep_t - tod + 1440) % 1440 + during) as total, (480 + min(total + (dep_t - tod + 1440) % 1440 + during)) % 1440 as tod from l{k - 1} join sv on station = dep where (dep_t - tod + 1440) % 1440 >= {low} and (dep_t - tod + 1440) % 1440 < {high} group by 1, 2)"
        for k in range(1, hops + 1)
    )
    return f"{seed}{layers}, al as (" + " union all ".join(f"select origin, station, {k} as legs, total from l{k}" for k in range(1, hops + 1)) + ")"


def _services(spark, d):
    s = timetable.services(V.stops(spark, d), "direct")
    return s.select(F.concat_ws("_", "train", "depart_station", "arrive_station").alias("id"), F.col("depart_station").alias("dep"), F.col("depart").alias("dep_t"), F.col("arrive_station").alias("arr"), F.col("arrive").alias("arr_t"), T.ride(F.lit(0), "travel_time", 1440).alias("during"))


def _seeds(spark, d):
    k = F.col("n_nationkey").cast("bigint")
    return V.table(spark, d, "nation").select(k.alias("origin"), (k + 1).alias("station"), F.lit(0).cast("bigint").alias("total"), F.lit(480).cast("bigint").alias("at"))


@query(f"{V.sql('stops')}, {_SERVICES}, {_layers(2, 15, 720)} select origin, station, min(total) as total from al group by 1, 2")
def route_layers(spark, d):
    return routing.route_layers(_services(spark, d), _seeds(spark, d), 2, 15, 720, pareto=False, paths=False).select("origin", "station", "total")


@query(f"{V.sql('stops')}, {_SERVICES}, {_layers(3, 15, 1440)} select origin, station, legs, total from al qualify coalesce(total < min(total) over (partition by origin, station order by legs rows between unbounded preceding and 1 preceding), true)")
def route_pareto(spark, d):
    return routing.route_layers(_services(spark, d), _seeds(spark, d), 3, 15, 1440, paths=False).select("origin", "station", "legs", "total")


_WALK = "select origin, arr as station, total + (dep_t - tod + 1440) % 1440 + during as total, arr_t as tod from {0} join sv on station = dep where (dep_t - tod + 1440) % 1440 between 15 and 179"


@query(f"""{V.sql("stops")}, {_SERVICES}, {_layers(0, 15, 180).partition(", al as")[0]}, w1 as ({_WALK.format("l0")}), w2 as ({_WALK.format("w1")}),
al as (select origin, station, 1 as legs, min(total) as total from w1 group by 1, 2 union all select origin, station, 2, min(total) from w2 group by 1, 2)
select origin, station, legs, total from al qualify coalesce(total < min(total) over (partition by origin, station order by legs rows between unbounded preceding and 1 preceding), true)""")
def route_bags(spark, d):
    return routing.route_bags(_services(spark, d), _seeds(spark, d), 2, 15, 180, paths=False).select("origin", "station", "legs", "total")


_RIDE = "select origin, arr as station, min(total + (dep_t - tod + 1440) % 1440 + during) as total, (480 + min(total + (dep_t - tod + 1440) % 1440 + during)) % 1440 as tod from {0} join sv on station = dep where (dep_t - tod + 1440) % 1440 between 15 and 1439 group by 1, 2"


@query(f"""{V.sql("stops")}, {_SERVICES}, {_layers(0, 15, 1440).partition(", al as")[0]}, m1 as ({_RIDE.format("l0")}), a1 as (select m1.* from m1 anti join l0 using (origin, station)),
m2 as ({_RIDE.format("a1")}), a2 as (select m2.* from m2 anti join l0 using (origin, station) left join a1 using (origin, station) where a1.total is null or m2.total < a1.total)
select origin, station, 0 as transfers, total from l0 union all select origin, station, 1, total from a1 union all select origin, station, 2, total from a2""")
def route_exact(spark, d):
    return routing.route_exact(_services(spark, d), _seeds(spark, d), 15, 1440, most=2, by_transfers=True, paths=False).select("origin", "station", "transfers", "total")


# Distributions

_HIST = """h as (select trunc(log10(min(o_totalprice)))::int as low, round_even(log10(max(o_totalprice)), 0) as high, count(*) as n from orders),
c as (select floor((log10(o_totalprice) - low) / ((high - low) / 49) + 1e-9)::int as bin, count(*) as c from orders, h group by 1 having bin between 0 and 49),
b as (select unnest(range(0, 50))::int as bin), f as (select bin, pow(10.0, low + bin * ((high - low) / 49)) as x, coalesce(c, 0) / n as freq from b left join c using (bin), h where bin between (select min(bin) from c) and (select max(bin) from c))"""


@query(f"with {_HIST} select bin, round(x, 6) as x, round(freq, 9) as freq from f")
def log_histogram(spark, d):
    h = stats.log_histogram(V.table(spark, d, "orders").select(F.col("o_totalprice").alias("value")))
    return h.select("bin", F.round("x", 6).alias("x"), F.round("freq", 9).alias("freq"))


@query(f"with {_HIST} select bin, round(x, 6) as x, round(sum(freq) over (order by bin rows between current row and unbounded following), 9) as share from f")
def reverse_cdf(spark, d):
    h = stats.reverse_cdf(stats.log_histogram(V.table(spark, d, "orders").select(F.col("o_totalprice").alias("value"))))
    return h.select("bin", F.round("x", 6).alias("x"), F.round("share", 9).alias("share"))


@query("""with r as (select c_acctbal as value, row_number() over (order by c_acctbal) - 1 as place from customer), t as (select count(*) as n, max(c_acctbal) as top from customer)
select k::int as k, value as split from (select unnest(range(1, 8)) as k), t join r on place = round_even(n / 8.0::double * k, 0)::bigint union all select 8, top from t""")
def quantile_bins(spark, d):
    return stats.split_points(V.table(spark, d, "customer").select(F.col("c_acctbal").alias("value")), 8)


@query("select c_name as name, c_acctbal as value from customer order by c_acctbal desc, c_name limit 11")
def topn_bar(spark, d):
    return stats.largest(V.table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("value")), 10)


@query("select round(regr_slope(l_extendedprice, l_quantity), 6) as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept, round(corr(l_extendedprice, l_quantity), 9) as corr, count(*) as n from lineitem")
def joint_fit(spark, d):
    p = stats.describe_pairs(V.table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y")))
    return p.select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("corr", 9).alias("corr"), "n")


@query("""with recursive p as (select p_size / 50.0::double as x, p_retailprice::double / 1000.0::double as y from part), s as (select x, count(*) as c, sum(y) as s from p group by x), t as (select sum(c) as n from s),
r as (select 0 as k, 1.0::double as w, 1.0::double as b union all select k + 1, any_value(w) - 0.01 * sum(2 * (b / pow(x, w) * c - s) * x) / any_value(n), any_value(b) - 0.01 * sum(2 * (b / pow(x, w) * c - s)) / any_value(n) from r, s, t where k < 100 group by k)
select round(w, 6) as w, round(b, 6) as b from r where k = 100""")
def fit_power(spark, d):
    p = V.table(spark, d, "part").select((F.col("p_size") / 50.0).alias("x"), (F.col("p_retailprice") / 1000.0).alias("y"))
    w, b = stats.fit_power(p)
    return spark.createDataFrame([(round(w, 6), round(b, 6))], "w double, b double")


# Names


@query(None)
def fuzzy_topk(spark, d):
    p = V.table(spark, d, "part")
    return match.fuzzy_matches(p.select("p_partkey", "p_name"), p.select(F.reverse("p_name").alias("other")).union(p.select("p_name")), "p_name", "other", 60)


@query(None)
def name_ratio(spark, d):
    p = V.table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    return p.select("p_partkey", F.round(N.name_ratio(F.col("p_name"), F.col("p_type")), 9).alias("ratio"))


@query(f"""{V.sql("points")}, p as (select distinct c_nationkey as key, x, y from points join customer on c_custkey = pid),
e as (select a.key, a.x, a.y, b.x - a.x as u, b.y - a.y as v from p a join p b on a.key = b.key and (a.x <> b.x or a.y <> b.y)),
bad as (select distinct e.key, e.x, e.y, u, v from e join p c on c.key = e.key and (u * (c.y - e.y) - v * (c.x - e.x) < 0 or u * (c.y - e.y) - v * (c.x - e.x) = 0 and (u * (c.x - e.x) + v * (c.y - e.y) < 0 or u * (c.x - e.x) + v * (c.y - e.y) > u * u + v * v))),
h as (select distinct key, x, y from (select * from e except select * from bad)), f as (select key, min(x) as x0, arg_min(y, x * 1000 + y) as y0 from h group by key),
o as (select key, x, y, (row_number() over (partition by key order by case when x = x0 and y = y0 then -10 else atan2(y - y0, x - x0) end) - 1)::int as pos from h join f using (key))
select key, pos, x, y from o union all select key, (select count(*) from h where h.key = f.key)::int, x0, y0 from f""")
def convex_hull(spark, d):
    p = V.points(spark, d).join(V.table(spark, d, "customer").select(F.col("c_custkey").alias("pid"), F.col("c_nationkey").alias("key")), "pid")
    return hull.convex_hulls(p)


# OSM

_TAGS = "select c_custkey as id, (['station', 'halt', 'abandoned', 'stop', 'rail', ''])[c_custkey % 6 + 1] as railway, (['', 'subway', 'light_rail'])[c_custkey % 3 + 1] as station, (['yes', 'no', '', 'no', 'no'])[c_custkey % 5 + 1] as tram, case when c_custkey % 11 = 0 then '12 km' else c_name end as name, (c_custkey % 360 - 180)::double as lon, (c_custkey % 120 - 60)::double as lat from customer"


@query(f"with t as ({_TAGS}) select id, tram <> 'yes' and station not in ('subway', 'light_rail') and railway in ('station', 'halt', 'stop') as stop, tram <> 'yes' and railway = 'rail' as rail from t")
def tag_filters(spark, d):
    return V.elements(spark, d).select("id", osm.is_station().alias("stop"), osm.is_railway().alias("rail"))


@query(f"""with t as ({_TAGS}), w as (select l_orderkey as wid, l_suppkey as id, name, lon, lat from (select distinct l_orderkey, l_suppkey from lineitem) join t on id = l_suppkey),
g as (select wid, median(lon) as lon, median(lat) as lat from w group by wid), wn as (select distinct wid, name from w where name <> '12 km')
select name, id, lon, lat, railway as type, 'node' as element from t where name <> '12 km' and id not in (select l_suppkey from lineitem)
union all select name, wid, lon, lat, '' as type, 'way' from wn join g using (wid)""")
def osm_places(spark, d):
    nodes = V.elements(spark, d)
    ways = V.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_set("l_suppkey")).alias("nds"))
    ways = ways.select(F.lit("way").alias("type"), "id", F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"), F.create_map(F.lit("a"), F.lit("b")).alias("tags"), "nds", F.lit(None).cast("array<struct<type: string, ref: bigint>>").alias("members"))
    return osm.places(nodes.unionByName(ways))


@query(f"""{V.sql("stops")}, g as (select train as id, count(*) as n, array_to_string(list(((station % 360) - 180)::varchar order by seq), ' ') as lons from stops join supplier on s_suppkey = station group by train) select * from g""")
def ways_geometry(spark, d):
    ways = V.stops(spark, d).groupBy(F.col("train").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "station"))), lambda x: x["station"]).alias("nds"))
    k = F.col("s_suppkey")
    nodes = V.table(spark, d, "supplier").select(k.alias("id"), (k % 360 - 180).alias("lon"), (k % 120 - 60).alias("lat"))
    return osm.way_lines(ways, nodes).select("id", F.size("line").cast("bigint").alias("n"), F.array_join(F.transform("line", lambda p: p["lon"].cast("string")), " ").alias("lons"))


@query("""with u as (select n_regionkey as folder, c_nationkey % 3 as level, c_mktsegment as kind, c_custkey as pos from customer join nation on n_nationkey = c_nationkey), c as (select folder, level, kind, count(*) as n, min(pos) as first from u group by 1, 2, 3)
select folder, level, kind from c qualify row_number() over (partition by folder, level order by n desc, first) = 1""")
def modal_level(spark, d):
    c, n = V.table(spark, d, "customer"), V.table(spark, d, "nation")
    u = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("n_regionkey").alias("folder"), (F.col("c_nationkey") % 3).alias("level"), F.col("c_mktsegment").alias("kind"), F.col("c_custkey").alias("pos"))
    return osm.modal_level(u)


# Sets, look-ups, texts


@query("select distinct s_nationkey as a, c_nationkey as b from (select s_nationkey, s_suppkey % 25 as k from supplier) join (select distinct c_nationkey from customer) on c_nationkey = k union select distinct c_nationkey, s_nationkey from (select s_nationkey, s_suppkey % 25 as k from supplier) join (select distinct c_nationkey from customer) on c_nationkey = k")
def union_distinct(spark, d):
    s = V.table(spark, d, "supplier").select(F.col("s_nationkey").alias("a"), (F.col("s_suppkey") % 25).alias("k"))
    c = V.table(spark, d, "customer").select(F.col("c_nationkey").alias("b")).distinct()
    p = s.join(c, F.col("b") == F.col("k")).select("a", "b")
    return p.union(p.select("b", "a")).distinct()


@query("select distinct p_partkey from part where p_partkey not in (select l_partkey from lineitem)")
def set_minus(spark, d):
    p, li = V.table(spark, d, "part").select("p_partkey"), V.table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return p.join(li, "p_partkey", "left_anti").distinct()


@query(f"{V.sql('edges')} select src as id, arg_max(dst, row * 100 + dst) as value from edges group by src")
def last_lookup(spark, d):
    e = V.edges(spark, d).withColumn("row", F.col("row") * 100 + F.col("dst"))
    return files.lookup(e.select(F.col("src").alias("id"), F.col("dst").alias("value"), "row"), "id", "value", "row")


@query("select page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href=\"([^\"#]*)\"', 1))), ' ') as links, array_length(regexp_extract_all(html, '<li>')) as items, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages")
def regex_extract(spark, d):
    p = V.table(spark, d, "pages")
    links = F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"#]*)"'), F.lit(1))))
    return p.select("page_id", F.array_join(links, " ").alias("links"), F.size(F.regexp_extract_all("html", F.lit("<li>"), F.lit(0))).cast("bigint").alias("items"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("""with t as (select p_partkey, case p_partkey % 5 when 0 then p_size || ' kph' when 1 then p_size || 'mph' when 2 then 'none' when 3 then (p_size || '.5 mph') else p_size::varchar end as s from part)
select p_partkey, case when regexp_replace(s, '[^0-9]', '', 'g') = '' then -1.0 when contains(s, 'mph') then round(regexp_replace(s, '[^0-9]', '', 'g')::double * 1.60934, 2) else regexp_replace(s, '[^0-9]', '', 'g')::double end as kmh from t""")
def maxspeed(spark, d):
    k, s = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    text = F.when(k == 0, F.concat(s, F.lit(" kph"))).when(k == 1, F.concat(s, F.lit("mph"))).when(k == 2, F.lit("none")).when(k == 3, F.concat(s, F.lit(".5 mph"))).otherwise(s)
    return V.table(spark, d, "part").select("p_partkey", G.max_speed(text).alias("kmh"))


@query("select event_id, (json_extract_string(props, '$.k'))::bigint as k, strftime(ts, '%H:%M') as clock from events")
def json_flatten(spark, d):
    e = V.table(spark, d, "events")
    return e.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), T.iso_clock(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("clock"))


@query("select p_partkey, upper(p_name[1]) || lower(p_name[2:]) as cap, replace(replace(replace(replace(replace(p_name || '&<>', '&', '&amp;'), '>', '&gt;'), '<', '&lt;'), '\"', '&quot;'), '''', '&apos;') as xml, regexp_replace(p_type || ' (a=b)', '[=(),/\\\\:*?\"<>| '']', '', 'g') as plain from part")
def text_cleanup(spark, d):
    p = V.table(spark, d, "part")
    return p.select("p_partkey", N.capitalised(F.col("p_name")).alias("cap"), N.xml_escaped(F.concat("p_name", F.lit("&<>"))).alias("xml"), N.without_marks(F.concat("p_type", F.lit(" (a=b)"))).alias("plain"))

"""Stand-ins for the domain's inputs, made of the supplied tables: as DataFrames, and as SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a partition; their number follows the table, so that a task that sorts trains does not grow with it.
PART = 250_000


def by_train(li: DataFrame) -> DataFrame:
    """lineitem with l_orderkey as train, partitioned by it once for all that follows within a train."""
    n = max(li.sparkSession.sparkContext.defaultParallelism, -(-li.count() // PART))  # the count is in the file's footers
    return li.withColumnRenamed("l_orderkey", "train").repartition(n, "train")


def places(spark, d) -> DataFrame:
    n, c = table(spark, d, "nation"), table(spark, d, "customer").groupBy("c_nationkey").count()
    k = F.col("n_nationkey")
    return n.join(c, n.n_nationkey == c.c_nationkey, "left").select(
        k.alias("name"), ((k * 37) % 360 - 179.5).cast("double").alias("lon"), ((k * 17) % 140 - 69.5).cast("double").alias("lat"), F.coalesce("count", F.lit(0)).cast("double").alias("value")
    )


def in_order(spark, d, *columns: str) -> DataFrame:
    """train, seq and `columns`, which are all that is moved. Trains are in the order of all of lineitem's columns, of which
    these are the first after the key: rows that are equal in them are told apart by nothing that is kept."""
    from pyspark.sql import Window

    li = by_train(table(spark, d, "lineitem").select("l_orderkey", *columns))
    return li.select("train", F.row_number().over(Window.partitionBy("train").orderBy(*columns)).alias("seq"), *columns)


def stops(spark, d) -> DataFrame:
    li = in_order(spark, d, "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    arr = (F.col("l_partkey") * 7) % 1440
    return li.select(
        "train", "seq", F.col("l_suppkey").alias("station"), arr.alias("arr"),
        ((arr + 1 + F.col("l_quantity").cast("int") % 10) % 1440).alias("dep"), F.col("l_partkey").alias("part"),
    )


def hhmm_stops(spark, d) -> DataFrame:
    """Stops with HHMM clocks; each fifth arrival is missing."""
    h = lambda c: (F.floor(F.col(c) / 60) * 100 + F.col(c) % 60).cast("int")
    return stops(spark, d).select("train", "seq", "station", F.when(F.col("seq") % 5 != 0, h("arr")).alias("arr"), h("dep").alias("dep"))


def records(spark, d) -> DataFrame:
    """Stops at parts: many stations, few trains at each."""
    m = (F.col("l_suppkey") * 13) % 1440
    h = (F.floor(m / 60) * 100 + m % 60).cast("int")
    return in_order(spark, d, "l_partkey", "l_suppkey").select("train", "seq", F.col("l_partkey").alias("station"), F.when(F.col("seq") % 3 != 0, h).alias("arr"), F.when(F.col("seq") % 4 != 0, h).alias("dep"))


def points(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("pid"), (F.lit(-180.0) + ((k * 7919) % 36000).cast("double") / 100).alias("x"), (F.lit(-70.0) + ((k * 104729) % 14000).cast("double") / 100).alias("y"), F.col("c_acctbal").alias("value")
    )


def polygons(spark, d) -> DataFrame:
    k = F.col("r_regionkey").cast("double")
    left, right, down, up = -170 + 70 * k, -110 + 70 * k, -60 + 10 * k, 60 - 5 * k
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return table(spark, d, "region").select(F.col("r_regionkey").alias("poly"), F.array(corner(left, down), corner(right, down), corner(right, up), corner(left, up), corner(left, down)).alias("ring"))


def shapes(spark, d) -> DataFrame:
    """Polygons of two parts, the first with a hole, from half a degree to 60 degrees wide."""
    k = F.col("n_nationkey")
    x, y = ((k * 37) % 300 - 150).cast("double"), ((k * 17) % 100 - 50).cast("double")
    r = F.element_at(F.array(*map(F.lit, (60.0, 20.25, 5.5, 1.25, 0.5))), (k % 5 + 1).cast("int"))
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    square = lambda a, b, h: F.array(point(a - h, b - h), point(a + h, b - h), point(a + h, b + h), point(a - h, b + h), point(a - h, b - h))
    return table(spark, d, "nation").select(k.alias("poly"), F.array(F.array(square(x, y, r), F.reverse(square(x, y, r / 2))), F.array(square(x + r * 1.5, y, r / 4))).alias("parts"))


def edges(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100).alias("dst"), F.col("l_quantity").alias("w"),
        ((F.col("l_orderkey") * 100 + F.col("l_linenumber")) * 1000 + F.col("l_quantity").cast("bigint")).alias("row"),
    )


def elements(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    tags = F.create_map(F.lit("railway"), pick(["station", "halt", "abandoned", "stop", "rail", ""], 6), F.lit("station"), pick(["", "subway", "light_rail"], 3), F.lit("tram"), pick(["yes", "no", "", "no", "no"], 5), F.lit("name"), F.when(k % 11 == 0, F.lit("12 km")).otherwise(F.col("c_name")))
    none = lambda t: F.lit(None).cast(t)
    return table(spark, d, "customer").select(
        F.lit("node").alias("type"), k.alias("id"), (k % 360 - 180.0).cast("double").alias("lon"), (k % 120 - 60.0).cast("double").alias("lat"), tags.alias("tags"),
        none("array<bigint>").alias("nds"), none("array<struct<type: string, ref: bigint>>").alias("members"),
    )


def trips(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", F.date_format("ts", "HH:mm").alias("clock"), F.to_date("ts").alias("day"), "ts", "event_type", "value", "props")


COLUMNS = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
SQL = {
    "places": "select n_nationkey as name, (((n_nationkey * 37) % 360)::double - 179.5) as lon, (((n_nationkey * 17) % 140)::double - 69.5) as lat, count(c_custkey)::double as value from nation left join customer on c_nationkey = n_nationkey group by n_nationkey",
    "stops": f"select l_orderkey as train, row_number() over (partition by l_orderkey order by {COLUMNS}) as seq, l_suppkey as station, (l_partkey * 7) % 1440 as arr, ((l_partkey * 7) % 1440 + 1 + l_quantity::int % 10) % 1440 as dep, l_partkey as part from lineitem",
    "hhmm_stops": "select train, seq, station, case when seq % 5 <> 0 then arr // 60 * 100 + arr % 60 end as arr, dep // 60 * 100 + dep % 60 as dep from stops",
    "records": "select train, seq, part as station, case when seq % 3 <> 0 then m // 60 * 100 + m % 60 end as arr, case when seq % 4 <> 0 then m // 60 * 100 + m % 60 end as dep from (select *, (station * 13) % 1440 as m from stops)",
    "points": "select c_custkey as pid, -180 + ((c_custkey * 7919) % 36000)::double / 100 as x, -70 + ((c_custkey * 104729) % 14000)::double / 100 as y, c_acctbal as value from customer",
    "boxes": "select r_regionkey as poly, -170 + 70 * r_regionkey::double as x1, -110 + 70 * r_regionkey::double as x2, -60 + 10 * r_regionkey::double as y1, 60 - 5 * r_regionkey::double as y2 from region",
    "shapes": "select poly, ring, x - h as x1, x + h as x2, y - h as y1, y + h as y2, r, y from (select poly, ring, r, y, case when ring = 2 then x + r * 1.5 else x end as x, case ring when 0 then r when 1 then r / 2 else r / 4 end as h from (select n_nationkey as poly, ((n_nationkey * 37) % 300 - 150)::double as x, ((n_nationkey * 17) % 100 - 50)::double as y, case n_nationkey % 5 when 0 then 60.0 when 1 then 20.25 when 2 then 5.5 when 3 then 1.25 else 0.5 end::double as r from nation), (select unnest([0, 1, 2]) as ring))",
    "edges": "select l_suppkey as src, l_partkey % 100 as dst, l_quantity as w, (l_orderkey * 100 + l_linenumber) * 1000 + l_quantity::bigint as row from lineitem",
    "pairs2": "select least(src, dst) as a, greatest(src, dst) as b, arg_max(w, row) as w from edges group by 1, 2",
    "trips": "select event_id, user_id, strftime(ts, '%H:%M') as clock, ts::date as day, ts, event_type, value, props from events",
    "legs": "select train as code, seq, station as dep, dep * 60 as dep_t, lead(station) over o as arr, lead(arr) over o * 60 as arr_t, station || '->' || lead(station) over o as info from stops window o as (partition by train order by seq)",
}
NEEDS = {"hhmm_stops": ["stops"], "records": ["stops"], "pairs2": ["edges"], "legs": ["stops"]}


def sql(*names: str) -> str:
    """'with ...' of the views and what they need; a query follows after a comma or at once."""
    order: list[str] = []
    for n in names:
        for m in [*NEEDS.get(n, []), n]:
            if m not in order:
                order.append(m)
    return "with " + ", ".join(f"{n} as ({SQL[n]})" for n in order)

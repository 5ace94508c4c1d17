"""Every query of the core against its SQL on the smallest tables, and what has no SQL against plain versions."""

import decimal
import math
import os

import duckdb
import pytest

from wayline.plans import catalogue, details, exchange, journeys  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in TABLES:
        if os.path.exists(f"{DATA}/{name}.parquet"):
            con.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return "nan" if math.isnan(value) else repr(float(value) + 0.0)
    return "" if value is None else repr(value) if not isinstance(value, int) or isinstance(value, bool) else repr(int(value))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the supplied tables are not here")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    found = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    got = sorted([plain(r[c]) for c in columns] for r in found.collect())
    sql = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(sql.columns) == columns
    order = [sql.columns.index(c) for c in columns]
    assert got == sorted([plain(r[i]) for i in order] for r in sql.fetchall())
    assert got or name in {"unknown_stations", "train_links", "merge_events", "open_references", "set_minus", "train_links_busy"}


def test_every_query_has_sql_or_is_known_to_lack_it():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == {"fuzzy_topk", "name_ratio"}


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, e in enumerate(b):
            new.append(row[j] + 1 if c == e else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the supplied tables are not here")
def test_name_ratio_equals_a_plain_version(spark):
    rows = {r.p_partkey: (r.p_name, r.p_type) for r in spark.read.parquet(f"{DATA}/part.parquet").collect()}
    got = {r.p_partkey: r.ratio for r in catalogue.QUERIES["name_ratio"](spark, DATA).collect()}
    assert got == {k: round(2 * subsequence(a, b) / (len(a) + len(b)), 9) for k, (a, b) in rows.items()}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the supplied tables are not here")
def test_fuzzy_topk_equals_a_plain_version(spark):
    from wayline.operators.match import weighted_score

    rows = [(r.p_partkey, r.p_name) for r in spark.read.parquet(f"{DATA}/part.parquet").collect()]
    names = sorted({n for _, n in rows} | {n[::-1] for _, n in rows})
    best = {t: [n for s, n in sorted((-weighted_score(t, n), n) for n in names)[:2] if -s >= 60] for t in {n for _, n in rows}}
    got = {r.p_partkey: r.matches for r in catalogue.QUERIES["fuzzy_topk"](spark, DATA).collect()}
    assert got == {k: ", ".join(best[t]) for k, t in rows}


def test_saved_lines_counts_stations_that_share_a_place(spark, tmp_path):
    """Stations 1 and 361 have one place."""
    stops = [(1, k, k % 3, n + 1) for n, k in enumerate((1, 2, 3, 361))] + [(2, k, k % 3, n + 1) for n, k in enumerate((1, 2, 3, 3))]
    named = ", ".join(f"0 as {c}" for c in ("l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"))
    li = spark.createDataFrame(stops, "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int").selectExpr("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "1D as l_quantity", *named.split(", "))
    li.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1, 400).selectExpr("id as s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    assert [tuple(r) for r in exchange.saved_lines(spark, str(tmp_path)).collect()] == [(1, 4)]

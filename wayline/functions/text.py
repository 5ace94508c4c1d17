"""Text expressions on columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def xml_escaped(x: Column) -> Column:
    for mark, name in (("&", "&amp;"), (">", "&gt;"), ("<", "&lt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(mark), F.lit(name))
    return x


def without_marks(x: Column) -> Column:
    return F.regexp_replace(x, "[=(),/\\\\:*?\"<>| ']", "")


def full_station_name(x: Column) -> Column:
    """A name that ends in Hbf has each Hbf spelt out."""
    return F.when(F.endswith(x, F.lit("Hbf")), F.replace(x, F.lit("Hbf"), F.lit("Hauptbahnhof"))).otherwise(x)


def joined_route(code: Column, first: Column, last: Column) -> Column:
    """'code:A->D' of the legs 'A->B' and 'C->D'."""
    return F.concat(code, F.lit(":"), F.split_part(first, F.lit("->"), F.lit(1)), F.lit("->"), F.split_part(last, F.lit("->"), F.lit(2)))


def route_code(describe: Column) -> Column:
    return F.split_part(describe, F.lit(":"), F.lit(1))


def station_pair(x: Column) -> Column:
    """'K1(A-B)' as the array K1, A, B."""
    return F.split(F.translate(x, "(-)", "  "), "\\s+")


def cjk_runs(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit("([\\x{4E00}-\\x{9FA5}]+)"), F.lit(1)))


def distance_sign(tags: Column) -> Column:
    """Has a map any key with 'name' in it whose value is a kilometre sign?"""
    return F.coalesce(F.exists(F.map_entries(tags), lambda e: F.contains(e["key"], F.lit("name")) & e["value"].rlike("[0-9].*(км|km|კმ|Km|KM)")), F.lit(False))


def capitalised(x: Column) -> Column:
    """First letter in upper case, the rest in lower case."""
    return F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substring(x, 2, 1 << 30)))


def level_of_file(path: Column) -> Column:
    """The character before the first '.' of a path's last part."""
    return F.regexp_extract(F.regexp_extract(path, "([^/]*)$", 1), "(.)\\.", 1)


def indel_ratio(a: str, b: str) -> float:
    """Similarity of two texts from the longest common subsequence: 2 * LCS / (len a + len b)."""
    if not a and not b:
        return 1.0
    full, places = (1 << len(a)) - 1, {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """indel_ratio of two columns; null if either is null. Edit distances that count a substitution once do
    not give it, so no built-in function does."""
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


#: A geocoder's answer.
PLACE = "lon string, lat string, display_name string, namedetails map<string, string>, address map<string, string>"


def geocoder_fields(answers: DataFrame, column: str) -> DataFrame:
    """answers with the fields of a geocoder's answer: name, lon, lat (null where missing or 0), country ('nan' without an
    address), address, synonyms: the different names in order, a ';' after each; the address where there are no names."""
    found = answers.withColumn("_p", F.from_json(column, PLACE))
    number = lambda c: F.col(f"_p.{c}").try_cast("double")
    names = F.coalesce(F.array_sort(F.array_distinct(F.map_values("_p.namedetails"))), F.array(F.col("_p.display_name")))
    empty = F.col("_p.address").isNull() | (F.size("_p.address") == 0)
    return found.withColumns({
        "name": F.col("_p.namedetails")["name"], "lon": number("lon"), "lat": number("lat"), "address": F.col("_p.display_name"),
        "country": F.when(empty, "nan").otherwise(F.col("_p.address")["country"]), "synonyms": F.aggregate(names, F.lit(""), lambda s, x: F.concat(s, x, F.lit(";"))),
    }).drop("_p")


def key_text(*columns: Column) -> Column:
    """Several values as one text, to tell rows apart by."""
    return F.to_json(F.struct(*columns))


def without_end(x: Column, n: int) -> Column:
    """A text without its last n characters."""
    return F.substring(x, F.lit(1), F.greatest(F.char_length(x) - n, F.lit(0)))

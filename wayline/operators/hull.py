"""Convex hulls."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hull_of(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Closed hull from the leftmost point (lowest of several), counter-clockwise, without points inside edges."""
    points = sorted({*points})
    if len(points) < 3:
        return [*points, *points[:1]]

    def half(line):
        out: list[tuple[float, float]] = []
        for p in line:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = half(points) + half(points[::-1])
    return [*ring, ring[0]]


def convex_hulls(points: DataFrame, key: str = "key") -> DataFrame:
    """points: key, x, y. Closed hull of each key as rows key, pos, x, y. Partitions are reduced to their own hulls
    first, so that a key's last task gets few points."""
    kind = points.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, pos int, x double, y double"

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        k = pdf[key].iloc[0]
        return pd.DataFrame([(k, i, x, y) for i, (x, y) in enumerate(hull_of(list(zip(pdf["x"], pdf["y"]))))], columns=[key, "pos", "x", "y"])

    def local(batches):
        for pdf in batches:
            for _, own in pdf.groupby(key, dropna=False):
                yield rows(own)

    part = points.select(key, "x", "y").where("x is not null and y is not null").mapInPandas(local, schema)
    return part.groupBy(key).applyInPandas(rows, schema)


def labelled(hulls: DataFrame, names: DataFrame, key: str = "key") -> DataFrame:
    """Hull points without the closing one, with the first name (key, x, y, name, row) of an equal point."""
    first = names.groupBy(key, "x", "y").agg(F.min_by("name", "row").alias("name"))
    last = hulls.groupBy(key).agg(F.max("pos").alias("_last"))
    return hulls.join(last, key).where("pos < _last or _last = 0").join(first, [key, "x", "y"], "left").drop("_last")

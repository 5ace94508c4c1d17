"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_root

#: A key with this share of the rows or more is joined by broadcast.
HOT = 1024


def join_spread(rows: DataFrame, sums: DataFrame, key: str, total: int, wide: bool = False) -> DataFrame:
    """rows joined with sums, which has one row for each key and in `n` how many rows the key has, of `total` or up to
    twice as many together. No key's rows meet in one task: keys with a HOT-th of total or more, of which there are 2 * HOT at most,
    are broadcast, and the others' rows are shuffled without those; with `wide` also where the planner would find sums small
    enough to broadcast it whole, so that wide rows are treated alike at every size."""
    is_hot = F.col("n") * HOT >= total
    hot = F.broadcast(sums.where(is_hot))
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    rest = sums.where(~is_hot)
    return rows.join(hot, key).unionByName(cold.join(rest.hint("merge") if wide else rest, key))


def _large_star(links: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of a node is linked with the node's smallest neighbour instead."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    return join_spread(both.where("b > a"), least, "a", total).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame, total: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked with the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = join_spread(down, least, "a", total).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links: a, b (bigint, no nulls). Returns node, component: the smallest node that each linked node
    reaches. A node without links, or linked with itself only, has no row. Each step ends in a reliable
    checkpoint in the shared folder, so that a lost executor costs one step at most; the rounds grow as
    the logarithm of a component's size. No neighbour list is ever gathered: minima are aggregated, and the
    links of a star's centre are never sent to one task."""
    shared_root(links.sparkSession)  # there must be a checkpoint folder
    links = links.select("a", "b").where("a <> b").checkpoint()
    total, before = links.count(), None
    for _ in range(most_rounds):
        links = _small_star(_large_star(links, total).checkpoint(), total).checkpoint()
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b"), F.col("b")).distinct())
        total, before = now[0], now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")

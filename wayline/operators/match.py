"""Approximate matching of names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import full_station_name, indel_ratio, name_ratio
from . import lineage


def _tokens(x: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in x.lower()).split()


def weighted_score(a: str, b: str) -> int:
    """0 to 100: the best of the plain ratio, and ratios of sorted tokens and of shared tokens against the rest at 0.95;
    0 for an empty text."""
    x, y = _tokens(a), _tokens(b)
    if not x or not y:
        return 0
    plain = indel_ratio(" ".join(x), " ".join(y))
    in_order = indel_ratio(" ".join(sorted(x)), " ".join(sorted(y)))
    both = sorted({*x} & {*y})
    core = " ".join(both)
    p, q = (" ".join([*both, *sorted({*t} - {*both})]) for t in (x, y))
    shared = max(indel_ratio(core, p), indel_ratio(core, q), indel_ratio(p, q)) if both else indel_ratio(p, q)
    return round(100 * max(plain, 0.95 * in_order, 0.95 * shared))


def lengths(text: str) -> set[int]:
    """The lengths that a text is compared by: of all its tokens and of its different tokens, with spaces."""
    own = _tokens(text)
    return {len(" ".join(own)), len(" ".join({*own}))} if own else set()


def core_share(threshold: int) -> float:
    """The least share that shared tokens have in one of two texts, if it is the shared tokens that bring the threshold."""
    t = (threshold - 0.5) / 100
    return t / (1.9 - t)


class _Names:
    """Names to be compared with, the letters of all their tokens and of their different tokens, and who has a token."""

    def __init__(self, names: list[str]):
        self.names = names
        tokens = [_tokens(n) for n in names]
        self.at: dict[str, list[int]] = {}
        for k, t in enumerate(tokens):
            for w in {*t}:
                self.at.setdefault(w, []).append(k)
        self.letters = {c: k for k, c in enumerate(sorted({c for t in tokens for w in t for c in w} | {" "}))}
        self.counts = [np.array([self.count(f(t)) for t in tokens], dtype=np.int32).reshape(len(names), len(self.letters)) for f in (" ".join, lambda t: " ".join({*t}))]

    def count(self, text: str) -> list[int]:
        out = [0] * len(self.letters)
        for c in text:
            if c in self.letters:
                out[self.letters[c]] += 1
        return out

    def may_reach(self, text: str, least: int, by_tokens: bool = True) -> list[int]:
        """Names whose letters allow a score of `least` or more: a common subsequence has at most the letters that both have.
        Shared tokens may count more than that; by_tokens adds the names that share one."""
        own = _tokens(text)
        may = np.zeros(len(self.names), dtype=bool)
        for line, counts in zip((" ".join(own), " ".join({*own})), self.counts):
            common = np.minimum(counts, np.array(self.count(line), dtype=np.int32)).sum(axis=1)
            may |= np.round(200 * common / np.maximum(counts.sum(axis=1) + len(line), 1) + 0.5) >= least
        for w in own if by_tokens else ():
            may[self.at.get(w, [])] = True
        return np.flatnonzero(may).tolist()


def _entries(texts: DataFrame) -> DataFrame:
    """text, tokens (different ones), size (letters of their line and a space) and lengths; texts without a token are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tokens = [_tokens(t) for t in pdf["text"]]
            yield pd.DataFrame({"text": pdf["text"], "tokens": [sorted({*t}) for t in tokens], "size": [sum(len(w) + 1 for w in {*t}) for t in tokens], "lengths": [sorted(lengths(t)) for t in pdf["text"]]})

    found = texts.mapInPandas(run, "text string, tokens array<string>, size int, lengths array<int>")
    return lineage.cut(found.where(F.size("tokens") > 0))


def _by_tokens(left: DataFrame, right: DataFrame, threshold: int, block: int) -> DataFrame:
    """text, name: pairs whose shared tokens can bring the threshold. The shared tokens then are at least a share of one of
    the two. Its tokens being ordered from the rarest to the commonest, one of them is shared that comes before the rest
    is less than that share: such heads are looked up among all tokens of the other side. Tokens of many texts come last, so
    they are seldom in a head; those that are have their texts dealt over blocks."""
    each = left.select("text", "size", F.explode("tokens").alias("token"), F.lit(0).alias("side")).union(right.select("text", "size", F.explode("tokens"), F.lit(1)))
    many = each.groupBy("token").agg(F.count("*").alias("_m"))
    order = Window.partitionBy("side", "text").orderBy("_m", "token")
    placed = each.join(many, "token").withColumn("_before", F.sum(F.length("token") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rest = F.col("size") - F.coalesce("_before", F.lit(0))
    # The share counts letters and spaces between them: one less than each sum of tokens and a space.
    placed = lineage.cut(placed.withColumn("head", rest - 1 >= core_share(threshold) * (F.col("size") - 1) - 1e-9))
    blocks = placed.groupBy("token").agg(F.ceil(F.count("*") / block).cast("int").alias("_g")).where("_g > 1")
    dealt = placed.join(blocks, "token", "left").withColumn("_g", F.coalesce("_g", F.lit(1))).withColumn("_o", F.pmod(F.xxhash64("text"), F.col("_g")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_g") - 1))
    ours = dealt.where("side = 0").select("token", "text", F.col("head").alias("h1"), F.col("_o").alias("_p"), every.alias("_q"))
    theirs = dealt.where("side = 1").select("token", F.col("text").alias("name"), F.col("head").alias("h2"), F.col("_o").alias("_q"), every.alias("_p"))
    return ours.join(theirs, ["token", "_p", "_q"]).where("h1 or h2").select("text", "name").distinct()


#: Texts that meet in one task at once, on either side, and letters of lengths that are taken together.
BLOCK, STEP = 1_000, 4


def _blocks(entries: DataFrame, name: str, block: int) -> DataFrame:
    """Entries by length in arrays of about `block` texts at most: step and the array."""
    each = entries.select("text", F.explode(F.array_distinct(F.transform("lengths", lambda n: F.floor(n / STEP).cast("int")))).alias("step"))
    size = each.groupBy("step").agg(F.ceil(F.count("*") / block).cast("int").alias("_g"))
    dealt = each.join(size, "step").withColumn("_b", F.pmod(F.xxhash64("text"), F.col("_g")).cast("int"))
    return dealt.groupBy("step", "_b").agg(F.sort_array(F.collect_list("text")).alias(name)).drop("_b")


def fuzzy_matches(left: DataFrame, right: DataFrame, key1: str, key2: str, threshold: int = 90, limit: int = 2, block: int = BLOCK) -> DataFrame:
    """left with `matches`: the best `limit` texts of right[key2] by score, those that reach the threshold, joined by
    ', ', best first, ties by text.

    Both sides may have any size and neither goes through the driver. Texts that differ by letters meet in blocks of about `block` texts
    of such lengths that the threshold is possible, and are scored where their letters allow it; texts that share tokens meet by
    those. Every pair that can reach the threshold is in one of the two. The first grows with both sides' texts of like
    lengths: a low threshold leaves little to rule out by length."""
    names = _entries(right.select(F.col(key2).cast("string").alias("text")).where("text is not null").distinct())
    texts = _entries(left.select(F.col(key1).cast("string").alias("text")).where("text is not null").distinct())

    def of_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for own, other in zip(pdf["texts"], pdf["names"]):
                held, rows = _Names(list(other)), []
                for t in own:
                    best = sorted((-weighted_score(t, held.names[k]), held.names[k]) for k in held.may_reach(t, threshold, by_tokens=False))[:limit]
                    rows += [(t, n, -s) for s, n in best]
                yield pd.DataFrame(rows, columns=["text", "name", "score"])

    def of_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"text": pdf["text"], "name": pdf["name"], "score": [weighted_score(a, b) for a, b in zip(pdf["text"], pdf["name"])]})

    # Twice the shorter length reaches the share of both that the threshold asks for.
    t = (threshold - 0.5) / 100
    low, high = F.floor((F.col("step") * STEP) * t / (2 - t) / STEP), F.ceil((F.col("step") * STEP + STEP) * (2 - t) / t / STEP)
    ours = _blocks(texts, "texts", block).withColumn("_s", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    theirs = _blocks(names, "names", block).withColumnRenamed("step", "_s")
    # A row is two arrays of texts, and work for its product: few in a batch, and dealt evenly.
    met = ours.join(theirs, "_s").select("texts", "names").repartition(_tasks(left))
    pairs = _by_tokens(texts, names, threshold, block)
    found = met.mapInPandas(of_blocks, "text string, name string, score int").union(pairs.mapInPandas(of_pairs, "text string, name string, score int")).where(F.col("score") >= threshold)
    # A pair may have come both ways.
    order = Window.partitionBy("text").orderBy(F.desc("score"), "name")
    best = found.distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit)
    joined = best.groupBy("text").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]), ", ").alias("matches"))
    return left.join(joined, left[key1].cast("string") == joined["text"], "left").select(left["*"], F.coalesce("matches", F.lit("")).alias("matches"))


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def accepted_candidates(candidates: DataFrame, tolerance: float = 0.8) -> DataFrame:
    """candidates: name, place, rank, names (array). For each name the first candidate that has the name, or one whose
    ratio to the raw or the spelt-out name reaches the tolerance; confidence -1 for the exact name."""
    one = candidates.withColumn("other", F.explode("names"))
    ratio = F.greatest(name_ratio(F.col("name"), F.col("other")), name_ratio(full_station_name(F.col("name")), F.col("other")))
    rows = one.withColumn("ratio", ratio).groupBy("name", "place", "rank").agg(F.bool_or(F.col("name") == F.col("other")).alias("exact"), F.max("ratio").alias("ratio"))
    good = rows.where(F.col("exact") | (F.col("ratio") >= tolerance))
    first = good.groupBy("name").agg(F.min(F.struct("rank", "place", "exact", "ratio")).alias("c"))
    return first.select("name", "c.place", F.when(F.col("c.exact"), -1.0).otherwise(F.col("c.ratio")).alias("confidence"))

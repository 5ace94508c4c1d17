"""How five document filters interact: what each removes after each subset of the others, and in each order.

A document's failure flags are counted with its part. One CUBE over the flags and the part gives, in the grouping sets
that hold the part, the rows whose selected flags are all false: the survivors of that subset of filters. A step of an
order is the pair of the subset before it and the subset with its own filter.

Filters: A under 200 words; B fewer distinct words than half; C more than 3 % capital letters A-Z; D any of #$%&*|;
E a text that a smaller doc_id has too, in any part and whether that row is removed or not.

A, B, C and D depend on the text alone. E needs the least doc_id of each text: rows meet by doc_id first, and of one text
only a row for each part meets, so a text that a third of all rows hold is no hot key. Labels meet the rows by doc_id;
rows without one are dealt out by a number.

Defined results: a null text is the empty text, which fails A alone (and E if a smaller doc_id has it). A row without a
doc_id has no smaller one, is nobody's smaller one and has no labels. Rows that repeat a doc_id are rows of their own; with one
text none of them fails E on account of the others. A document is good, or toxic, if any of its labels says 1. A null lang and
an empty one are the part ''. Without documents there are no rows. Other columns of both tables are not read. A text's words
are held at once in the task that reads it.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged

FILTERS = "ABCDE"
WORDS, SHARE_DISTINCT, SHARE_CAPITALS = 200, 50, 3
GAP = "[\\x20\\x09-\\x0D]+"
ALL = (1 << len(FILTERS)) - 1


def failures(text: Column) -> dict[str, Column]:
    """The conditions that need the text alone."""
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": n < WORDS, "B": 100 * distinct < SHARE_DISTINCT * n, "C": 100 * capitals > SHARE_CAPITALS * F.length(text), "D": text.rlike("[#$%&*|]")}


def _by_row(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of one doc_id, text and part: key, part, flags A to D, doc_id, and their number n, good, toxic."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    fails = failures(text)
    read = docs.select(
        "doc_id", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(-1).alias("_deal"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"), *[fails[c].alias(c) for c in "ABCD"],
    )
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    both = read.join(said.withColumn("_free", F.lit(-1).cast("bigint")), (F.col("doc_id") == F.col("_id")) & (F.col("_deal") == F.col("_free")), "left")
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c)
    return both.groupBy("doc_id", "_deal", "key", "part", *"ABCD").agg(F.count("*").alias("n"), total("good"), total("toxic"))


def flag_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E, and the number of documents n, good, toxic with these flags: 32 rows for each part at most."""
    counts = ["n", "good", "toxic"]
    none = F.col("doc_id").isNull()
    least = F.min(F.when(~none, F.struct("doc_id", *counts))).alias("least")
    of_text = _by_row(docs, labels).groupBy("key", "part", *"ABCD").agg(*[F.sum(c).alias(c) for c in counts], *[F.sum(F.when(none, F.col(c)).otherwise(0)).alias(f"{c}_none") for c in counts], least)
    # One row for each part of a text: as many as there are parts at most.
    first = of_text.withColumn("first", F.min("least.doc_id").over(Window.partitionBy("key")))
    stays = lambda c: F.col(f"{c}_none") + F.when(F.col("least.doc_id") == F.col("first"), F.col(f"least.{c}")).otherwise(0)
    told = [F.struct(F.lit(False).alias("E"), *[stays(c).alias(c) for c in counts]), F.struct(F.lit(True).alias("E"), *[(F.col(c) - stays(c)).alias(c) for c in counts])]
    rows = first.select("part", *"ABCD", F.inline(F.array(*told))).where("n > 0")
    return rows.groupBy("part", *FILTERS).agg(*[F.sum(c).alias(c) for c in counts])


def survivors(flags: DataFrame) -> DataFrame:
    """part, subset (bit i: filter i of FILTERS) and the documents n, good, toxic that pass all filters of the subset. Subsets
    that nothing survives have no row."""
    sets = flags.cube(*FILTERS, "part").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"), F.grouping("part").alias("_all"), *[F.grouping(c).alias(f"_{c}") for c in FILTERS])
    # A flag that is not selected is null in its grouping sets.
    pure = sets.where((F.col("_all") == 0) & ~F.greatest(*[F.coalesce(c, F.lit(False)) for c in FILTERS]))
    subset = sum(((1 - F.col(f"_{c}")) * (1 << i) for i, c in enumerate(FILTERS)), F.lit(0))
    return pure.select("part", subset.cast("int").alias("subset"), "n", "good", "toxic")


def steps() -> list[tuple[str, int, int, int, int]]:
    """(order, step, number of its filter, subset before, subset after) of all orders."""
    found = []
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for k, f in enumerate(order):
            found.append(("".join(FILTERS[i] for i in order), k + 1, f, before, before | 1 << f))
            before |= 1 << f
    return found


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley; and filter."""
    # Few rows, written and read again so that the documents are read once.
    flags = staged(flag_counts(docs, labels), "flags")
    parts = flags.select("part").distinct()
    every = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("filter_order", "step", "number", "before", "after"), s)]) for s in steps()])
    wide = parts.select("part", F.inline(every))
    live = survivors(flags)
    at = lambda name, how: live.select("part", F.col("subset").alias(name), *[F.col(c).alias(f"{how}_{c}") for c in ("n", "good", "toxic")])
    # For each filter the subsets: none, it alone, all but it, all.
    alone = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("number", "none", "one", "rest", "all"), (i, 0, 1 << i, ALL ^ 1 << i, ALL))]) for i in range(len(FILTERS))])
    single = parts.select("part", F.inline(alone))
    for name in ("none", "one", "rest", "all"):
        single = single.join(at(name, name).select("part", name, f"{name}_n"), ["part", name], "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    single = single.select("part", "number", (n("none_n") - n("one_n")).alias("fails"), (n("rest_n") - n("all_n")).alias("unique_fails"))
    pairs = wide.join(at("before", "b"), ["part", "before"], "left").join(at("after", "a"), ["part", "after"], "left").join(single, ["part", "number"])
    lost = lambda c: n(f"b_{c}") - n(f"a_{c}")
    rows = pairs.select("part", "filter_order", "step", "number", n("a_n").alias("kept"), lost("n").alias("removed"), (F.col("fails") - lost("n")).alias("redundant"), "unique_fails", lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"))
    rows = rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "number")))
    counts = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    name = F.element_at(F.array(*map(F.lit, FILTERS)), F.col("number") + 1)
    return rows.select("part", "filter_order", F.col("step").cast("int").alias("step"), *[F.col(c).cast("bigint").alias(c) for c in counts], name.alias("filter"))


_FLAGS = """
    d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
    e as (select text, min(doc_id) as first from d group by text),
    f as (select part, len(words) < 200 as A, 100 * len(list_distinct(words)) < 50 * len(words) as B, 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 3 * length(d.text) as C,
            regexp_matches(d.text, '[#$%&*|]') as D, coalesce(doc_id > first, false) as E,
            exists (from labels l where l.doc_id = d.doc_id and quality = 1) as good, exists (from labels l where l.doc_id = d.doc_id and toxic = 1) as toxic
          from d join e on d.text = e.text)"""

#: Every document walks through every order.
ORACLE = f"""with recursive{_FLAGS},
    o as (select '' as filter_order union all select filter_order || c from o, (values ('A'), ('B'), ('C'), ('D'), ('E')) v(c) where not contains(filter_order, c)),
    x as (select part, A, B, C, D, E, good, toxic, count(*) as n from f group by all),
    w as (select x.*, filter_order, step, substr(filter_order, step, 1) as filter, (case when A then 'A' else '' end || case when B then 'B' else '' end || case when C then 'C' else '' end || case when D then 'D' else '' end || case when E then 'E' else '' end) as fails
          from x, o, (select unnest([1, 2, 3, 4, 5]) as step) where length(filter_order) = 5),
    t as (select *, contains(fails, filter) as here, length(translate(substr(filter_order, 1, step - 1), fails, '')) < step - 1 as gone from w),
    r as (select part, filter_order, step, filter, sum(case when not here and not gone then n else 0 end)::bigint as kept, sum(case when here and not gone then n else 0 end)::bigint as removed,
            sum(case when here and gone then n else 0 end)::bigint as redundant, sum(case when fails = filter then n else 0 end)::bigint as unique_fails,
            sum(case when here and not gone and good then n else 0 end)::bigint as good_lost, sum(case when here and not gone and toxic then n else 0 end)::bigint as toxic_lost from t group by all)
    select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, filter))::bigint as shapley, filter from r"""

"""How much the sources of a language differ in their words.

Terms are runs of letters A-Z and of all characters beyond ASCII, with A-Z lower-cased. Each language keeps its V terms of
at least LEAST documents. A source's share of a term is p = 1 + floor(SCALE * (count + 5) / (N + 5 V)), N the source's
count of kept terms. The divergence of two sources of a language is the sum of |p - q| over the kept terms; a source's terms
are those whose share is above the language's own.

Columns of counts are deduplicated: the terms of a language that have one sparse vector of counts (source, count) are one
vector with a multiplicity, and every pair of sources is evaluated once for each distinct vector, in numpy, on the vectors'
batches. The terms' own ranks use the terms as they are.

Tasks count the terms of their documents by language and source and send what they hold at LIMIT counts, so that a word
of all documents arrives once for each task and source. Rows meet by language and term; the rest works on kept terms. All
arithmetic is exact: shares come from a long division in base 1,000, as SCALE * count may not fit 64 bits.

Defined results: a null text, lang or source is ''. A group (language, source) without kept terms counts nothing: its
shares are those of count 0. A language without kept terms has pairs of value 0 and no terms. A language with one source has no
pairs. Repeated rows are documents of their own, and doc_id is not read. Ties of a value go to the item that is less in UTF-8.
A long text is counted in pieces of PIECE bytes; its distinct terms are held at once. A task holds a number for each pair
of sources of the languages that it meets: 8 MB for 1,000 sources of a language, as it is the size of the result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches, staged

LEAST, ADDED, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Counts that a task holds before it sends them, bytes of a text that are split at once, and cells of a dense block.
LIMIT, PIECE, CELLS = 400_000, 1 << 20, 1 << 18
#: A-Z to a-z, every other ASCII character but a-z to a space; bytes of other characters stay.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def pieces(text: bytes):
    """The words of a text, in lists of about PIECE bytes, cut at spaces."""
    text, at = text.translate(LETTERS), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE) if at + PIECE < len(text) else len(text)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _counted(batches):
    """Batches of lang, source, text to lang, source, term, n, docs."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out():
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )
        held.clear()

    for batch in batches:
        langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        for lang, source, text in zip(langs, sources, texts):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            own: set[bytes] = set()
            for words in pieces(text.as_py()):
                n.update(words)
                own.update(words)
            docs.update(own)
        if sum(len(n) for n, _ in held.values()) > LIMIT:
            yield from out()
    yield from out()


def _named(docs: DataFrame, *columns: str) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]


def kept_terms(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, term and counts, an array of (source, n) by source, of the terms in `least` documents of the language."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    each = docs.select(*_named(docs, "lang", "source"), text).mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    # By language and term once: sums for each source and the gathering of a term's sources need no other exchange.
    each = each.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = each.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("counts"))
    return terms.where(F.col("docs") >= least).select("lang", "term", "counts")


def groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, total N, and of the language terms V and lang_total, for every group of the documents."""
    there = docs.select(*_named(docs, "lang", "source")).distinct()
    count = kept.select("lang", F.inline("counts")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    size = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    all_of = count.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return there.join(count, ["lang", "source"], "left").join(size, "lang", "left").join(all_of, "lang", "left").select("lang", "source", zero("total"), zero("terms"), zero("lang_total"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + ADDED) / (total + ADDED * terms)), exactly."""
    wide = lambda c, t: c.cast(t)
    over = F.greatest(total + ADDED * terms, F.lit(1))
    return F.call_function("div", F.lit(SCALE).cast("decimal(11,0)") * wide(n + ADDED, "decimal(19,0)"), wide(over, "decimal(19,0)")).cast("bigint") + 1


def shares(n: np.ndarray, over: np.ndarray) -> np.ndarray:
    """share() in numpy: three digits of a long division in base 1,000. n <= over < 2**53."""
    rest, found = n, 0
    for _ in range(3):
        found, rest = found * 1000 + rest * 1000 // over, rest * 1000 % over
    return found + 1


def pair_sums(vectors: np.ndarray, often: np.ndarray) -> np.ndarray:
    """vectors: shares, a row for each distinct vector; often: their multiplicities. Sums of |p - q| for each pair i < j, by i and j."""
    n, size = vectors.shape
    total = np.zeros((size, size), dtype=np.int64)
    step = max(1, CELLS // max(size, 1))
    for at in range(0, n, step):
        own, m = np.ascontiguousarray(vectors[at : at + step].T), often[at : at + step]
        for i in range(size - 1):
            total[i, i + 1 :] += np.abs(own[i + 1 :] - own[i]) @ m
    return total[np.triu_indices(size, 1)]


def _compared(batches):
    """Batches of lang, counts (source, n), often, sources, over to lang, a, b, value for a < b."""
    held: dict[str, tuple[list, np.ndarray]] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        for lang in dict.fromkeys(langs):
            own = batch.filter(pa.array(langs == lang))
            sources, over = own.column(3)[0].as_py(), np.maximum(np.array(own.column(4)[0].as_py(), dtype=np.int64), 1)
            place = {s: i for i, s in enumerate(sources)}
            counts, often = own.column(1), own.column(2).to_numpy(zero_copy_only=False)
            entry = counts.flatten()
            row = np.repeat(np.arange(len(own)), np.diff(counts.offsets.to_numpy()))
            at = np.array([place[s] for s in entry.field(0).to_pylist()], dtype=np.int64)
            dense = np.zeros((len(own), len(sources)), dtype=np.int64)
            dense[row, at] = entry.field(1).to_numpy(zero_copy_only=False)
            sums = pair_sums(shares(dense + ADDED, over), often)
            held[lang] = (sources, held[lang][1] + sums if lang in held else sums)
    for lang, (sources, sums) in held.items():
        i, j = np.triu_indices(len(sources), 1)
        name = np.array(sources, dtype=object)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(sums), pa.string()), pa.array(name[i], pa.string()), pa.array(name[j], pa.string()), pa.array(sums)], ["lang", "a", "b", "value"])


def distinct_vectors(kept: DataFrame) -> DataFrame:
    """lang, counts and the number of terms that have them."""
    return kept.groupBy("lang", "counts").agg(F.count("*").alias("often"))


def pairs(kept: DataFrame, known: DataFrame) -> DataFrame:
    """lang, a, b, value for a < b: every pair of sources of a language."""
    of_lang = known.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", (F.col("total") + ADDED * F.col("terms")).alias("over")))).alias("s"))
    of_lang = of_lang.select("lang", F.col("s.source").alias("sources"), F.col("s.over").alias("over"))
    # A vector of no terms for each language, so that its pairs are there.
    none = of_lang.select("lang", F.array().cast(kept.schema["counts"].dataType).alias("counts"), F.lit(0).cast("bigint").alias("often"))
    rows = distinct_vectors(kept).unionByName(none).join(of_lang, "lang").select("lang", "counts", "often", "sources", "over")
    return rows.mapInArrow(_compared, "lang string, a string, b string, value bigint").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: `pair`, all other sources of the language by their divergence from the source;
    `term`, the `top` terms whose share is furthest above the language's."""
    kept = staged(kept_terms(docs, least), "terms")
    known = staged(groups(docs, kept), "groups")
    both = F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    found = pairs(kept, known).select("lang", both, "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = found.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    all_n = F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, c: s + c["n"])
    own = kept.select("lang", F.col("term").alias("item"), all_n.alias("_all"), F.inline("counts")).join(known, ["lang", "source"])
    above = own.select("lang", "source", "item", (share(F.col("n"), F.col("total"), F.col("terms")) - share(F.col("_all"), F.col("lang_total"), F.col("terms"))).alias("value")).where("value > 0")
    best = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.select(columns).unionByName(best.select(columns))


#: Terms by the definition, every pair evaluated at every term.
ORACLE = """with d as (select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
    t as (select row, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
    k as (select lang, term, count(*) as lang_n from t group by all having count(distinct row) >= 30),
    v as (select lang, count(*) as v, sum(lang_n) as lang_total from k group by all),
    g as (select distinct lang, source from d),
    c as (select lang, source, term, count(*) as n from t semi join k using (lang, term) group by all),
    s as (select g.lang, g.source, coalesce(v.v, 0)::hugeint as v, coalesce(v.lang_total, 0)::hugeint as lang_total, coalesce(sum(c.n), 0)::hugeint as total from g left join v using (lang) left join c using (lang, source) group by all),
    p as (select s.lang, s.source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 5) // (s.total + 5 * s.v) as p, 1 + 1000000000::hugeint * (k.lang_n + 5) // (s.lang_total + 5 * s.v) as q
          from s join k using (lang) left join c on c.lang = s.lang and c.source = s.source and c.term = k.term),
    x as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
    y as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0)::bigint as value from s a join s b on a.lang = b.lang and a.source <> b.source left join x on x.lang = a.lang and x.source = a.source and x.item = b.source),
    z as (select lang, source, 'term' as part, term as item, (p - q)::bigint as value from p where n > 0 and p > q),
    r as (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from (select * from y union all select * from z))
    select * from r where part = 'pair' or rank <= 50"""

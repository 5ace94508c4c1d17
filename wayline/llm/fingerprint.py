"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document is a set of words weighted by their counts. For each sample k and word there are r and c from
Gamma(2, 1) and b from Uniform(0, 1), all derived from the word's hash; with t = floor(ln w / r + b) the
word's value is ln c - r (t - b + 1), and the word with the least value is the sample, together with t.
Two documents draw the same sample with a probability equal to their generalised Jaccard similarity, so
the share of equal samples estimates it; its standard error is at most 0.5 / sqrt(SAMPLES).

The edited text of a document is its first half with the start of the next document, by descending id,
after it. Order and lengths are worked out on ids and lengths alone, in range partitions with their edges
joined; texts are shuffled once by id, and the starts that go into other texts once more. A word's draws are
made once for the text and the edited text together: a row of the counting has the word's count in both.

Defined results: rows with the same doc_id and the same text are one document in the order, and give a row
each; several texts of one doc_id are several documents, by text hash within the id; documents without an id
come last in the descending order. A null or empty text, or one of white space only, has no words; its samples are all
empty, and the likeness of two such texts is 1, of one such and another text 0. Equal texts have equal
fingerprints. Words are runs of characters other than ASCII white space, A-Z in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged

SAMPLES = 32
SPACES = "[\\x20\\x09-\\x0D]+"
#: The value of a sample of no words.
EMPTY = (1 << 63) - 1
#: 64-bit pieces of a SHA-256.
FACTS = 4


def _samples(word_hash: Column, log_weights: list[Column], n: int) -> list[list[Column]]:
    """For each sample and weight a bigint whose order is the value's and whose low bits name word and t; null for a
    null weight. The weights share the draws. A variate of Gamma(2, 1) is minus the logarithm of a product of two
    uniform ones."""

    def uniform(h: Column, at: int, bits: int) -> Column:
        held = h if at == 0 else F.shiftrightunsigned(h, at)
        if at + bits < 64:
            held = held.bitwiseAND(F.lit((1 << bits) - 1))
        return (held + F.lit(0.5)) * F.lit(2.0**-bits)

    out = []
    for k in range(n):
        # One hash gives r (two uniform variates of 21 bits) and b (21 bits), the other c (two of 32 bits).
        a, b = F.xxhash64(word_hash, F.lit(2 * k)), F.xxhash64(word_hash, F.lit(2 * k + 1))
        r = -F.log(uniform(a, 0, 21) * uniform(a, 21, 21))
        log_c = F.log(-F.log(uniform(b, 0, 32) * uniform(b, 32, 32)))
        shift = uniform(a, 42, 21)
        own = []
        for log_weight in log_weights:
            t = F.floor(log_weight / r + shift)
            value = log_c - r * (t - shift + F.lit(1.0))
            # Values lie in (-100, 4); 39 bits of them, then 23 bits of the word and t.
            order = ((value + F.lit(1024.0)) * F.lit(2.0**28)).cast("bigint")
            name = b.bitwiseXOR(t * F.lit(40_503)).bitwiseAND(F.lit((1 << 23) - 1))
            own.append(F.shiftleft(order, 23).bitwiseOR(name))
        out.append(own)
    return out


def neighbours(rows: DataFrame) -> DataFrame:
    """rows: kd, th, n. Distinct rows in descending order of (kd, th), each with its number of copies, with the key of
    the next (next_kd, next_th), and with the key and n of the one before it; the order is a circle."""
    ordered = staged(
        rows.groupBy("kd", "th", "n").agg(F.count("*").alias("copies")).repartitionByRange(F.desc("kd"), F.desc("th")).withColumn("part", F.spark_partition_id()), "order"
    )
    key = F.struct("kd", "th", "n")
    inner = Window.partitionBy("part").orderBy(F.desc("kd"), F.desc("th"))
    local = ordered.select("*", F.lead(key).over(inner).alias("after"), F.lag(key).over(inner).alias("before"))
    # A row for each partition, not for each document.
    edges = ordered.groupBy("part").agg(F.max(key).alias("first"), F.min(key).alias("last"))
    line, circle = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select(
        "part",
        F.coalesce(F.lead("first").over(line), F.first("first").over(circle)).alias("part_after"),
        F.coalesce(F.lag("last").over(line), F.last("last").over(circle)).alias("part_before"),
    )
    found = local.join(edges, "part").withColumns({"after": F.coalesce("after", "part_after"), "before": F.coalesce("before", "part_before")})
    return found.select(
        "kd", "th", "n", "copies", F.col("after.kd").alias("next_kd"), F.col("after.th").alias("next_th"),
        F.col("before.kd").alias("before_kd"), F.col("before.th").alias("before_th"), F.col("before.n").alias("before_n"),
    )


def _likeness(a: Column, b: Column) -> Column:
    same = F.zip_with(a, b, lambda x, y: F.when(x == y, 1.0).otherwise(0.0))
    return F.aggregate(same, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def _text(samples: Column) -> Column:
    return F.array_join(F.transform(samples, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def _folded(word: Column) -> Column:
    """A-Z in lower case, other letters as they are; ASCII words need no look-up of each letter."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _words(text: Column) -> Column:
    """The words of a text as they stand, an array; none for a text of white space."""
    body = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACES))


def fingerprints(texts: DataFrame, keys: list[str], bodies: list[str], facts: Column | None = None, samples: int = SAMPLES) -> DataFrame:
    """For each row of texts the keys, which are unique, and for each text column of `bodies` its fingerprint under the
    same name, an array of bigint; null texts are empty. `facts`, an array of 16-digit hexadecimal strings, comes back as
    an array of bigint."""
    n = len(bodies)
    lines = [F.struct(F.lit(i).alias("which"), _words(F.coalesce(F.col(c), F.lit(""))).alias("words")) for i, c in enumerate(bodies)]
    # The facts travel as rows of their own kind, so that one aggregate over numbers gives them and the samples, in one pass.
    facts = F.array(F.lit("0" * 16)) if facts is None else facts
    lines = texts.select(*keys, F.explode(F.array(*lines, F.struct(F.lit(n).alias("which"), facts.alias("words")))).alias("line"))
    words = lines.select(*keys, F.col("line.which").alias("which"), F.posexplode("line.words").alias("at", "word"))
    is_fact = F.col("which") == n
    # A word is known by its hash, of fixed length: that makes the counting's keys short.
    hashed = words.select(
        *keys, "which", F.when(is_fact, F.col("at")).otherwise(-1).alias("fact"), F.when(is_fact, F.conv("word", 16, -10).cast("bigint")).otherwise(F.xxhash64(_folded(F.col("word")))).alias("h")
    )
    weighted = hashed.groupBy(*keys, "fact", "h").agg(*[F.sum((F.col("which") == i).cast("bigint")).alias(f"n{i}") for i in range(n)])
    # The logarithm of no weight is null, and so is the sample. The samples stand inside the aggregates: as columns of
    # their own they would make one method too long to be compiled.
    drawn = _samples(F.col("h"), [F.log(f"n{i}") for i in range(n)], samples)
    least = [F.min(drawn[k][i]).alias(f"s{i}_{k}") for i in range(n) for k in range(samples)]
    given = [F.max(F.when(F.col("fact") == i, F.col("h"))).alias(f"f{i}") for i in range(FACTS)]
    found = weighted.groupBy(*keys).agg(*least, *given)
    whole = [F.array(*[F.coalesce(f"s{i}_{k}", F.lit(EMPTY)) for k in range(samples)]).alias(c) for i, c in enumerate(bodies)]
    return found.select(*keys, *whole, F.array(*[f"f{i}" for i in range(FACTS)]).alias("facts"))


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """docs: doc_id, text. For each document: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next."""
    nameless = F.lit(-(1 << 63))
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), nameless).alias("kd"), F.xxhash64(body).alias("th"), body.alias("text"))
    order = staged(neighbours(keyed.select("kd", "th", F.char_length("text").cast("bigint").alias("n"))), "neighbours")
    # Copies go before the shuffle as well as after it.
    placed = keyed.dropDuplicates(["kd", "th"]).join(order, ["kd", "th"])
    half = F.floor(F.col("n") / 2).cast("int")
    starts = placed.select(
        F.col("before_kd").alias("kd"), F.col("before_th").alias("th"), F.substring("text", F.lit(1), F.floor(F.col("before_n") / 2).cast("int")).alias("start")
    )
    edited = placed.join(starts, ["kd", "th"]).select("kd", "th", "text", F.concat(F.substring("text", F.lit(1), F.col("n").cast("int") - half), "start").alias("edited"))
    digest = F.sha2(F.col("edited").cast("binary"), 256)
    pieces = F.array(*[F.substring(digest, 16 * k + 1, 16) for k in range(FACTS)])
    held = staged(fingerprints(edited, ["kd", "th"], ["text", "edited"], pieces, samples), "fingerprints")
    paired = held.select("kd", "th", F.col("text").alias("a"), F.col("edited").alias("b"), "facts").join(order, ["kd", "th"])
    following = held.select(F.col("kd").alias("next_kd"), F.col("th").alias("next_th"), F.col("text").alias("next_a"))
    rows = paired.join(following, ["next_kd", "next_th"]).select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return rows.select(
        F.nullif("kd", nameless).alias("doc_id"), F.col("n").alias("n_chars"), _text(F.col("facts")).alias("edited_sha256"), _text(F.col("a")).alias("fingerprint"),
        _text(F.col("b")).alias("edited_fingerprint"), _likeness(F.col("a"), F.col("b")).alias("near_edited"), _likeness(F.col("a"), F.col("next_a")).alias("near_next"),
    )

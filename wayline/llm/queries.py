"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, divergence, filter_audit, fingerprint, language, language_model, licences, quality, sharding, simhash, warc
from .pieces import encode_documents
from .shared import fold, scratch, table


def public_model(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Arrivals in which op1 appends the documents, and rows of a shard.
ARRIVALS, SHARD_ROWS = 4, 2_000


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document arrives in one of ARRIVALS batches, is compacted and read back from the last manifest."""
    docs = table(spark, sf_dir, "documents")
    store = sharding.Store(spark, scratch(spark, "shards"))
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS))
    for k in range(ARRIVALS):
        store.append(docs.where(batch == k), SHARD_ROWS)
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(table(spark, sf_dir, "conversations"))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"), licences.known(spark))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    held_out = fold(F.col("doc_id"), 4) == 2
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_model("piece_bpe_32k.model"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.predict(docs.select("doc_id", "text"), language.fit(docs))
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    "op2_chat": op2_chat,
    "op1_sharding": op1_sharding,
    "op5_licences": op5_licences,
    "op9_warc": op9_warc,
    "op3_language_model": op3_language_model,
    "op7_fingerprint": op7_fingerprint,
    "op4_decontaminate": op4_decontaminate,
    "op6_quality": op6_quality,
    "op10_simhash": op10_simhash,
    "op8_sentencepiece": op8_sentencepiece,
    "op11_language": op11_language,
    "op12_filter_audit": op12_filter_audit,
    "op13_divergence": op13_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op12_filter_audit": filter_audit.ORACLE,
    "op13_divergence": divergence.ORACLE,
    "op1_sharding": "select doc_id, lang, source, n_chars, sha256(text) as text_sha256 from documents",
    "op5_licences": licences.oracle(),
    "op9_warc": """
        with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, ''))::bigint as n, sha1(coalesce(html, '')) as digest from pages),
        g as (select html, max(page_id) as top from p where n >= 1000 group by html)
        select page_id, n as payload_bytes, digest as payload_digest,
               case when page_id < top then 'revisit' else 'response' end as record_type,
               case when page_id < top then top end as refers_to
        from p left join g using (html)
    """,
}

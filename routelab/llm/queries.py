"""Named queries of the corpus operators, over the driver's tables and over whole texts."""

from __future__ import annotations

import secrets

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routelab.llm import bpe, compression_rules, decontamination, jaccard_join, oracles, pseudonyms, quality_classifier, ranked_search, sharding, token_counts, url_reputation, warc, word_bpe
from routelab.llm.common import spread, table

RANKS = "byte_bpe_50k.tiktoken"
WORDS = "word_bpe_49k.json"
END_OF_DOCUMENT = 50256

#: Edits allowed in a benchmark passage, as a share of its characters.
EDITS = 0.1

#: The session's setting with the key of pseudonyms.
KEY = "routelab.pii.key"

#: (verdict, host/path): the url rules of the pages table.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
BAD_PAGE = "CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NULL AND toxic IS NULL THEN NULL ELSE 0 END"


def scored(spark: SparkSession, docs: DataFrame, sf_dir: str, text: str = "text") -> DataFrame:
    """``docs`` with score and predicted; the model learns from the whole documents table."""
    model = quality_classifier.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), max_rows=20_000, words_too=True)
    return quality_classifier.score(spread(docs), model, text, threshold=0.3)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(spark, docs, sf_dir).select("doc_id", (quality_classifier.fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = token_counts.document_tokens(spread(docs.select("doc_id", "text")), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, END_OF_DOCUMENT)
    return counted.select("doc_id", "n_tokens")


def op3_compression_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = compression_rules.compression_rules(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return judged.select("doc_id", *compression_rules.FIELDS)


def op4_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_and_read(table(spark, sf_dir, "pages"), least=100)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=24)


def pii_key(spark: SparkSession) -> str:
    """The key that the session sets. One that sets none gets a random key and keeps it: nobody else can link or undo its pseudonyms."""
    if not spark.conf.get(KEY, None):
        spark.conf.set(KEY, secrets.token_hex(32))
    return spark.conf.get(KEY)


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), pii_key(spark)).select("doc_id", "text", "n_pseudonyms")


def leaks(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_items(spread(docs.select("doc_id", "text")), table(spark, sf_dir, "benchmark"), EDITS)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), spark, sf_dir)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"), width=4, percent=85)


def _digests(both: DataFrame) -> DataFrame:
    return both.select(
        "doc_id",
        F.expr("cast(octet_length(token_ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def token_digests(docs: DataFrame) -> DataFrame:
    return _digests(bpe.round_trip(spread(docs.select("doc_id", "text")), public_tokenizers.path(RANKS), public_tokenizers.PATTERN))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


def op10_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.expr(BAD_PAGE).alias("bad"))
    return url_reputation.judge_urls(table(spark, sf_dir, "pages"), outcomes, URL_RULES)


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _digests(word_bpe.round_trip(spread(docs), public_tokenizers.path(WORDS)))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"), k=20)


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_token_counts": op2_token_counts,
    "op3_compression_rules": op3_compression_rules,
    "op4_warc_archives": op4_warc_archives,
    "op5_jump_sharding": op5_jump_sharding,
    "op6_pseudonyms": op6_pseudonyms,
    "op7_decontamination": op7_decontamination,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_host_reputation": op10_host_reputation,
    "op11_word_bpe": op11_word_bpe,
    "op12_ranked_search": op12_ranked_search,
}

ORACLE_SQL = {
    "op4_warc_archives": oracles.WARC,
    "op8_jaccard_join": oracles.JACCARD,
    "op10_host_reputation": oracles.HOSTS,
    "op12_ranked_search": oracles.RANKED,
}

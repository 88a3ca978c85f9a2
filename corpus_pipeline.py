"""Corpus pipeline: quality classifier, near duplicates, benchmark decontamination, personal data, token ids.

Every stage takes and gives whole tables. For all of them: null and empty texts, texts of any length, nulls in any column, repeated
rows and empty tables are allowed; columns beside those of ``documents``, whatever their names, pass through all stages but the last.
What each case gives is stated at the stage; the operators' modules say more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routelab.llm import decontamination, jaccard_join, pseudonyms
from routelab.llm import queries as q
from routelab.llm.common import spread, staged, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    The model learns from the whole ``documents`` table's labelled rows, not from ``docs``. A null or empty text has the score of the
    bias alone and stays or goes by it; repeated rows share their score; a score at the threshold is accepted.
    """
    numbered = [f"c{k}" for k in range(len(docs.columns))]  # no name of the table's own can clash with a score's
    scored = q.scored(spark, docs.toDF(*numbered), sf_dir, numbered[docs.columns.index("text")])
    return scored.filter("predicted = 1").select(numbered).toDF(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word shingle sets with a similarity of 0.8 or more: that of the least id.

    A null or empty text is like no other and stays; so does every row of null id, which is never compared. Rows that repeat an id
    are one document, of which the row of least hash over all columns stays.
    """
    return jaccard_join.one_of_each_class(docs, width=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage, within a tenth of the passage's characters as edits.

    A null or empty text holds none and stays; items without word characters match nothing; repeated rows and rows of null id are
    judged like others. An empty benchmark lets everything pass.
    """
    return decontamination.without_items(spread(docs), table(spark, sf_dir, "benchmark"), q.EDITS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms; n_chars follows texts that changed.

    Null and empty texts, and texts without personal data, stay as they are, with their n_chars, null or wrong as it may be. Rows
    that repeat get the same text.
    """
    count = pseudonyms.fresh_name(docs, "n_pseudonyms")
    hidden = pseudonyms.pseudonymise(docs, q.pii_key(spark), count=count)
    return hidden.withColumn("n_chars", F.when(F.col(count) > 0, F.char_length("text")).otherwise(F.col("n_chars"))).select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of each document's ids and of their decoded bytes.

    A null or empty text has no tokens and the digests of no bytes; repeated rows stay repeated; a null id stays null.
    """
    return q.token_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("personal data", without_personal_data),
    ("byte-level BPE", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read back as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Vector and count models, edit distance and BPE have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None

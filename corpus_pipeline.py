"""The corpus pipeline: quality classifier, exact dedup, SimHash near-dedup, secret scan, best-fit packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wortnetz.llm import exact_dedup, near, packing, quality, secrets
from wortnetz.llm.common import cut, table


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps; labels serve to mine insults, from a bounded sample. Null and empty texts stay,
    repeated rows are decided alike, a table without rows gives none; extra columns stay as they are."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels")).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one that exact dedup keeps: that with the longest original text, then the smallest id.
    Null and empty texts are equal to each other, of repeated rows one stays, a table without rows gives none; extra columns
    stay as they are."""
    return exact_dedup.keep_first(docs).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles are verified to have a similarity of 0.8 or more, the one with the smallest id
    of each group. Null ids come last; texts without words are equal to each other; a table without rows gives none; extra
    columns stay as they are."""
    return near.keep_one(docs).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; n_chars follows the text. Null and empty texts and repeated rows stay,
    a table without rows gives none; extra columns stay as they are."""
    return secrets.masked(docs).selectExpr(*(f"cast(length(text) AS bigint) AS {c}" if c == "n_chars" else f"`{c}`" for c in docs.columns))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of each document, with its sequence and place there. Null and empty texts are the end id alone, each of
    repeated rows is packed, a table without rows gives none; extra columns do not matter."""
    return packing.pack_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", drop_bad),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack_tokens),
]

#: SQL expresses neither the trained classifier nor fingerprints and tokens; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each stored before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs

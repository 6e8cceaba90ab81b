"""A corpus pipeline of five stages over `documents`; each stage reads what the one before wrote.

Language ID drops documents that no model accounts for; SimHash near-dedup keeps one
document of each group; the secret scan replaces secrets in the texts; mixing repeats or
drops documents by the rates that meet the domains' target shares; best-fit packing
places all tokens in sequences. SQL cannot express the stages, so ORACLE_SQL is None and
the tests hold run() against a brute-force version.

Cases, for every stage: all but the last return the columns they were given, in their
order, and change none but `text` and `n_chars` (mask_secrets); columns of any other name,
those of an operator's results included, go through unchanged. An empty table gives no
rows. Null and empty texts: rejected by language ID (no letter); in the later stages an
empty text is one document (fingerprint zero), has no secret, no words to mix and one
token. Repeated rows and rows of one doc_id are one document to near-dedup, which keeps
the least of them, and of a group without any id its least row; the other stages treat
each row alone. Very long texts are used whole. Ties go to the smaller doc_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.llm import language_id, mixing, packing, secrets, simhash
from chronolex.llm.common import columns_of, stored, table
from chronolex.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    found = language_id.identify(docs, language_id.learn(docs))
    return found.where(~F.col(found.columns[-1])).select(columns_of(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group."""
    return simhash.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts give way to a mark, and n_chars, if there, follows."""
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast("long"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their domain's target share asks for."""
    return mixing.mixed(docs, mixing.domains(table(spark, sf_dir, "labels")), mixing.TARGETS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path(), cache_entries=200_000)  # executors keep the workers of all stages


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("mixing", mix_domains),
    ("best_fit_packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, name)
    return docs

"""A training corpus from documents: each stage's rows are written as Parquet and reread as the next one's documents.

Defined cases, in every stage: a null text has no language and goes in the first one; a null doc_id is a document like any
other, of which near-duplicates keep those with an id first; empty texts and texts without a letter go in the first stage;
texts of any length are read whole; of near-duplicates that tie the one with the smallest doc_id stays, and of repeated rows
one; null lang, source and n_chars are kept as they are, but for n_chars of a text that loses a part; columns besides those
of documents are kept to the last stage, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import bpe, common, decontaminate, langid, simhash, suffix


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null or no letter) go."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    return simhash.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte of a 200-byte string that starts twice in what is left goes from its text."""
    return suffix.keep_unrepeated(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests of each text's tokens, and of what they decode to."""
    return bpe.digest(docs)


STAGES = [
    ("language ID", language),
    ("near-duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("decontamination", benchmark_passages),
    ("tokens", tokens),
]

#: No SQL expresses language ID, fingerprints or byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

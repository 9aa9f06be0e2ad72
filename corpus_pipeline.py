"""A training corpus from raw documents: rules, exact and near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termsieve.llm import exact, packing, registry, rules, simhash, suffix
from termsieve.llm.base import clear, fresh_path, made, swept, table

#: A passage that repeats is removed if it has more words than this. It is searched for as a string of PASSAGE
#: bytes, which 51 words have at least: a letter each, and what stands between them.
PASSAGE_WORDS, PASSAGE = 50, 101


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.passing(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8: of each group the smallest id stays."""
    return simhash.without_near_copies(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every occurrence of a passage of over 50 words that repeats goes; a document that is nothing else stays, empty,
    and is packed as its end token."""
    return suffix.without_repeats(docs, PASSAGE, PASSAGE_WORDS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, registry.vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("pack", pack),
]

#: Quality model, components and packing have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage leaves behind goes when the next one's rows are written."""
    docs, mark = table(spark, sf_dir, "documents"), made()
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        out = stage(spark, docs, sf_dir)
        with swept(spark):
            out.write.parquet(path)
        docs = spark.read.parquet(path)
        clear(spark, mark, keep=path)
    return docs

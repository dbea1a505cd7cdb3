"""A corpus from raw documents to packed sequences.

Quality rules reject documents, exact and near copies leave one of each group, sources are mixed to their weights, and
what is left is packed. ``STAGES`` are applied in order; each result is written as Parquet and read back as the next
stage's documents. All stages but the last return the columns of ``documents``.

Defined cases, of every stage: a null text counts as empty and fails the base rule; null identifiers and sources are kept
as such; repeated rows are exact copies, so one of them goes on; further columns pass through whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomframe.llm import exact_dedup, mixing, near_text, packing, quality
from loomframe.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the rules learned from ``labels``."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest doc_id."""
    return exact_dedup.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts whose five-word shingles are alike by 0.8 or more, that with the smallest doc_id:
    pairs within reach of SimHash and those that it misses, checked exactly."""
    return near_text.deduplicate(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that each source comes near its target weight."""
    return mixing.mix(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]

#: Learned rules, fingerprints and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, packed token ids.

Counted as part of the training-data subpackage.  Every stage takes (spark, docs,
sf_dir) and works on all rows of docs, the Parquet that the stage before it
wrote.  All but the last return the columns of documents; the last returns, read
back from the packed files, doc_id, start, n_tokens and ids_crc32 of every row of
the mix.  Of a group of near duplicates the least id stays, a row without an id
only if none of the group has one.  An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridlore.llm import jaccard, mixing, packing, quality, winnow
from gridlore.llm.common import discard, stash, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: shingles of five words, similarity of 0.8 or more."""
    return jaccard.one_each(docs, size=5, num=4, den=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of which a twentieth or more lies in windows of benchmark items."""
    return winnow.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated, up to three times, to meet the sources' weights."""
    return mixing.mix(docs)


def packed_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in packed files, read back."""
    return packing.read(packing.write(docs, packing.default_tokenizer(), end_id=2))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing_sources),
    ("packed_ids", packed_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, stash(stage(spark, docs, sf_dir), name)
        discard(before)  # what a stage wrote goes once the next has read it
    return docs


#: No SQL expresses the hypergeometric draws of the mix or the vocabulary's ids; tests hold the stages against brute force.
ORACLE_SQL = None

"""A corpus pipeline: quality rules, near and substring dedup, decontamination and packing, in that order.

Every stage works on all that its predecessor kept, and is written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparktab.llm import decontam, packing, quality, simhash, substring
from sparktab.llm.common import discard, materialize
from sparktab.llm.queries import TOKENIZER, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules or their host's verdict reject go; each row has its own verdict, whatever its id."""
    return quality.good_documents(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints one row stays, that of the least doc_id; a null one is the greatest."""
    return simhash.without_copies(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each repeated passage the first occurrence stays; documents left without a word go. Rows without an id, or
    with the same one, are never each other's repeats, and a null text stays as it is."""
    passages = substring.repeated_passages(docs)
    return substring.without_repeats(docs, passages)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document stands in the training sequences."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality", quality_stage),
    ("simhash", simhash_stage),
    ("substring", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL has no SimHash, compact windows or tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What one stage wrote goes when the next one has read it."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        read, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        if i:
            discard(read)
    return docs

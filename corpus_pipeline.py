"""The document pipeline: five stages, each written and read again before the next.

Stages take (spark, docs, sf_dir) and return the columns of documents, the last one the
packed pieces. Each works on all rows that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import jaccard, mixing, packing, quality, rules
from corpusloom.session import stored, table

ORACLE_SQL = None  # a trained model and a tokenizer are in it; tests compare stages with plain Python


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this stage's input, does not reject."""
    return quality.keep_documents(docs, table(spark, sf_dir, "labels"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return rules.keep_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the least doc_id."""
    return jaccard.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: rows are repeated, or left out at no copies."""
    return mixing.repeat_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents as pieces in token sequences; a repeated document is packed as often."""
    return packing.pack_documents(docs, packing.tokenizer_file())


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", apply_rules),
    ("jaccard_join", drop_near_copies),
    ("source_mixing", mix),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs

"""Documents to packed training sequences: four stages, each one operator over all that its predecessor kept.

Quality rules and the classifier drop the documents they reject, near-dedup keeps one document of each group, and
packing lays what is left into sequences. All but the last return the columns of ``documents``, whatever further columns
it has and however they are named.

Defined results: rows are judged each, also where keys are null or repeated. A null or empty text fails the rules;
given to a later stage, it gets a score, is nobody's duplicate, and is a sequence's worth of one end id. Without labels
of both kinds the classifier keeps all, or none if all labels are 0. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import byte_cnn, host_rules, min_max, packing
from quillgraph.llm.queries import table, tokenizer
from quillgraph.session import drop, ship_package, stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host does."""
    ship_package(spark)
    return host_rules.keep_good(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier good than not."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return byte_cnn.keep_good(docs, labels)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    ship_package(spark)
    return min_max.keep_first(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences of 1024 tokens."""
    ship_package(spark)
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_dedup),
    ("best-fit packing", best_fit_packing),
]

#: A trained classifier decides in the second stage: no SQL gives its rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``, each written as Parquet and read again."""
    docs, before = table(spark, sf_dir, "documents"), []
    for k, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, name.lower().replace(" ", "-"))
            drop(*before)
            before = [docs]
    return docs

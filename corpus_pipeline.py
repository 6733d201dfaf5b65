"""From raw documents to packed training sequences: five stages, each written and read again before the next."""

from __future__ import annotations

import os
import sys

import public_tokenizers
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import cohortflow  # noqa: E402
from cohortflow.llm import jaccard, neighbours, packing, quality_rules, suffixes  # noqa: E402
from cohortflow.llm.queries import WORD_BPE, table  # noqa: E402
from cohortflow.session import settle  # noqa: E402

# Python workers need not have this folder on their path
cloudpickle.register_pickle_by_value(cohortflow)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counted rules and the n-gram regression accept."""
    return quality_rules.keep(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled neighbours speak for them.

    The neighbours come from all documents: of those with label 0, the stage before has removed nearly all.
    """
    return neighbours.keep(docs, neighbours.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    return jaccard.one_of_each(docs, percent=80, n=5)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; ``n_chars`` counts what is left."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = suffixes.remove_repeats(docs, carry=others)
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept"), **{c: F.col(f"carried.`{c}`") for c in others}}
    if "n_chars" in others:
        columns["n_chars"] = F.length("kept").cast("long")
    return found.select([columns[c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.pack(docs, public_tokenizers.path(WORD_BPE))


STAGES = [
    ("quality_rules", quality),
    ("quality_classifier", classifier),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeats),
    ("packing", pack),
]

# No stage but the counted rules can be written as SQL: models are trained, tokens come from a library
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

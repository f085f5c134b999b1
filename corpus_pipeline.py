"""Corpus pipeline: quality rules, toxicity, SimHash near-dedup, packing, each over all that the stage before kept.

Every stage takes documents of any length whole, keeps the columns it is given (extra ones too), bears null ids, null
texts and repeated rows, and makes an empty table of an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import packing, quality, simhash, toxicity
from plumbline.llm.common import cut, forget, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the calibrated regression; null, empty and short texts do not.  Repeated rows are judged each."""
    return quality.filter_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores below one half; a null or empty text has no evidence and stays.  Repeated rows are judged each."""
    return toxicity.filter_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), fold=5))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by five-word shingles at Jaccard 0.8 or more.

    The first by doc_id stays (no id comes last, ties by place in the table); null and wordless texts are copies of each other.
    """
    return simhash.deduplicate_verified(docs, words=5, least=0.8)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens along the Hilbert curve; a null text has but the end id."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_documents),
    ("simhash_near_dedup", near_duplicates),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    held = None
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        if held is not None:
            forget(held)
        held = docs
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None

"""From raw documents to training sequences, in five stages that each apply one operator to what the stage before kept.

All stages but the last return the columns of documents. Each takes an empty table, nulls in any column, empty and very
long texts, repeated rows, and columns whose names the operators use inside; what becomes of them is told at each stage
and, more closely, at its operator.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import exact_dedup, jaccard, packing, pii, quality
from corpusloom.llm._common import discard, documents, labels, staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the risk-controlled cutoffs accept. Null, empty and blank texts have no words and
    go; a null language is a stratum of its own; rows without doc_id are judged like any; repeated rows are judged each;
    an empty table, of documents or labels, is no fault."""
    return quality.keep_good(docs, labels(spark, sf_dir))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of equal texts. Null and empty texts are equal to each other; a doc_id with several
    texts keeps each that no smaller doc_id has; of rows that repeat doc_id and text one stays; rows without doc_id stay."""
    return exact_dedup.keep_first(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of near duplicates: all rows of its smallest doc_id. Texts without words, and
    rows without doc_id, are near to nothing and stay."""
    return jaccard.keep_first(docs)


def mask_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by its kind, n_chars brought up to date. Null texts stay null; overlapping
    spans are masked as one, under the kind that begins first; repeated rows are masked alike."""
    return pii.mask_personal_data(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences. A null or empty text is its end identifier alone; repeated rows, and rows
    without doc_id, are packed each."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard_join", near_dedup_stage),
    ("personal_data", mask_stage),
    ("retrieval_packing", packing_stage),
]

#: Packing needs a tokenizer, which SQL cannot express; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other. Of the tables between them only the one that the last stage reads stays."""
    docs = documents(spark, sf_dir)
    before: list[DataFrame] = []
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)

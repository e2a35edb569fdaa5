"""A corpus pipeline over the documents table: each stage applies one operator to all its predecessor kept.

Every stage but the last returns the columns of documents; the last one returns the packed pieces.

Null and empty texts go at the first stage, as they have no letters. Rows without a doc_id and repeated
rows pass like others: the former count for nothing in stages that compare documents, of the latter one
stays. Other columns, of whatever name, pass through untouched, but n_chars follows the text. An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ladderline.llm import decontaminate, jaccard, langid, lines, packing, queries, shared


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a certain language go: by their text, and by their source as the host. Their lang trains and is not fused."""
    shared.bounded_batches(spark)
    return langid.classify(docs, docs.columns, accepted_only=True)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates stay in the first document only; documents that have no word left go."""
    shared.bounded_batches(spark)
    return lines.clean(docs, every=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked ones stays, that of the smallest doc_id."""
    shared.bounded_batches(spark)
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, queries.table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, each with its sequence and place."""
    shared.bounded_batches(spark)
    return packing.pack_documents(docs, queries.vocabulary("byte_bpe_50k.json"), end_id=2, memo=1 << 16)  # workers hold what earlier stages needed too


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each result written and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline: toxicity, exact and near duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of
``docs`` as they are; the last returns the packed pieces.  Columns that a stage makes on its way get names that
``docs`` does not have, so users' columns may have any name.  An empty table passes every stage as an empty table,
null and empty texts are texts like others, and every text is read whole.  The stages need the subpackage
``thermogrid.llm``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermogrid.llm.dartminhash import near_duplicates
from thermogrid.llm.exact import exact_duplicates
from thermogrid.llm.packing import pack_documents
from thermogrid.llm.store import Workspace, fresh
from thermogrid.llm.substring import remove_repeats
from thermogrid.llm.toxicity import score_toxicity


def _columns(names: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in names]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier does not call toxic; repeated rows share their fate, columns named as its own stay the user's."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score, predicted = fresh(docs.columns, "toxic_score", "toxic_predicted")
    return score_toxicity(docs, labels, names=(score, predicted)).filter(F.col(predicted) == 0).select(*_columns(docs.columns))


def _numbered(spark: SparkSession, docs: DataFrame, name: str) -> tuple[Workspace, DataFrame, str]:
    """The rows with a number of their own, written so that it stays the same: texts under one id, or under none, do not share a fate."""
    work, (row,) = Workspace(spark, name), fresh(docs.columns, "row_number")
    return work, work.keep(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def _one_of_each(rows: DataFrame, row: str, groups: DataFrame, order: Column, columns: list[str]) -> DataFrame:
    """The row of each group (doc_id is the row's number, ``grp``) that comes first by ``order``."""
    told = rows.select(F.col(row).alias("_n"), F.col("doc_id").alias("_id"))
    kept = groups.join(told, groups.doc_id == F.col("_n")).groupBy("grp").agg(F.min_by("_n", order).alias(row)).select(row)
    return rows.join(kept, row, "left_semi").select(*_columns(columns))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text (A-Z and a-z alike): that with the largest doc_id, nulls last; of rows that repeat it the first."""
    _, rows, row = _numbered(spark, docs, "exact-rows")
    groups = exact_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).select("doc_id", F.col("keep_id").alias("grp"))
    return _one_of_each(rows, row, groups, F.struct(F.col("_id").isNull(), -F.col("_id"), F.col("_n")), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: that with the smallest doc_id, nulls last; of rows that repeat it the first."""
    _, rows, row = _numbered(spark, docs, "near-rows")
    groups = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).select("doc_id", F.col("class_id").alias("grp"))
    return _one_of_each(rows, row, groups, F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_n")), docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, less the words of passages that a document with a smaller doc_id has too; n_chars follows the text."""
    (changed,) = fresh(docs.columns, "text_changed")
    out = remove_repeats(docs, changed=changed)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(changed), F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*_columns(docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows; repeated rows and null ids are packed as they come."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack),
]

#: No stage but the second can be written in SQL; tests/llm/test_pipeline.py holds each stage, and run(), against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = work.keep(out, name) if k < len(STAGES) - 1 else out
    return docs

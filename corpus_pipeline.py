"""A training-data pipeline: each stage takes the documents that the one before it kept.

The filtering stages return the columns they are given, whatever their names, and
each row as it was but for what the stage is to change. An empty table stays one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajectorium.llm import jaccard_dedup, langid, packing, quality, queries, secret_scan
from trajectorium.llm.common import free_names
from trajectorium.session import materialize

#: Documents whose language is less certain go.
LEAST_SCORE = 0.35
#: No SQL expresses the network or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language.

    Null and empty texts and those without a letter have none and go; of equal
    probabilities the first language counts. Very long texts are read whole, and
    repeated rows stay or go together.
    """
    lang, score = free_names(docs, "_lang_pred", "_score")
    judged = langid.predict(docs, langid.train(docs), (lang, score))
    return judged.where((F.col(lang) != langid.UND) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number of each row, and its column's name: doc_id where that is a whole number of each row's own, else a number that a written table holds."""
    (row,) = free_names(docs, "_row")
    if docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") and docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        return docs.withColumn(row, F.col("doc_id").cast("long")), row
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source.

    Null and empty texts fail the base rules and go. Null languages and sources
    are groups of their own; a distance at the bound stays; repeated rows count
    and are judged each; very long texts are read whole.
    """
    rows, row = numbered(docs)
    judged = quality.judge(rows.select(F.col(row).alias("doc_id"), "text", "lang", "source"))
    gone = materialize(judged.where(~F.col("kept")).select(F.col("doc_id").alias(row)), "rejected")
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more.

    Null and empty texts and those without a word are copies of each other; so
    are repeated rows, of which one stays: the one of the smallest number, which is
    its doc_id if all rows have one of their own. Very long texts are compared whole.
    """
    rows, row = numbered(docs)
    gone = materialize(jaccard_dedup.copies(rows.select(F.col(row).alias("row"), "text")).withColumnRenamed("row", row), "copies")
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and n_chars, if there is one, counted anew.

    Null and empty texts stay as they are; a null source is an owner of its own;
    repeated rows are masked alike; very long texts are scanned whole; overlapping
    spans are masked once.
    """
    return secret_scan.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences: the columns of op7's query.

    A null text is empty and makes a piece of the end id; a null doc_id is carried
    along; repeated rows are packed each; very long texts make many pieces; pieces
    of one length are alike.
    """
    return packing.best_fit_packing(docs, queries.WORD_BPE)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else materialize(docs, name), sf_dir)
    return docs

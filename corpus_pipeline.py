"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Every stage takes the columns of documents and ignores others. Null texts are as empty ones, nulls in other columns are kept,
rows are told apart by what they hold and not by doc_id, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import cotraining, line_rules, minhash, packing, pii
from tessera.llm.common import WRITTEN, discard, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained views score as good (0.5 or more), rows unchanged; repeated rows fare alike.

    Labels are those of documents still there; labels of one class, or none, reject nothing unless all are bad.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = docs.select(*COLUMNS)
    return cotraining.fit(docs, labels).score(docs).where("score >= 0.5").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep the rules, without the lines that too many documents of their host share; what near copies share stays in one.

    Exact copies count as one document and fare alike. Texts of fewer than ten words, so null and empty ones, go.
    """
    kept = line_rules.line_frequency_rules(docs.select(*COLUMNS), count_texts=True, copies_once=True).where("kept")
    text = line_rules.without_removed(F.col("text"), F.col("removed_lines"))
    return kept.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of exact and near copies (minhash.one_of_each): the smallest doc_id, null ids last, ties by content."""
    return minhash.one_of_each(docs.select(*COLUMNS))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; a null text stays null. No row goes."""
    masked = pii.mask(pii.find_pii(docs.select(*COLUMNS)))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents and their places in sequences of 1024; a null text is packed as an empty one."""
    return packing.pack(docs).drop("ids")


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("pii", mask_pii), ("packing", pack_sequences)]

#: SQL can express neither the classifier, nor the sampling, nor the tokens: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), set(WRITTEN)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
            discard(spark, *(path for path in list(WRITTEN) if path not in before and path != docs.written_to))  # the stage has been written
    return docs

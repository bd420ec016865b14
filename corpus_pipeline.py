"""The corpus pipeline: stages over documents, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import decontamination, language_id, line_dedup, minhash_dedup, sentencepiece_codec
from marlstone.llm.common import complete, ready, settle, table, written

LEAST_SCORE = 0.4  # of a language, of four or more that are told apart


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows; those without a letter or a likely language go."""
    ready(spark)
    seen = language_id.predict(docs, language_id.train(docs), names=("__lang", "__score"))
    return seen.filter((F.col("__lang") != language_id.NO_LANGUAGE) & (F.col("__score") >= LEAST_SCORE)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of repeated lines; those that lose every line go."""
    ready(spark)
    left = line_dedup.line_dedup(docs, counts=("__n_lines", "__n_removed"))
    left = left.filter((F.col("__n_removed") == 0) | F.col("text").rlike(r"\S"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    ready(spark)
    return minhash_dedup.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    ready(spark)
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of their decoded text."""
    ready(spark)
    return sentencepiece_codec.token_digests(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", decontaminate),
    ("sentencepiece", tokenize),
]
# The network and the alignment are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over documents, each stage's output a table that the next one reads.

    With a folder that the executors share, stages stand there under their names, and a run that broke off goes on behind
    the last one that ended well; the caller names another folder for other inputs. Without, each run has its own tables.
    """
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        if folder is None:
            docs = settle(stage(spark, docs, sf_dir), name)
            continue
        path = f"{folder}/{k}-{name}"
        done = complete(spark, path)
        docs = written(stage(spark, docs, sf_dir), path) if done is None else done
    return docs

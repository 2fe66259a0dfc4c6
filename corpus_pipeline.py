"""Corpus pipeline: quality, near-duplicates, personal data, mixture, token ids. Part of the subpackage ``llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloakspark.llm import mixing, pii, quality, sentencepiece, simhash
from cloakspark.llm.common import write_table
from cloakspark.llm.queries import MODEL_FILE


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches a half, as they are. Null and empty texts are scored like any; repeated rows stay or go together."""
    return quality.keep_quality(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word likeness 0.8; texts without words (also null ones) are one group, of repeated rows one stays."""
    return simhash.drop_near_duplicates(spark, docs, similarity=0.8, shingle=5)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced and n_chars renewed; null texts stay null, repeated rows repeated."""
    return pii.redact_pii(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them (0 to 2 times); texts without words (also null ones) stay once, a null source is one."""
    return mixing.take_mix(spark, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row; a null text has none."""
    return sentencepiece.encode_decode(docs, MODEL_FILE)


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("pii", redact_pii), ("mix", mix_sources), ("encode", encode)]
#: Fitted classifiers, expectation-maximisation and Viterbi are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is a table in the shared folder, as the next one's input.

    Every stage keeps all columns it is given, whatever their names, and an empty table gives an empty result.
    """
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        df = stage(spark, df, sf_dir)
        if i + 1 < len(STAGES):
            df = write_table(spark, df, name)
    return df

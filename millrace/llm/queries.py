"""Queries of the text problems (pN_...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import handwritten, langid, mixing, tokens


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_by_hand(handwritten.judged(_table(spark, d, "sources"))).select("file").distinct()


def p3_files(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.judged(_table(spark, d, "sources")).select("file", "generated", "minified", "vendored", "data")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(_table(spark, d, "documents"), "doc_id", "text")


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(mixing.sized(_table(spark, d, "documents"), "doc_id", "text", "source"), _table(spark, d, "mix_targets"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0].withColumnRenamed("doc", "doc_id")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    return langid.stretches(_table(spark, d, "documents"), "doc_id", "text", langid.train(_table(spark, d, "lang_samples")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.mislabelled(_table(spark, d, "documents"), p8_segments(spark, d), "doc_id", "lang")


def p8_documents(spark: SparkSession, d: str) -> DataFrame:
    return langid.document_languages(_table(spark, d, "documents"), p8_segments(spark, d), "doc_id")


QUERIES = {f.__name__: f for f in (p3_found, p3_files, p6_ids, p7_mix, p7_shares, p8_found, p8_segments, p8_documents)}
ORACLES: dict[str, str] = {}

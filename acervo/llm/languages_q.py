"""Problem 10: missing or wrong document language labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.llm.languages import languages_of, wrong_or_mixed
from acervo.session import table


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages_of(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source", "client_code")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrong_or_mixed(_read(spark, sf_dir))


def p10_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its language and confidence."""
    return _read(spark, sf_dir).select(F.col("id").alias("doc_id"), F.col("label").alias("declared"), "lang", "confidence", "words")


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence with its language and confidence."""
    return _read(spark, sf_dir).select(F.col("id").alias("doc_id"), F.explode("segments").alias("s")).select("doc_id", "s.*")


QUERIES = {"p10_found": p10_found, "p10_documents": p10_documents, "p10_segments": p10_segments}
SQL: dict[str, str] = {}

"""Problem 4: mixed timestamp formats and time zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.operators.timestamps import with_normal_form
from acervo.session import table


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = table(spark, sf_dir, "temporal_mentions").select(
        F.lit("temporal_mentions").alias("record_table"), F.col("mention_id").alias("record_id"), F.col("raw_text").alias("text"), "local_zone"
    )
    metadata = table(spark, sf_dir, "contract_metadata").select(
        F.lit("contract_metadata").alias("record_table"), F.col("metadata_id").alias("record_id"), F.col("execution_date").alias("text"), "local_zone"
    )
    return mentions.unionByName(metadata)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each record whose text has a reading."""
    return with_normal_form(_readings(spark, sf_dir), "text", "local_zone").where("normal_form IS NOT NULL").select("record_table", "record_id", "normal_form")


QUERIES = {"p4_found": p4_found}
SQL: dict[str, str] = {}

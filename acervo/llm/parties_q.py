"""Problem 7: variant spellings of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.llm.parties import entities, entity_pairs
from acervo.session import table


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "parties").where("coalesce(is_law_firm, false) = false").select("party_id", "name", "raw_identifier")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_pairs(entities(_rows(spark, sf_dir)))


def p7_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each party row: its entity and how many other rows are linked to it."""
    found = entities(_rows(spark, sf_dir))
    sizes = found.groupBy("entity").agg((F.count(F.lit(1)) - 1).alias("links"))
    return found.join(sizes, "entity").select("party_id", "entity", "links")


QUERIES = {"p7_found": p7_found, "p7_entities": p7_entities}
SQL: dict[str, str] = {}

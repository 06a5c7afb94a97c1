"""Problem 1: most similar vectors for every vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.llm.vectors import most_similar
from acervo.session import table


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The up to ten most similar vectors of each, with a cosine of at least 0.90."""
    return most_similar(table(spark, sf_dir, "vectors"), "vec_id", "vector", "dimension", k=10, min_cosine=0.9)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = p1_neighbours(spark, sf_dir)
    return near.select(F.least("id", "neighbour_id").alias("vec_id_a"), F.greatest("id", "neighbour_id").alias("vec_id_b")).distinct()


QUERIES = {"p1_found": p1_found, "p1_neighbours": p1_neighbours}

_USABLE = """
WITH v AS (
  SELECT vec_id, dimension, vector::DOUBLE[] AS x, sqrt(list_sum(list_transform(vector::DOUBLE[], lambda e: e * e))) AS norm FROM vectors
  WHERE vector IS NOT NULL AND len(vector) = dimension
    AND len(list_filter(vector, lambda e: e IS NOT NULL AND isfinite(e))) = dimension AND len(list_filter(vector, lambda e: e <> 0)) > 0),
near AS (
  SELECT a.vec_id AS id, b.vec_id AS neighbour_id, list_dot_product(a.x, b.x) / (a.norm * b.norm) AS cosine,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.x, b.x) / (a.norm * b.norm), 12) DESC, b.vec_id) AS place
  FROM v a JOIN v b ON a.dimension = b.dimension AND a.vec_id <> b.vec_id
  QUALIFY place <= 10 AND cosine >= 0.9)
"""
SQL = {
    "p1_found": _USABLE + "SELECT DISTINCT least(id, neighbour_id) AS vec_id_a, greatest(id, neighbour_id) AS vec_id_b FROM near",
}

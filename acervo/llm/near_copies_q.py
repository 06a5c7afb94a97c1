"""Problem 3: near-duplicate records with small edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.llm.near_copies import copy_groups, expand_pairs, near_copies
from acervo.session import table


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "blocks").select(F.col("doc_id").alias("doc"), F.col("order_index").alias("part_no"), F.col("block_id").alias("part_id"), F.col("text_raw").alias("text"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand_pairs(*near_copies(_parts(spark, sf_dir), threshold=0.85))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each vault document: class of equal texts, connected group, number of links."""
    return copy_groups(*near_copies(_parts(spark, sf_dir), threshold=0.85))


QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups}
SQL = {
    "p3_found": r"""
WITH parts AS (SELECT DISTINCT ON (doc_id, order_index, block_id) doc_id, order_index, block_id, text_raw FROM blocks WHERE doc_id IS NOT NULL),
texts AS (SELECT doc_id, regexp_extract_all(lower(string_agg(text_raw, chr(10) ORDER BY order_index, block_id)), '[\p{L}\p{N}_]+') AS w FROM parts GROUP BY 1),
sets AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM texts WHERE len(w) >= 5),
grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT x AS doc_id_a, y AS doc_id_b FROM shared JOIN sets p ON p.doc_id = x JOIN sets q ON q.doc_id = y
WHERE n / (len(p.s) + len(q.s) - n)::DOUBLE >= 0.85"""
}

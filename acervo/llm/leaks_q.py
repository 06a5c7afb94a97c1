"""Problem 8: evaluation texts leaking into training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from acervo.llm.leaks import leaks
from acervo.session import table


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaking documents with the number of leaked word runs of each item."""
    return leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_passages"), "item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).select("doc_id", "item_id")


QUERIES = {"p8_found": p8_found, "p8_leaks": p8_leaks}

_RUNS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS w FROM eval_passages),
dr AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k+11], ' '))) AS r FROM d WHERE len(w) >= 12),
ir AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k+11], ' '))) AS r FROM i WHERE len(w) >= 12)
"""
SQL = {
    "p8_found": _RUNS + "SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (r)",
    "p8_leaks": _RUNS + "SELECT doc_id, item_id, count(*) AS runs FROM dr JOIN ir USING (r) GROUP BY ALL",
}

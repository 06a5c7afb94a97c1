"""Problem 5: splitting of oversized items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.llm.split import split_items
from acervo.session import table


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = table(spark, sf_dir, "encoder_profiles").select("profile_id", "max_input_tokens", "overlap_tokens")
    chunks = table(spark, sf_dir, "chunks").select(F.lit("chunks").alias("item_table"), F.col("chunk_id").alias("item_id"), F.col("verbatim_text").alias("text"), "profile_id")
    slices = table(spark, sf_dir, "candidate_slices").select(F.lit("candidate_slices").alias("item_table"), F.col("slice_id").alias("item_id"), "text", "profile_id")
    return chunks.unionByName(slices).join(profiles, "profile_id")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all items."""
    return split_items(_items(spark, sf_dir), ["item_table", "item_id"], "text", "max_input_tokens", "overlap_tokens")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that had to be cut."""
    return p5_pieces(spark, sf_dir).where("piece_no = 1").select("item_table", "item_id").distinct()


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces}
SQL = {
    "p5_found": r"""
WITH items AS (
  SELECT 'chunks' AS item_table, chunk_id AS item_id, verbatim_text AS text, profile_id FROM chunks
  UNION ALL SELECT 'candidate_slices', slice_id, text, profile_id FROM candidate_slices)
SELECT DISTINCT item_table, item_id FROM items JOIN encoder_profiles USING (profile_id)
WHERE len(list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda x: x <> '')) > max_input_tokens"""
}

"""Ordered blocks: context, grouping, runs, references and their binding, coverage of spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acervo.functions.text import fold
from acervo.operators.curation import latest
from acervo.operators.ordered import in_pieces, last_value, running_sum


def current_blocks(blocks: DataFrame) -> DataFrame:
    """One row for each block id: the one ingested last."""
    return latest(blocks, ["block_id"], [F.col("ingested_at").desc_nulls_last(), F.col("text_search").asc_nulls_last(), F.col("hierarchy_level")])


def _line(*extra: str) -> Window:
    return Window.partitionBy("doc_id").orderBy("order_index", "block_id", *extra)


def clause_context(blocks: DataFrame) -> DataFrame:
    """(block_id, clause_id, after_signature): the last clause above each block and whether a signature stood before it.

    A document of any number of blocks is spread over ranges of its order, which hand on their state.
    """
    order = ["order_index", "block_id"]
    pieces = in_pieces(blocks.select("doc_id", *order, F.lower("block_type").alias("kind")), ["doc_id"], order)
    clause = last_value(pieces, ["doc_id"], order, F.when(F.col("kind") == "clause", F.col("block_id")), "clause_id")
    signed = last_value(clause, ["doc_id"], order, F.when(F.col("kind") == "signature", 1), "after_signature", inclusive=False)
    return signed.select("block_id", "clause_id", F.coalesce("after_signature", F.lit(0)).alias("after_signature"))


def block_groups(blocks: DataFrame, is_start: Column) -> DataFrame:
    """(doc_id, group_no, first_block, blocks, characters): every start opens a group that lasts to the next one."""
    order = ["order_index", "block_id"]
    pieces = in_pieces(blocks.select("doc_id", *order, F.length("text_raw").alias("size"), F.when(is_start, 1).otherwise(0).alias("opens")), ["doc_id"], order)
    marked = running_sum(pieces, ["doc_id"], order, F.col("opens"), "group_no")
    return marked.groupBy("doc_id", "group_no").agg(F.min_by("block_id", F.struct("order_index", "block_id")).alias("first_block"), F.count(F.lit(1)).alias("blocks"), F.sum("size").alias("characters"))


def runs(blocks: DataFrame, value: Column) -> DataFrame:
    """(doc_id, value, run_no, blocks): stretches of neighbouring blocks of one value (gaps and islands)."""
    numbered = blocks.select("doc_id", "order_index", "block_id", value.alias("value"))
    numbered = numbered.withColumn("at", F.row_number().over(_line())).withColumn("own", F.row_number().over(Window.partitionBy("doc_id", "value").orderBy("order_index", "block_id")))
    islands = numbered.groupBy("doc_id", "value", (F.col("at") - F.col("own")).alias("island")).agg(F.count(F.lit(1)).alias("blocks"), F.min("at").alias("first"))
    return islands.withColumn("run_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("first"))).select("doc_id", "value", "run_no", "blocks")


def last_blocks(blocks: DataFrame, n: int) -> DataFrame:
    """(doc_id, block_id, place): the last n blocks of each document, the last one first."""
    back = Window.partitionBy("doc_id").orderBy(F.col("order_index").desc(), F.col("block_id").desc())
    return blocks.select("doc_id", "block_id", "order_index").withColumn("place", F.row_number().over(back)).where(F.col("place") <= n).select("doc_id", "block_id", "place")


def references(blocks: DataFrame) -> DataFrame:
    """(block_id, doc_id, label): clauses that a block names in its text, as clause:<number>."""
    found = F.regexp_extract_all(fold(F.col("text_raw")), F.lit(r"clausula (\d{1,3})[ªºa]?\b"), F.lit(1))
    return blocks.where("text_raw IS NOT NULL").select("block_id", "doc_id", F.explode(F.array_distinct(found)).alias("number")).select("block_id", "doc_id", F.concat(F.lit("clause:"), F.col("number")).alias("label"))


def bound_references(blocks: DataFrame) -> DataFrame:
    """(block_id, label, target_block, state): a reference binds to the one block of its document that bears the label, or stays pending."""
    labels = blocks.select("doc_id", "block_id", F.regexp_extract(fold(F.col("hierarchy_label")), r"clausula (\d{1,3})", 1).alias("number")).where("number <> ''")
    targets = labels.groupBy("doc_id", F.concat(F.lit("clause:"), F.col("number")).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.min("block_id").alias("target"))
    found = references(blocks).join(targets, ["doc_id", "label"], "left")
    unique = F.coalesce(F.col("n") == 1, F.lit(False))
    return found.select("block_id", "label", F.when(unique, F.col("target")).alias("target_block"), F.when(unique, "bound").when(F.col("n") > 1, "ambiguous").otherwise("missing").alias("state"))


def coverage(spans: DataFrame, item: str, start: str, end: str) -> DataFrame:
    """(item, start, end, fault): spans that leave a gap to, or overlap, what came before them within the item."""
    before = F.max(end).over(Window.partitionBy(item).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1))
    checked = spans.where(F.col(item).isNotNull() & F.col(start).isNotNull()).select(item, start, end).withColumn("before", before)
    return checked.withColumn("fault", F.when(F.col(start) > F.col("before"), "gap").when(F.col(start) < F.col("before"), "overlap")).where("fault IS NOT NULL").select(item, start, end, "fault")

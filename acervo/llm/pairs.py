"""Placing candidate pairs so that the payloads of their ends travel once a block, not once a pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.session import cut


def pair_blocks(pairs: DataFrame, block_pairs: int) -> tuple[DataFrame, DataFrame]:
    """((pair_block, a, b), (block, node)) of pairs a, b.

    A pair goes where the smallest partner of its larger end is, so that ends which are near each other meet in one
    block; the pairs of a crowded place are dealt over several blocks by their larger end.
    """
    pairs = cut(pairs.select("a", "b"))
    blocks = max(1, pairs.count() // block_pairs)
    home = pairs.groupBy("b").agg(F.min("a").alias("home"))
    placed = pairs.join(home, "b")
    crowd = placed.groupBy("home").agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / block_pairs)).alias("parts"))
    placed = placed.join(crowd, "home").withColumn("block", F.pmod(F.xxhash64("home", F.pmod(F.xxhash64("b"), F.col("parts"))), F.lit(blocks)))
    wanted = placed.select("block", F.explode(F.array("a", "b")).alias("node")).distinct()
    return placed.select(F.col("block").alias("pair_block"), F.col("a").alias("a"), F.col("b").alias("b")), wanted

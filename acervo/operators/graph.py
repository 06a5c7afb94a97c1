"""Graph operators as DataFrame rounds: connected components, closure along directed edges, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.session import cut


def _mark(edges: DataFrame) -> tuple:
    """Count and hash sum of a set of edges: equal for equal sets."""
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 200) -> DataFrame:
    """(node, component): the smallest node of each connected part, for the nodes of the edges.

    Alternates large-star and small-star steps, which both reduce edges by map-side minima and end after a number of
    rounds that is logarithmic in the size of a part. Each round is cut by a checkpoint; a graph that has not settled
    after `most_rounds` is an error, never a partial result. Null ends are left out.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    nodes = now.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    now = cut(now.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _mark(now)
    for _ in range(most_rounds if before[0] else 0):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = cut(small.select("e.u", "e.v").where("u <> v").distinct())
        after = _mark(now)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components not settled after {most_rounds} rounds")
    return nodes.join(now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("c")), "node", "left").select("node", F.coalesce("c", "node").alias("component"))


def ancestors(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(child, parent, depth): all that is reached along child -> parent edges, with the least number of steps.

    With `seeds` (child) only from these, over the connected parts that hold one. The length of the paths doubles each
    round: paths of exactly the length reached so far are continued by all known ones, so a chain of a thousand takes
    ten rounds; it ends when no path has that length, so cycles end too. Null ends are left out.
    """
    known = edges.select("child", "parent").where("child IS NOT NULL AND parent IS NOT NULL").distinct()
    if seeds is not None:
        wanted = cut(seeds.select("child").where("child IS NOT NULL").distinct())
        parts = cut(connected_components(known, "child", "parent"))
        touched = parts.join(wanted.withColumnRenamed("child", "node"), "node", "left_semi").select("component").distinct()
        known = known.join(parts.join(touched, "component", "left_semi").select(F.col("node").alias("child")), "child", "left_semi")
    known = cut(known.withColumn("depth", F.lit(1)))
    length, ends = 1, known
    while not ends.isEmpty():
        onward = ends.select("child", F.col("parent").alias("middle")).join(known.select(F.col("child").alias("middle"), "parent", "depth"), "middle")
        reached = onward.groupBy("child", "parent").agg((F.min("depth") + length).alias("depth"))
        new = cut(reached.join(known.select("child", "parent"), ["child", "parent"], "left_anti"))
        known = known.unionByName(new)
        length *= 2
        ends = new.where(F.col("depth") == length)
    return known if seeds is None else known.join(wanted, "child", "left_semi")


def on_cycles(edges: DataFrame) -> DataFrame:
    """(node): nodes that reach themselves along a -> b edges."""
    return ancestors(edges.select(F.col("a").alias("child"), F.col("b").alias("parent"))).where("child = parent").select(F.col("child").alias("node"))

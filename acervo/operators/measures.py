"""Measures: four definitions of percentiles, agreement, recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.operators.ordered import in_pieces, running_sum


def percentiles(df: DataFrame, group: str, value: str, q: float) -> DataFrame:
    """(group, n, rounded_index, ceiling_index, nearest_rank, upper_middle) of the sorted values v of each group.

    rounded_index: v[round(q (n - 1))], halves to even; ceiling_index: v[int(n q + 0.999999) - 1]; nearest_rank:
    v[ceil(q n) - 1]; upper_middle: v[n // 2], whatever q. Equal values are counted before the shuffle and a group is
    spread over ranges of its values, so that it may hold any share of the rows. Nulls are left out.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("times"))
    pieces = running_sum(in_pieces(counts, [group], [value]), [group], [value], F.col("times"), "upto")
    sizes = counts.groupBy(group).agg(F.sum("times").alias("n"))
    ranked = pieces.join(sizes.withColumnRenamed(group, "__group"), F.col(group).eqNullSafe(F.col("__group"))).drop("__group")
    n = F.col("n")
    at = {
        "rounded_index": F.bround(q * (n - 1), 0),
        "ceiling_index": F.greatest(F.lit(0), F.floor(n * q + 0.999999) - 1),
        "nearest_rank": F.greatest(F.lit(0), F.ceil(q * n) - 1),
        "upper_middle": F.floor(n / 2),
    }
    covers = lambda i: (i.cast("long") < F.col("upto")) & (i.cast("long") >= F.col("upto") - F.col("times"))
    return ranked.groupBy(group).agg(F.max("n").alias("n"), *[F.max(F.when(covers(i), F.col(value))).alias(name) for name, i in at.items()])


def agreement(a: Column, b: Column) -> Column:
    """Share of rows in which both values are known and equal, among those in which both are known; null if there are none."""
    known = a.isNotNull() & b.isNotNull()
    return F.round(F.avg(F.when(known, (a == b).cast("double"))), 4)


def micro_recall(wanted: DataFrame, found: DataFrame, split: str, member: str, by: str) -> DataFrame:
    """(split, by, recall): of the wanted members (split, member; a repeated row counts again), the share that each `by` of `found` (by, member) holds; 1 where nothing is wanted.

    Members meet by an equal join after they are counted, so no set is held in one row.
    """
    counts = wanted.where(F.col(member).isNotNull()).groupBy(split, member).agg(F.count(F.lit(1)).alias("times"))
    totals = wanted.groupBy(split).agg(F.count(member).alias("wanted"))
    hits = counts.join(found.select(by, member).distinct(), member).groupBy(split, by).agg(F.sum("times").alias("hits"))
    grid = totals.crossJoin(found.select(by).distinct())  # groups of both, no members
    share = F.coalesce(F.round(F.try_divide(F.coalesce("hits", F.lit(0)), F.col("wanted")), 6), F.lit(1.0))
    return grid.join(hits, [split, by], "left").select(split, by, share.alias("recall"))

"""Running values along an order without a task for each group: a group of any size is spread over ranges of its order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acervo.session import cut


def in_pieces(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with __piece, a number of their range; ranges follow the keys and the order, and each is one task's size. Cut, so that the ranges stay what they are."""
    return cut(df.repartitionByRange(*[F.col(c) for c in [*keys, *order]]).withColumn("__piece", F.spark_partition_id()))


def _before(pieces: DataFrame, keys: list[str], sums: dict[str, Column], over) -> DataFrame:
    """Of each key and piece, what the pieces before it hand on: rows are keys that a piece holds, so few."""
    line = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    held = pieces.groupBy(*keys, "__piece").agg(*[c.alias(n) for n, c in sums.items()])
    return held.select(*keys, "__piece", *[over(n, line).alias(n) for n in sums])


def running_sum(pieces: DataFrame, keys: list[str], order: list[str], amount: Column, name: str) -> DataFrame:
    """Rows of in_pieces with the sum of `amount` up to and including them within their keys. Null keys are a group."""
    marked = pieces.withColumn("__amount", amount)
    before = _before(marked, keys, {"__start": F.sum("__amount")}, lambda n, w: F.coalesce(F.sum(n).over(w), F.lit(0)))
    line = Window.partitionBy(*keys, "__piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = marked.withColumn("__own", F.sum("__amount").over(line))
    return _joined(local, before, [*keys, "__piece"]).withColumn(name, F.col("__own") + F.col("__start")).drop("__own", "__start", "__amount")


def last_value(pieces: DataFrame, keys: list[str], order: list[str], value: Column, name: str, inclusive: bool = True) -> DataFrame:
    """Rows of in_pieces with the last non-null `value` before them (or, inclusive, at them) within their keys."""
    marked = pieces.withColumn("__value", value)
    latest = F.max_by("__value", F.struct(F.col("__value").isNotNull().alias("is"), *order))
    before = _before(marked, keys, {"__start": latest}, lambda n, w: F.last(n, ignorenulls=True).over(w))
    line = Window.partitionBy(*keys, "__piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = marked.withColumn("__own", F.last("__value", ignorenulls=True).over(line))
    return _joined(local, before, [*keys, "__piece"]).withColumn(name, F.coalesce("__own", "__start")).drop("__own", "__start", "__value")


def _joined(rows: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """Null-safe join with the few rows that pieces hand on."""
    right = before.select(*[F.col(k).alias(f"__r_{k}") for k in keys], "__start")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return rows.join(right, same, "left").drop(*[f"__r_{k}" for k in keys])

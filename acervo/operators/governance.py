"""Append-only records: heads, links, folds, chains; integrity of keys and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acervo.operators.curation import latest


def heads(log: DataFrame, key: list[str], sequence: str) -> DataFrame:
    """The latest record of each key. Conditions belong after it: a newer record that fails them hides an older one that would not."""
    return latest(log, key, [F.col(sequence).desc_nulls_last()])


def supersedes(log: DataFrame, key: list[str], sequence: str, record: str, at: str) -> DataFrame:
    """(record, supersedes, in_order): the record before it under the same key, and whether time did not run backwards."""
    line = Window.partitionBy(*key).orderBy(sequence)
    return log.select(record, F.lag(record).over(line).alias("supersedes"), F.coalesce(F.lag(at).over(line) <= F.col(at), F.lit(True)).alias("in_order"))


def fold_policy(log: DataFrame, subject: str, epoch: str, sets: Column, clears: Column) -> DataFrame:
    """(subject, blocked, epoch): whether the last event that sets or clears a block did set it. Partial maxima go before the shuffle."""
    marked = log.where(F.col(subject).isNotNull()).select(subject, epoch, F.when(sets, True).when(clears, False).alias("state")).where("state IS NOT NULL")
    return marked.groupBy(subject).agg(F.max_by("state", epoch).alias("blocked"), F.max(epoch).alias("epoch"))


def chain_digest(previous: Column, *fields: Column) -> Column:
    """The digest that a chained record must bear."""
    return F.sha2(F.concat_ws("|", F.coalesce(previous.cast("string"), F.lit("")), *[f.cast("string") for f in fields]), 256)


def broken_links(log: DataFrame, key: str, epoch: str, previous: str, digest: str, *fields: str) -> DataFrame:
    """Records whose epoch does not follow, whose previous digest is not that of the record before, or whose own digest is wrong."""
    line = Window.partitionBy(key).orderBy(epoch)
    checked = log.withColumn("__before", F.lag(digest).over(line)).withColumn("__epoch", F.lag(epoch).over(line))
    follows = F.col(epoch) == F.coalesce(F.col("__epoch") + 1, F.lit(1))
    linked = F.col(previous).eqNullSafe(F.col("__before"))
    own = F.col(digest) == chain_digest(F.col(previous), *[F.col(f) for f in fields])
    return checked.where(~(follows & linked & own)).drop("__before", "__epoch")


def duplicate_keys(df: DataFrame, check: str, key: str) -> DataFrame:
    """(check, key, n): keys that occur more than once."""
    counted = df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return counted.select(F.lit(check).alias("check_name"), "key", "n")


def orphans(df: DataFrame, check: str, reference: str, parents: DataFrame, key: str) -> DataFrame:
    """(check, key, n): references to a key that does not exist, with the number of rows that make them. Null references are none."""
    missing = df.where(F.col(reference).isNotNull()).join(parents.select(F.col(key).alias(reference)), reference, "left_anti")
    return missing.groupBy(F.col(reference).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(check).alias("check_name"), "key", "n")


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has and the other has not, counted as often as they differ; none if the two are equal."""
    columns = left.columns
    a, b = left.exceptAll(right.select(*columns)), right.select(*columns).exceptAll(left)
    return a.withColumn("side", F.lit("left")).unionByName(b.withColumn("side", F.lit("right")))

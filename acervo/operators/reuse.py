"""What was decided or computed before: opinions by state, former input, caches with epochs, idempotent records, reused vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical_json(*columns: str) -> Column:
    """JSON of columns in the order of their names, nulls left out: equal states have equal texts."""
    return F.to_json(F.struct(*[F.col(f"`{c}`").alias(c) for c in sorted(columns)]))


def with_opinion(rows: DataFrame, state: list[str], cache: DataFrame, classify: Column, name: str = "opinion") -> tuple[DataFrame, DataFrame]:
    """(rows with state_key and opinion, what the cache lacked as (state_key, opinion)).

    `classify` is an expression over state_json, from a vectorised function or the JVM; it sees each state once that
    the cache (state_key, opinion) does not hold. A null opinion is an opinion that could not be had and is not kept.
    """
    keyed = rows.withColumn("state_json", canonical_json(*state)).withColumn("state_key", F.sha2("state_json", 256))
    held = cache.select("state_key", F.col("opinion").alias(name))
    fresh = keyed.select("state_key", "state_json").distinct().join(held, "state_key", "left_anti").select("state_key", classify.alias(name)).where(F.col(name).isNotNull())
    return keyed.drop("state_json").join(held.unionByName(fresh), "state_key", "left"), fresh.withColumnRenamed(name, "opinion")


def with_former_input(rows: DataFrame, former: DataFrame, key: str, version: str, value: str) -> DataFrame:
    """Rows with former_value and former_match: what was entered for this version, else the latest that was entered for any version of the key."""
    exact = former.groupBy(key, version).agg(F.max(value).alias("__exact"))
    loose = former.groupBy(key).agg(F.max_by(value, F.struct(F.coalesce(F.col(version), F.lit(-1)), value)).alias("__loose"))
    both = rows.join(exact, [key, version], "left").join(loose, key, "left")
    match = F.when(F.col("__exact").isNotNull(), "version").when(F.col("__loose").isNotNull(), "key")
    return both.withColumn("former_value", F.coalesce("__exact", "__loose")).withColumn("former_match", match).drop("__exact", "__loose")


def decided(subjects: DataFrame, log: DataFrame, key: list[str], identity: list[str], sequence: str, state: str) -> DataFrame:
    """Subjects with decision: the state of the head of their key where it is about exactly this identity, else blocked. A newer record about another identity hides an older one."""
    line = Window.partitionBy(*key).orderBy(F.col(sequence).desc_nulls_last())
    heads = log.withColumn("__place", F.row_number().over(line)).where("__place = 1").select(*key, *[F.col(c).alias(f"__{c}") for c in identity], F.col(state).alias("__state"))
    same = F.lit(True)
    for c in identity:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    joined = subjects.join(heads, key, "left").withColumn("decision", F.when(F.col("__state").isNotNull() & same, F.col("__state")).otherwise("blocked"))
    return joined.drop("__state", *[f"__{c}" for c in identity])


def cache_lookup(requests: DataFrame, entries: DataFrame, identity: list[str], at: str, ttl_seconds: int, epoch: Column) -> DataFrame:
    """Requests with outcome: hit, expired, stale (of an epoch before the one in force), or miss. `entries` has the identity, stored_at and epoch, one row each."""
    held = entries.select(*identity, F.col("stored_at").alias("__stored"), F.col("epoch").alias("__epoch"))
    age = F.unix_timestamp(F.col(at)) - F.unix_timestamp("__stored")
    outcome = F.when(F.col("__stored").isNull(), "miss").when(F.col("__epoch") < epoch, "stale").when((age < 0) | (age >= ttl_seconds), "expired").otherwise("hit")
    return requests.join(held, identity, "left").withColumn("outcome", outcome).drop("__stored", "__epoch")


def lru_kept(entries: DataFrame, group: str, used_at: str, size: str, most_bytes: int, tie: str) -> DataFrame:
    """Entries that stay when each group may hold most_bytes: from the last used on, up to the first that no longer fits."""
    line = Window.partitionBy(group).orderBy(F.col(used_at).desc(), tie).rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("__sum", F.sum(size).over(line)).where(F.col("__sum") <= most_bytes).drop("__sum")


def appended(ledger: DataFrame, records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, outcome) of records to append: new, repeated (the same again) or conflict (the key with other fields), for a ledger that takes a record once. Records that disagree among themselves are conflicts."""
    digest = F.sha2(canonical_json(*fields), 256)
    mine = records.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(digest).alias("low"), F.max(digest).alias("high"))
    there = ledger.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(digest).alias("held"))
    outcome = F.when(F.col("low") != F.col("high"), "conflict").when(F.col("held").isNull(), "new").when(F.col("held") == F.col("low"), "repeated").otherwise("conflict")
    return mine.join(there, key, "left").select(key, outcome.alias("outcome"))


def vector_plan(chunks: DataFrame, prior: DataFrame, key: str, text: str, identity: Column) -> DataFrame:
    """(key, action, digest, vector): reuse where the prior generation has a vector for the same key, text and encoder identity, else embed; prior keys that are gone are dropped.

    `prior` has the key, digest and vector. One row for each key; a null text needs no vector (skip).
    """
    digest = F.sha2(F.concat_ws("\x1f", identity, F.col(text)), 256)
    now = chunks.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.when(F.col(text).isNotNull(), digest)).alias("digest"))
    old = prior.select(key, F.col("digest").alias("__old"), "vector")
    both = now.withColumn("__now", F.lit(True)).join(old, key, "full_outer")
    same = F.col("digest") == F.col("__old")
    action = F.when(F.col("__now").isNull(), "drop").when(F.col("digest").isNull(), "skip").when(F.coalesce(same, F.lit(False)), "reuse").otherwise("embed")
    return both.select(key, action.alias("action"), "digest", F.when(action == "reuse", F.col("vector")).alias("vector"))


def mapped_by_place(rows: DataFrame, reviewed: DataFrame, place: list[str], value: str) -> DataFrame:
    """Rows with what a reviewer said of the same physical place (source, block, start, end ...), null where none did; several words on one place are none, as they disagree."""
    told = reviewed.groupBy(*place).agg(F.min(value).alias("__low"), F.max(value).alias("__high")).withColumn(value, F.when(F.col("__low") == F.col("__high"), F.col("__low"))).drop("__low", "__high")
    return rows.join(told, place, "left")

"""Curation: change capture, ordered rules, duplicates, families, samples and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acervo.functions.text import fold, squeeze


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; rows with a null key are left out. Groups are limited before the shuffle."""
    line = Window.partitionBy(*key).orderBy(*order)
    kept = df
    for k in key:
        kept = kept.where(F.col(k).isNotNull())
    return kept.withColumn("__place", F.row_number().over(line)).where("__place = 1").drop("__place")


def change_capture(previous: DataFrame, current: DataFrame, key: str, version: str) -> DataFrame:
    """(key, change): added, removed, changed or unchanged, by a full outer join and a null-safe comparison of versions."""
    p = previous.select(F.col(key), F.col(version).alias("old"), F.lit(True).alias("was"))
    c = current.select(F.col(key), F.col(version).alias("new"), F.lit(True).alias("is"))
    both = p.join(c, key, "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
    return both.select(key, change.alias("change"))


def normalised_title(title: Column) -> Column:
    """Folded, without a trailing extension, separators as blanks."""
    bare = F.regexp_replace(fold(title), r"\.[a-z0-9]{1,5}$", "")
    return squeeze(F.regexp_replace(bare, r"(?U)[\W_]+", " "))


def first_rule(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Name of the first rule whose pattern the text matches, as one chain of conditions; null if none does or the text is null."""
    chain = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        chain = F.when(text.rlike(pattern), F.lit(name)).otherwise(chain)
    return F.when(text.isNotNull(), chain)


def family_stem(title: Column) -> Column:
    """Normalised title without version marks, so that versions of one document share it."""
    marks = r"\b(?:v|vs|versao|rev|revisao|minuta|final|assinad[oa]|copia|limpa|draft) ?\d*\b|\b\d{1,2}$"
    return squeeze(F.regexp_replace(normalised_title(title), marks, " "))


def with_override(rows: DataFrame, overrides: DataFrame, key: str, version: str) -> DataFrame:
    """Rows with decision, decided_by: a reviewer's override wins, one made for another version asks for review.

    `rows` has key, version, decision; `overrides` has key, version, decision, at most one row a key.
    """
    o = overrides.select(F.col(key).alias("__key"), F.col(version).alias("__version"), F.col("decision").alias("__decision"))
    both = rows.join(o, F.col(key) == F.col("__key"), "left")
    stale = F.col("__key").isNotNull() & ~F.col("__version").eqNullSafe(F.col(version))
    return both.select(
        key,
        version,
        F.when(F.col("__key").isNull(), F.col("decision")).when(stale, "review").otherwise(F.col("__decision")).alias("decision"),
        F.when(F.col("__key").isNull(), "rule").when(stale, "stale_override").otherwise("override").alias("decided_by"),
    )


def index_plan(indexed: DataFrame, included: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, action): upsert, delete or unchanged, from what is indexed and what should be."""
    changes = change_capture(indexed, included, key, digest)
    return changes.select(key, F.when(F.col("change") == "removed", "delete").when(F.col("change") == "unchanged", "unchanged").otherwise("upsert").alias("action"))


def stratified(df: DataFrame, strata: list[str], key: str, per_stratum: int, seed: str) -> DataFrame:
    """At most per_stratum rows of each stratum, in an order that only the key and the seed decide."""
    line = Window.partitionBy(*strata).orderBy(F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed)), 256), key)
    return df.withColumn("place", F.row_number().over(line)).where(F.col("place") <= per_stratum)


def round_robin(df: DataFrame, stratum: str, key: str, total: int, seed: str) -> DataFrame:
    """(key, stratum, place, turn): `total` rows taken from the strata in turn. Each stratum is limited before the turns are mixed."""
    ranked = stratified(df.select(key, stratum), [stratum], key, total, seed)
    return ranked.withColumn("turn", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("place", F.col(stratum).asc_nulls_first(), key))).where(F.col("turn") <= total)


def twins(items: DataFrame, threshold: float) -> DataFrame:
    """(id_a, id_b, n_a, n_b, similarity): pairs of one scope whose sets of sequences have a Jaccard similarity of at least the threshold, exactly.

    items: id, scope, n, grams (distinct). Two such sets share one of the first size - ceil(threshold size) + 1 of
    their sequences in any common order, here that of a hash; only these keys meet, equal sets as one, and whole sets
    are fetched for what met. Items without a sequence have no twin; null scopes are left out.
    """
    keyed = items.where("scope IS NOT NULL AND size(grams) > 0").withColumn("hashes", F.array_sort(F.transform("grams", lambda g: F.xxhash64(g)))).drop("grams").withColumn("set", F.xxhash64("scope", "hashes"))
    sets = keyed.groupBy("set").agg(F.first("scope").alias("scope"), F.first("hashes").alias("hashes"))
    size = F.size("hashes")
    prefix = F.slice("hashes", 1, (size - F.ceil(threshold * size) + 1).cast("int"))
    posts = sets.select("set", "scope", size.alias("size"), F.explode(prefix).alias("key"))
    a, b = (posts.select("scope", "key", F.col("set").alias(f"set_{s}"), F.col("size").alias(f"size_{s}")) for s in "ab")
    near = F.least("size_a", "size_b") >= threshold * F.greatest("size_a", "size_b")
    met = a.join(b, ["scope", "key"]).where((F.col("set_a") < F.col("set_b")) & near).select("set_a", "set_b").distinct()
    for s in "ab":
        met = met.join(sets.select(F.col("set").alias(f"set_{s}"), F.col("hashes").alias(f"hashes_{s}")), f"set_{s}")
    shared = F.size(F.array_intersect("hashes_a", "hashes_b"))
    similarity = F.round(shared / (F.size("hashes_a") + F.size("hashes_b") - shared), 6)
    linked = met.select("set_a", "set_b", similarity.alias("similarity")).where(F.col("similarity") >= threshold)
    linked = linked.unionByName(linked.select(F.col("set_b").alias("set_a"), F.col("set_a").alias("set_b"), "similarity")).unionByName(sets.select(F.col("set").alias("set_a"), F.col("set").alias("set_b"), F.lit(1.0).alias("similarity")))
    left, right = (keyed.select(F.col("id").alias(f"id_{s}"), F.col("n").alias(f"n_{s}"), F.col("set").alias(f"set_{s}")) for s in "ab")
    return linked.join(left, "set_a").join(right, "set_b").where("id_a < id_b").select("id_a", "id_b", "n_a", "n_b", "similarity")

"""Governed closure: what a selection needs before it can be shown, over structure and reviewed relations between instruments.

The fixpoint of "a unit needs what it depends on, and a relation that touches the proof brings its affected and
supporting units" is reachability in one graph, whose nodes are units and relations. It is computed by doubling paths
(`ancestors`), for all questions at once; nothing is cut off, and what is wrong blocks the whole answer of a question.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.operators.graph import ancestors, connected_components, on_cycles
from acervo.session import cut


@dataclass(frozen=True)
class Registry:
    """units: unit_id, instrument_id, tokens; depends: child, parent (unit ids); relations: relation_id, from_instrument, to_instrument, state, affected, support (arrays of unit ids); resolutions: family_id, instrument_id (its anchor), state, relation_ids."""

    units: DataFrame
    depends: DataFrame
    relations: DataFrame
    resolutions: DataFrame


def relation_ends(relations: DataFrame) -> DataFrame:
    """(relation_id, state, side, instrument_id, unit_id): each unit that a relation names, with the instrument it must belong to."""
    sides = F.array(
        F.struct(F.lit("affected").alias("side"), F.col("to_instrument").alias("instrument_id"), F.col("affected").alias("ids")),
        F.struct(F.lit("support").alias("side"), F.col("from_instrument").alias("instrument_id"), F.col("support").alias("ids")),
    )
    lines = relations.select("relation_id", "state", F.explode(sides).alias("s")).select("relation_id", "state", "s.*")
    return lines.select("relation_id", "state", "side", "instrument_id", F.explode_outer("ids").alias("unit_id"))


def relation_faults(relations: DataFrame, units: DataFrame) -> DataFrame:
    """(relation_id, side, unit_id): affected units that are not of the target, support that is not of the source, and empty sides (null unit)."""
    return relation_ends(relations).join(units.select("unit_id", "instrument_id"), ["unit_id", "instrument_id"], "left_anti").select("relation_id", "side", "unit_id").distinct()


def families(relations: DataFrame) -> DataFrame:
    """(instrument_id, family): instruments that relations connect, in any direction, named by the smallest."""
    return connected_components(relations, "from_instrument", "to_instrument").select(F.col("node").alias("instrument_id"), F.col("component").alias("family"))


def blocked_by_family(relations: DataFrame, blocked: DataFrame) -> DataFrame:
    """(instrument_id): blocked instruments and all that are connected with one of them."""
    own = families(relations)
    hit = own.join(blocked.select("instrument_id"), "instrument_id", "left_semi").select("family").distinct()
    return own.join(hit, "family", "left_semi").select("instrument_id").unionByName(blocked.select("instrument_id")).where("instrument_id IS NOT NULL").distinct()


def family_review(relations: DataFrame, resolutions: DataFrame) -> DataFrame:
    """(family, fault): families without exactly one resolved resolution, or whose resolution does not name exactly their relations; fault is null for a sound one."""
    own = families(relations)
    held = relations.join(own.withColumnRenamed("instrument_id", "from_instrument"), "from_instrument").groupBy("family").agg(F.array_sort(F.collect_set("relation_id")).alias("held"))
    told = resolutions.join(own, "instrument_id").groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == "resolved").alias("resolved"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("relation_ids")))).alias("told"))
    checked = held.join(told, "family", "left")
    fault = F.when((F.coalesce("n", F.lit(0)) != 1) | (F.col("resolved") != 1), "family_unresolved").when(F.col("held") != F.col("told"), "family_relation_mismatch")
    return checked.select("family", fault.alias("fault"))


def inverse_relations(relations: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(query_id, relation_id, unit_id): of approved relations that change a retrieved unit, the affected and the supporting units, to stand beside it. `retrieved` has query_id, unit_id."""
    approved = relations.where("state = 'approved'")
    touched = approved.select("relation_id", F.explode("affected").alias("unit_id")).join(retrieved.select("query_id", "unit_id"), "unit_id").select("query_id", "relation_id").distinct()
    ends = approved.select("relation_id", F.explode(F.array_distinct(F.concat("affected", "support"))).alias("unit_id"))
    return touched.join(ends, "relation_id").select("query_id", "relation_id", "unit_id")


def resolve(registry: Registry, selected: DataFrame, scope: str = "linked_instruments", reference_date: str | None = None, token_budget: int = 6000) -> tuple[DataFrame, DataFrame]:
    """((query_id, status, reason, tokens, warnings), (query_id, unit_id, role)) of selections (query_id, unit_id).

    With linked instruments, whatever is open in a touched family blocks: reasons in the order closure_cycle,
    closure_unit_missing, temporal_effect_unresolved, the family's fault, relation_support_missing, relation_cycle,
    closure_over_budget. With the original text these only warn (warnings, sorted), and relations whose units cannot be
    shown stay out. Rejected relations never count. A blocked question has no proof.
    """
    linked = scope == "linked_instruments"
    live = registry.relations.where("state <> 'rejected'")
    faulty = cut(relation_faults(live, registry.units).select("relation_id").distinct())
    usable = live.where("state = 'approved'").join(faulty, "relation_id", "left_anti")
    touching = relation_ends(usable).where("unit_id IS NOT NULL").select(F.concat(F.lit("relation:"), "relation_id").alias("r"), "unit_id")
    both = touching.select(F.explode(F.array(F.struct(F.col("unit_id").alias("child"), F.col("r").alias("parent")), F.struct(F.col("r").alias("child"), F.col("unit_id").alias("parent")))).alias("e")).select("e.*")
    picked = cut(selected.select("query_id", "unit_id").where("query_id IS NOT NULL AND unit_id IS NOT NULL").distinct())
    reached = ancestors(registry.depends.select("child", "parent").unionByName(both), picked.select(F.col("unit_id").alias("child")))
    needed = picked.join(reached.select(F.col("child").alias("unit_id"), "parent"), "unit_id").where("NOT parent LIKE 'relation:%'").select("query_id", F.col("parent").alias("unit_id"))
    proof = picked.withColumn("role", F.lit("selected")).unionByName(needed.distinct().join(picked, ["query_id", "unit_id"], "left_anti").withColumn("role", F.lit("closure")))
    proof = cut(proof.join(registry.units.select("unit_id", "instrument_id", "tokens"), "unit_id", "left"))

    # Cycles are looked for within the proofs only, not in the whole structure.
    inside = registry.depends.select(F.col("child").alias("a"), F.col("parent").alias("b")).join(proof.select(F.col("unit_id").alias("a")).distinct(), "a", "left_semi")
    rings = on_cycles(inside).select(F.col("node").alias("unit_id"), F.lit(True).alias("ring"))
    sums = proof.join(rings, "unit_id", "left").groupBy("query_id").agg(F.sum("tokens").alias("tokens"), F.count_if(F.col("instrument_id").isNull()).alias("missing"), F.count_if("ring").alias("rings"))

    own = cut(families(registry.relations))
    met = cut(proof.join(own, "instrument_id").select("query_id", "family").distinct())
    member = own.join(met.select("family").distinct(), "family", "left_semi").select(F.col("instrument_id").alias("from_instrument"), "family")
    turns = on_cycles(live.where("state = 'approved'").join(member, "from_instrument", "left_semi").select(F.col("from_instrument").alias("a"), F.col("to_instrument").alias("b"))).select(F.col("node").alias("from_instrument"))
    bad_support = live.where("state = 'approved'").join(faulty, "relation_id", "left_semi").join(member, "from_instrument").select("family", F.lit(True).alias("unsupported")).distinct()
    circular = turns.join(member, "from_instrument").select("family", F.lit(True).alias("circular")).distinct()
    state = family_review(registry.relations, registry.resolutions).join(bad_support, "family", "left").join(circular, "family", "left")
    of_query = met.join(state, "family", "left").groupBy("query_id").agg(F.min("fault").alias("fault"), F.max("unsupported").alias("unsupported"), F.max("circular").alias("circular"))

    near = live.join(member, "from_instrument").select("family", "relation_id", "state").join(faulty.withColumn("faulty", F.lit(True)), "relation_id", "left")
    kind = F.when(F.col("state") != "approved", "relation_unresolved:").when(F.col("faulty"), "modifier_proof_unavailable:").otherwise("known_modifier:")
    told = met.join(near.select("family", F.concat(kind, F.col("relation_id")).alias("w")), "family").select("query_id", "w")
    open_families = met.join(state.where("fault = 'family_unresolved'").select("family"), "family").select("query_id", F.concat(F.lit("family_unresolved:"), F.col("family")).alias("w"))
    warned = told.unionByName(open_families).groupBy("query_id").agg(F.array_sort(F.collect_set("w")).alias("warned"))

    out = sums.join(of_query, "query_id", "left").join(warned, "query_id", "left")
    reason = F.when(F.col("rings") > 0, "closure_cycle").when(F.col("missing") > 0, "closure_unit_missing")
    if linked:
        reason = reason.when(F.lit(reference_date is not None), "temporal_effect_unresolved").when(F.col("fault").isNotNull(), F.col("fault"))
        reason = reason.when(F.col("unsupported"), "relation_support_missing").when(F.col("circular"), "relation_cycle")
    reason = reason.when(F.col("tokens") > token_budget, "closure_over_budget")
    none = F.array().cast("array<string>")
    warnings = none if linked else F.concat(F.array(F.lit("historical_text_not_effect")), F.coalesce("warned", none))
    outcome = cut(out.select("query_id", F.when(reason.isNull(), "complete").otherwise("blocked").alias("status"), reason.alias("reason"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), warnings.alias("warnings")))
    kept = proof.join(outcome.where("status = 'complete'").select("query_id"), "query_id", "left_semi")
    return outcome, kept.select("query_id", "unit_id", "role")

"""Governed closure over chunk units and relations between instruments of common parties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.operators.closure import Registry, blocked_by_family, family_review, inverse_relations, relation_faults, resolve
from acervo.session import table


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of chunks; their tokens are their characters in fours."""
    c = table(spark, sf_dir, "chunks").where("unit_id IS NOT NULL AND instrument_id IS NOT NULL")
    return c.groupBy("unit_id").agg(F.min("instrument_id").alias("instrument_id"), F.max(F.ceil(F.coalesce("unit_end", F.lit(0)) / 4)).cast("long").alias("tokens"))


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruments that change others, by common party identifiers: the change's first unit supports, the base's first unit is affected."""
    kinds = table(spark, sf_dir, "contract_metadata").groupBy("doc_id").agg(F.min("instrument_type").alias("kind"))
    ids = table(spark, sf_dir, "parties").where("NOT is_law_firm AND length(clean_identifier) IN (11, 14) AND NOT clean_identifier RLIKE '^(.)\\\\1+$'").select("doc_id", "clean_identifier").distinct()
    known = ids.join(kinds, "doc_id")
    changing = known.where("kind IN ('Termo Aditivo', 'Distrato')").select(F.col("doc_id").alias("f"), "clean_identifier")
    others = known.where("kind NOT IN ('Termo Aditivo', 'Distrato')").select(F.col("doc_id").alias("t"), "clean_identifier")
    pairs = changing.join(others, "clean_identifier").select("f", "t").distinct()
    first = _units(spark, sf_dir).groupBy("instrument_id").agg(F.min("unit_id").alias("unit"))
    ends = pairs.select("f", "t", F.concat(F.lit("doc:"), "f").alias("from_instrument"), F.concat(F.lit("doc:"), "t").alias("to_instrument"))
    ends = ends.join(first.select(F.col("instrument_id").alias("from_instrument"), F.col("unit").alias("s")), "from_instrument").join(first.select(F.col("instrument_id").alias("to_instrument"), F.col("unit").alias("a")), "to_instrument")
    state = F.when(F.col("f") % 5 == 0, "rejected").when(F.col("f") % 5 == 1, "proposed").otherwise("approved")
    support = F.when(F.col("f") % 7 == 0, F.array(F.lit("unit:missing"))).otherwise(F.array("s"))
    return ends.select(F.concat_ws(">", "from_instrument", "to_instrument").alias("relation_id"), "from_instrument", "to_instrument", state.alias("state"), F.array("a").alias("affected"), support.alias("support"))


def _registry(spark: SparkSession, sf_dir: str) -> Registry:
    """A unit depends on the unit of its instrument before it in the order of names; each change that is not the only one of its family leaves the family open."""
    from pyspark.sql import Window

    units, relations = _units(spark, sf_dir), _relations(spark, sf_dir)
    line = Window.partitionBy("instrument_id").orderBy("unit_id")
    depends = units.select(F.col("unit_id").alias("child"), F.lag("unit_id").over(line).alias("parent")).where("parent IS NOT NULL")
    told = relations.groupBy("from_instrument").agg(F.array_sort(F.collect_set("relation_id")).alias("relation_ids"))
    number = F.split("from_instrument", ":")[1].cast("long")
    resolutions = told.select(F.concat(F.lit("family:"), "from_instrument").alias("family_id"), F.col("from_instrument").alias("instrument_id"), F.when(number % 3 == 0, "open").otherwise("resolved").alias("state"), "relation_ids")
    return Registry(units, depends, relations, resolutions)


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each vector with an id divisible by 50: the unit of its chunk."""
    v = table(spark, sf_dir, "vectors").where("vec_id % 50 = 0 AND chunk_id IS NOT NULL").select(F.col("vec_id").alias("query_id"), "chunk_id")
    return v.join(table(spark, sf_dir, "chunks").where("unit_id IS NOT NULL AND instrument_id IS NOT NULL").select("chunk_id", "unit_id").distinct(), "chunk_id").select("query_id", "unit_id").distinct()


def relation_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation_faults(_relations(spark, sf_dir), _units(spark, sf_dir))


def family_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _registry(spark, sf_dir)
    return family_review(r.relations, r.resolutions)


def inverse_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _registry(spark, sf_dir)
    return inverse_relations(r.relations, _selected(spark, sf_dir))


def blocked_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excluded records and all instruments connected with them."""
    out = table(spark, sf_dir, "curation").where("decision = 'exclude' AND mfiles_id % 4 = 0").select(F.concat(F.lit("doc:"), "mfiles_id").alias("instrument_id")).distinct()
    return blocked_by_family(_relations(spark, sf_dir), out)


def governed_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome, _ = resolve(_registry(spark, sf_dir), _selected(spark, sf_dir))
    return outcome.select("query_id", "status", "reason", "tokens")


def closure_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve(_registry(spark, sf_dir), _selected(spark, sf_dir))[1]


def original_text_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome, _ = resolve(_registry(spark, sf_dir), _selected(spark, sf_dir), scope="original_text")
    return outcome.select("query_id", "status", "reason", F.array_join("warnings", ",").alias("warnings"))


QUERIES = {f.__name__: f for f in (relation_support, family_reviews, inverse_lookup, blocked_families, governed_closure, closure_proof, original_text_closure)}

_BASE = """WITH RECURSIVE units AS (SELECT unit_id, min(instrument_id) AS instrument_id, max(ceil(coalesce(unit_end, 0) / 4))::BIGINT AS tokens FROM chunks WHERE unit_id IS NOT NULL AND instrument_id IS NOT NULL GROUP BY 1),
kinds AS (SELECT doc_id, min(instrument_type) AS kind FROM contract_metadata GROUP BY 1),
known AS (SELECT DISTINCT doc_id, clean_identifier, kind FROM parties JOIN kinds USING (doc_id) WHERE NOT is_law_firm AND length(clean_identifier) IN (11, 14) AND replace(clean_identifier, left(clean_identifier, 1), '') <> ''),
pairs AS (SELECT DISTINCT a.doc_id AS f, b.doc_id AS t FROM known a JOIN known b USING (clean_identifier) WHERE a.kind IN ('Termo Aditivo', 'Distrato') AND b.kind NOT IN ('Termo Aditivo', 'Distrato')),
firsts AS (SELECT instrument_id, min(unit_id) AS unit FROM units GROUP BY 1),
relations AS (SELECT 'doc:' || f || '>doc:' || t AS relation_id, 'doc:' || f AS from_instrument, 'doc:' || t AS to_instrument, CASE WHEN f % 5 = 0 THEN 'rejected' WHEN f % 5 = 1 THEN 'proposed' ELSE 'approved' END AS state,
  a.unit AS affected, CASE WHEN f % 7 = 0 THEN 'unit:missing' ELSE s.unit END AS support FROM pairs JOIN firsts s ON s.instrument_id = 'doc:' || f JOIN firsts a ON a.instrument_id = 'doc:' || t),
depends AS (SELECT unit_id AS child, lag(unit_id) OVER (PARTITION BY instrument_id ORDER BY unit_id) AS parent FROM units),
selected AS (SELECT DISTINCT vec_id AS query_id, unit_id FROM vectors JOIN chunks USING (chunk_id) WHERE vec_id % 50 = 0 AND unit_id IS NOT NULL AND chunks.instrument_id IS NOT NULL),
faults AS (SELECT relation_id, 'affected' AS side, affected AS unit_id FROM relations r WHERE NOT EXISTS (SELECT 1 FROM units u WHERE u.unit_id = affected AND u.instrument_id = to_instrument)
  UNION SELECT relation_id, 'support', support FROM relations r WHERE NOT EXISTS (SELECT 1 FROM units u WHERE u.unit_id = support AND u.instrument_id = from_instrument)),
pairs_of AS (SELECT from_instrument AS a, to_instrument AS b FROM relations UNION SELECT to_instrument, from_instrument FROM relations),
walk AS (SELECT a AS node, a AS seen FROM pairs_of UNION SELECT walk.node, pairs_of.b FROM walk JOIN pairs_of ON walk.seen = pairs_of.a),
families AS (SELECT node AS instrument_id, min(seen) AS family FROM walk GROUP BY 1),
resolutions AS (SELECT from_instrument AS instrument_id, CASE WHEN split_part(from_instrument, ':', 2)::BIGINT % 3 = 0 THEN 'open' ELSE 'resolved' END AS state, relation_id FROM relations),
counted AS (SELECT family, count(DISTINCT instrument_id) AS n, count(DISTINCT instrument_id) FILTER (state = 'resolved') AS resolved FROM resolutions JOIN families USING (instrument_id) GROUP BY 1),
reviews AS (SELECT DISTINCT f.family, CASE WHEN coalesce(n, 0) <> 1 OR resolved <> 1 THEN 'family_unresolved' END AS fault FROM relations r JOIN families f ON f.instrument_id = from_instrument LEFT JOIN counted USING (family)),
live AS (SELECT * FROM relations WHERE state = 'approved' AND relation_id NOT IN (SELECT relation_id FROM faults)),
edges AS (SELECT child, parent FROM depends WHERE parent IS NOT NULL UNION SELECT affected, support FROM live UNION SELECT support, affected FROM live UNION SELECT affected, affected FROM live UNION SELECT support, support FROM live),
reach AS (SELECT query_id, unit_id FROM selected UNION SELECT query_id, parent FROM reach JOIN edges ON child = unit_id),
proof AS (SELECT query_id, unit_id, CASE WHEN s.unit_id IS NULL THEN 'closure' ELSE 'selected' END AS role, instrument_id, tokens FROM reach LEFT JOIN selected s USING (query_id, unit_id) LEFT JOIN units USING (unit_id)),
met AS (SELECT DISTINCT query_id, family FROM proof JOIN families USING (instrument_id)),
unsupported AS (SELECT DISTINCT family FROM relations r JOIN faults USING (relation_id) JOIN families f ON f.instrument_id = r.from_instrument WHERE r.state = 'approved'),
of_query AS (SELECT query_id, min(fault) AS fault, bool_or(u.family IS NOT NULL) AS bad FROM met LEFT JOIN reviews USING (family) LEFT JOIN unsupported u USING (family) GROUP BY 1),
outcome AS (SELECT query_id, sum(tokens)::BIGINT AS tokens, CASE WHEN any_value(fault) IS NOT NULL THEN any_value(fault) WHEN any_value(bad) THEN 'relation_support_missing' WHEN sum(tokens) > 6000 THEN 'closure_over_budget' END AS reason,
  CASE WHEN sum(tokens) > 6000 THEN 'closure_over_budget' END AS plain_reason FROM proof LEFT JOIN of_query USING (query_id) GROUP BY 1),
near AS (SELECT family, relation_id, CASE WHEN state <> 'approved' THEN 'relation_unresolved:' WHEN relation_id IN (SELECT relation_id FROM faults) THEN 'modifier_proof_unavailable:' ELSE 'known_modifier:' END || relation_id AS w FROM relations JOIN families ON instrument_id = from_instrument WHERE state <> 'rejected'
  UNION SELECT family, NULL, 'family_unresolved:' || family FROM reviews WHERE fault = 'family_unresolved'),
warned AS (SELECT query_id, list_sort(list(DISTINCT w)) AS ws FROM met JOIN near USING (family) GROUP BY 1)
"""
SQL = {
    "relation_support": _BASE + "SELECT * FROM faults",
    "family_reviews": _BASE + "SELECT * FROM reviews",
    "inverse_lookup": _BASE + "SELECT DISTINCT query_id, relation_id, unnest([affected, support]) AS unit_id FROM relations JOIN selected ON unit_id = affected WHERE state = 'approved'",
    "blocked_families": _BASE
    + """, out AS (SELECT DISTINCT 'doc:' || mfiles_id AS instrument_id FROM curation WHERE decision = 'exclude' AND mfiles_id % 4 = 0)
SELECT instrument_id FROM out UNION SELECT instrument_id FROM families WHERE family IN (SELECT family FROM families JOIN out USING (instrument_id))""",
    "governed_closure": _BASE + "SELECT query_id, CASE WHEN reason IS NULL THEN 'complete' ELSE 'blocked' END AS status, reason, tokens FROM outcome",
    "closure_proof": _BASE + "SELECT query_id, unit_id, role FROM proof JOIN outcome USING (query_id) WHERE reason IS NULL",
    "original_text_closure": _BASE
    + """SELECT query_id, CASE WHEN plain_reason IS NULL THEN 'complete' ELSE 'blocked' END AS status, plain_reason AS reason, array_to_string(list_concat(['historical_text_not_effect'], coalesce(ws, [])), ',') AS warnings FROM outcome LEFT JOIN warned USING (query_id)""",
}

"""Ledgers, policies, chains, graphs and integrity, over events, orders and the vault's keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acervo.operators.governance import broken_links, chain_digest, duplicate_keys, fold_policy, heads, orphans, parity, supersedes
from acervo.operators.graph import connected_components, on_cycles
from acervo.session import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


def ledger_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads(_events(spark, sf_dir), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


def ledger_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads that are valid; a newer invalid record hides an older valid one."""
    return ledger_heads(spark, sf_dir).where("value >= 50")


def ledger_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supersedes(_events(spark, sf_dir), ["user_id", "event_type"], "event_id", "event_id", "ts")


def policy_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.col("event_type")
    return fold_policy(_events(spark, sf_dir), "user_id", "event_id", kinds == "purchase", kinds == "click")


def chain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain over each user's events with the records of negative or huge values forged; the links found broken."""
    line = Window.partitionBy("user_id").orderBy("event_id")
    e = _events(spark, sf_dir).where("user_id IS NOT NULL").withColumn("epoch", F.row_number().over(line)).withColumn("claimed", F.lag("event_id").over(line))
    e = e.withColumn("digest", chain_digest(F.col("claimed"), F.col("epoch"), F.col("event_id"))).withColumn("previous", F.lag("digest").over(line))
    forged = e.withColumn("digest", F.when(F.col("value") > 99, F.lit("forged")).otherwise(chain_digest(F.col("previous"), F.col("epoch"), F.col("event_id"))))
    # A record whose digest was made over another previous digest is broken, and so is the one after it.
    return broken_links(forged, "user_id", "epoch", "previous", "digest", "epoch", "event_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("broken"))


def order_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders linked to the order before of the same customer: connected parts."""
    line = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    edges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), F.lag("o_orderkey").over(line).alias("b"))
    return connected_components(edges, "a", "b").groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))


def party_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents connected by shared party identifiers, fillers left out: size of each part."""
    p = table(spark, sf_dir, "parties").where("doc_id IS NOT NULL AND NOT is_law_firm AND length(clean_identifier) IN (11, 14)")
    p = p.where(F.translate("clean_identifier", "0", "") != "").where(F.translate("clean_identifier", "1", "") != "")
    edges = p.select(F.concat(F.lit("d"), F.col("doc_id")).alias("a"), F.col("clean_identifier").alias("b"))
    parts = connected_components(edges, "a", "b").where("node LIKE 'd%'").groupBy("component").agg(F.count(F.lit(1)).alias("documents"))
    return parts.groupBy("documents").agg(F.count(F.lit(1)).alias("parts"))


def cycle_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types that lead back to themselves, along pairs of types that follow one another at more than 200 places."""
    line = Window.partitionBy("user_id").orderBy("event_id")
    pairs = _events(spark, sf_dir).select(F.col("event_type").alias("a"), F.lead("event_type").over(line).alias("b")).where("b IS NOT NULL AND a < b")
    back = _events(spark, sf_dir).select(F.max("event_type").alias("a"), F.min("event_type").alias("b"))
    return on_cycles(pairs.groupBy("a", "b").count().where("count > 200").select("a", "b").unionByName(back))


def integrity_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    faults = [
        duplicate_keys(t("chunks"), "chunks.chunk_id twice", "chunk_id"),
        duplicate_keys(t("blocks"), "blocks.block_id twice", "block_id"),
        orphans(t("candidate_slices"), "slice without chunk", "chunk_id", t("chunks"), "chunk_id"),
        orphans(t("vectors"), "vector without chunk", "chunk_id", t("chunks"), "chunk_id"),
        orphans(t("parties"), "party without record", "doc_id", t("curation"), "mfiles_id"),
        orphans(t("temporal_mentions"), "mention without block", "block_id", t("blocks"), "block_id"),
        orphans(t("lineitem"), "line without order", "l_orderkey", t("orders"), "o_orderkey"),
    ]
    out = faults[0]
    for f in faults[1:]:
        out = out.unionByName(f)
    return out


def projection_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks against the chunk ids that vectors know, both without repetition."""
    a = table(spark, sf_dir, "chunks").select("chunk_id").distinct()
    b = table(spark, sf_dir, "vectors").where("chunk_id IS NOT NULL").select("chunk_id").distinct()
    return parity(a, b).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


def family_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of test items that stand in more than one split, and texts that occur twice."""
    e = table(spark, sf_dir, "eval_passages")
    families = e.groupBy("family_id").agg(F.count_distinct("split").alias("n")).where("n > 1").select(F.lit("family").alias("fault"), F.col("family_id").alias("key"))
    twice = e.groupBy("text").agg(F.min("item_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("text").alias("fault"), F.col("first").cast("string").alias("key"))
    return families.unionByName(twice)


QUERIES = {f.__name__: f for f in (ledger_heads, ledger_current, ledger_links, policy_fold, chain_check, order_components, party_components, cycle_nodes, integrity_faults, projection_parity, family_leakage)}

_HEADS = "SELECT user_id, event_type, event_id, value FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1"


def _dup(table_name: str, key: str) -> str:
    return f"SELECT '{table_name}.{key} twice' AS check_name, {key} AS key, count(*) AS n FROM {table_name} GROUP BY {key} HAVING count(*) > 1"


def _orphan(name: str, t: str, ref: str, parent: str, key: str) -> str:
    return f"SELECT '{name}' AS check_name, {ref}::VARCHAR AS key, count(*) AS n FROM {t} WHERE {ref} IS NOT NULL AND {ref} NOT IN (SELECT {key} FROM {parent} WHERE {key} IS NOT NULL) GROUP BY {ref}"


SQL = {
    "ledger_heads": _HEADS,
    "ledger_current": f"SELECT * FROM ({_HEADS}) WHERE value >= 50",
    "ledger_links": "SELECT event_id, lag(event_id) OVER w AS supersedes, coalesce(lag(ts) OVER w <= ts, true) AS in_order FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)",
    "policy_fold": "SELECT user_id, arg_max(event_type = 'purchase', event_id) AS blocked, max(event_id) AS epoch FROM events WHERE user_id IS NOT NULL AND event_type IN ('purchase', 'click') GROUP BY 1",
    "chain_check": """WITH e AS (SELECT *, row_number() OVER w AS epoch, lag(event_id) OVER w AS claimed FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
d AS (SELECT *, sha256(coalesce(claimed::VARCHAR, '') || '|' || epoch || '|' || event_id) AS made FROM e), f AS (SELECT *, lag(made) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM d),
g AS (SELECT *, CASE WHEN value > 99 THEN 'forged' ELSE sha256(coalesce(previous, '') || '|' || epoch || '|' || event_id) END AS digest FROM f),
h AS (SELECT *, lag(digest) OVER (PARTITION BY user_id ORDER BY epoch) AS before FROM g)
SELECT user_id, count(*) AS broken FROM h WHERE previous IS DISTINCT FROM before OR digest = 'forged' GROUP BY 1""",
    "order_components": "SELECT min(o_orderkey) AS component, count(*) AS nodes FROM orders GROUP BY o_custkey HAVING count(*) > 1",
    "party_components": """WITH RECURSIVE p AS (SELECT DISTINCT doc_id, clean_identifier AS i FROM parties WHERE doc_id IS NOT NULL AND NOT is_law_firm AND length(clean_identifier) IN (11, 14) AND replace(clean_identifier, '0', '') <> '' AND replace(clean_identifier, '1', '') <> ''),
e AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM p a JOIN p b USING (i)), r AS (SELECT x AS node, x AS seen FROM e UNION SELECT r.node, e.y FROM r JOIN e ON r.seen = e.x),
c AS (SELECT node, min(seen) AS component FROM r GROUP BY 1), s AS (SELECT component, count(*) AS documents FROM c GROUP BY 1) SELECT documents, count(*) AS parts FROM s GROUP BY 1""",
    "cycle_nodes": """WITH RECURSIVE n AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events),
e AS (SELECT a, b FROM n WHERE b IS NOT NULL AND a < b GROUP BY ALL HAVING count(*) > 200 UNION SELECT max(event_type), min(event_type) FROM events),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT DISTINCT a AS node FROM r WHERE a = b""",
    "integrity_faults": " UNION ALL ".join([_dup("chunks", "chunk_id"), _dup("blocks", "block_id"), _orphan("slice without chunk", "candidate_slices", "chunk_id", "chunks", "chunk_id"), _orphan("vector without chunk", "vectors", "chunk_id", "chunks", "chunk_id"), _orphan("party without record", "parties", "doc_id", "curation", "mfiles_id"), _orphan("mention without block", "temporal_mentions", "block_id", "blocks", "block_id"), _orphan("line without order", "lineitem", "l_orderkey", "orders", "o_orderkey")]),
    "projection_parity": """WITH a AS (SELECT DISTINCT chunk_id FROM chunks), b AS (SELECT DISTINCT chunk_id FROM vectors WHERE chunk_id IS NOT NULL)
SELECT 'left' AS side, count(*) AS n FROM (FROM a EXCEPT FROM b) HAVING count(*) > 0 UNION ALL SELECT 'right', count(*) FROM (FROM b EXCEPT FROM a) HAVING count(*) > 0""",
    "family_leakage": """SELECT 'family' AS fault, family_id AS key FROM eval_passages GROUP BY family_id HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'text', min(item_id)::VARCHAR FROM eval_passages GROUP BY text HAVING count(*) > 1""",
}

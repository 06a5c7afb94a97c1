"""Ordered blocks, references, spans and texts of vault documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.functions.text import fold
from acervo.operators.blocks import block_groups, bound_references, clause_context, coverage, current_blocks, last_blocks, references, runs
from acervo.session import table


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_blocks(table(spark, sf_dir, "blocks")).where("doc_id IS NOT NULL")


def block_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clause_context(_blocks(spark, sf_dir))


def block_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_groups(_blocks(spark, sf_dir), F.lower("block_type").isin("clause", "signature"))


def block_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(_blocks(spark, sf_dir), F.lower("block_type"))


def terminal_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_blocks(_blocks(spark, sf_dir), 5)


def clause_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references(_blocks(spark, sf_dir))


def reference_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound_references(_blocks(spark, sf_dir)).groupBy("label", "state").agg(F.count(F.lit(1)).alias("n"), F.min("target_block").alias("first_target"))


def parent_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many blocks stand above each block: closure along parents, cut where a parent is missing."""
    from acervo.operators.graph import ancestors

    edges = _blocks(spark, sf_dir).where("parent_clause_id IS NOT NULL").select(F.col("block_id").alias("child"), F.col("parent_clause_id").alias("parent"))
    return ancestors(edges).groupBy("child").agg(F.count(F.lit(1)).alias("above"), F.max("depth").alias("depth"))


def chunk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps and overlaps between the chunks of a unit, replays counted once."""
    return coverage(table(spark, sf_dir, "chunks").select("unit_id", "unit_start", "unit_end").distinct(), "unit_id", "unit_start", "unit_end")


def slice_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage(table(spark, sf_dir, "candidate_slices").select("chunk_id", "start_pos", "end_pos").distinct(), "chunk_id", "start_pos", "end_pos")


def mention_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each mention quotes its block at the place it names."""
    m = table(spark, sf_dir, "temporal_mentions")
    b = _blocks(spark, sf_dir).select("block_id", "text_raw")
    quote = F.substring(F.col("text_raw"), F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos"))
    state = F.when(F.col("text_raw").isNull(), "no_block").when(quote.eqNullSafe(F.col("raw_text")), "proved").otherwise("differs")
    return m.join(b, "block_id", "left").select("mention_id", state.alias("state"))


def mention_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of mentions whose spans in one block overlap (interval join within the block)."""
    m = table(spark, sf_dir, "temporal_mentions").where("block_id IS NOT NULL").select("block_id", "mention_id", "start_pos", "end_pos")
    a, b = (m.select("block_id", *[F.col(c).alias(f"{c}_{s}") for c in ("mention_id", "start_pos", "end_pos")]) for s in "ab")
    met = a.join(b, "block_id").where("mention_id_a < mention_id_b AND start_pos_a < end_pos_b AND start_pos_b < end_pos_a")
    return met.select("mention_id_a", "mention_id_b", (F.least("end_pos_a", "end_pos_b") - F.greatest("start_pos_a", "start_pos_b")).alias("shared"))


def document_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document put together in order: length and digest of its text."""
    parts = _blocks(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("order_index", "block_id", "text_raw"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["text_raw"]), "\n")
    return parts.select("doc_id", F.length(text).alias("characters"), F.md5(text).alias("digest"))


def content_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted risk marks of each document, from its blocks, parties and metadata."""
    b = table(spark, sf_dir, "blocks").where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.bool_or(F.coalesce(F.size("uncertainty_flags") > 0, F.lit(False))).alias("flagged"), F.bool_or(F.coalesce(fold(F.col("text_raw")).rlike(r"_{2,}|a preencher"), F.lit(False))).alias("blank")
    )
    p = table(spark, sf_dir, "parties").where("NOT is_law_firm").select("doc_id", F.lit(True).alias("has_party")).distinct()
    m = table(spark, sf_dir, "contract_metadata").select("doc_id", F.lit(True).alias("has_metadata")).distinct()
    risks = F.array_sort(F.array_compact(F.array(F.when(F.col("flagged"), "block_flags"), F.when(F.col("blank"), "placeholder"), F.when(F.col("has_party").isNull(), "missing_parties"), F.when(F.col("has_metadata").isNull(), "no_metadata"))))
    return b.join(p, "doc_id", "left").join(m, "doc_id", "left").select("doc_id", F.array_join(risks, ",").alias("risks"))


QUERIES = {f.__name__: f for f in (block_context, block_grouping, block_runs, terminal_blocks, clause_references, reference_binding, parent_closure, chunk_coverage, slice_coverage, mention_proofs, mention_overlaps, document_render, content_risks)}

_B = "b AS (SELECT * FROM blocks WHERE block_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY ingested_at DESC NULLS LAST, text_search NULLS LAST, hierarchy_level) = 1), c AS (SELECT * FROM b WHERE doc_id IS NOT NULL)"
_REFS = r"refs AS (SELECT DISTINCT block_id, doc_id, 'clause:' || unnest(regexp_extract_all(strip_accents(lower(text_raw)), 'clausula (\d{1,3})(?:[ªºa]\b|[ªº]|\b)', 1)) AS label FROM c)"
_COVER = "SELECT {i}, {s}, {e}, CASE WHEN {s} > before THEN 'gap' ELSE 'overlap' END AS fault FROM (SELECT *, max({e}) OVER (PARTITION BY {i} ORDER BY {s}, {e} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT DISTINCT {i}, {s}, {e} FROM {t} WHERE {i} IS NOT NULL AND {s} IS NOT NULL)) WHERE {s} <> before"
SQL = {
    "block_context": f"""WITH {_B} SELECT block_id, last_value(CASE WHEN lower(block_type) = 'clause' THEN block_id END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY order_index, block_id ROWS UNBOUNDED PRECEDING) AS clause_id,
  coalesce(max((lower(block_type) = 'signature')::INT) OVER (PARTITION BY doc_id ORDER BY order_index, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after_signature FROM c""",
    "block_grouping": f"""WITH {_B}, g AS (SELECT *, sum((lower(block_type) IN ('clause', 'signature'))::INT) OVER (PARTITION BY doc_id ORDER BY order_index, block_id ROWS UNBOUNDED PRECEDING)::BIGINT AS group_no FROM c)
SELECT doc_id, group_no, arg_min(block_id, {{'a': order_index, 'b': block_id}}) AS first_block, count(*) AS blocks, sum(length(text_raw))::BIGINT AS characters FROM g GROUP BY ALL""",
    "block_runs": f"""WITH {_B}, n AS (SELECT doc_id, lower(block_type) AS value, row_number() OVER (PARTITION BY doc_id ORDER BY order_index, block_id) AS spot,
  row_number() OVER (PARTITION BY doc_id, lower(block_type) ORDER BY order_index, block_id) AS own FROM c), i AS (SELECT doc_id, value, spot - own AS island, count(*) AS blocks, min(spot) AS first FROM n GROUP BY ALL)
SELECT doc_id, value, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS run_no, blocks FROM i""",
    "terminal_blocks": f"WITH {_B} SELECT doc_id, block_id, row_number() OVER (PARTITION BY doc_id ORDER BY order_index DESC, block_id DESC) AS place FROM c QUALIFY place <= 5",
    "clause_references": f"WITH {_B}, {_REFS} SELECT block_id, doc_id, label FROM refs",
    "reference_binding": rf"""WITH {_B}, {_REFS}, labels AS (SELECT doc_id, 'clause:' || regexp_extract(strip_accents(lower(hierarchy_label)), 'clausula (\d{{1,3}})', 1) AS label, count(*) AS n, min(block_id) AS target FROM c
  WHERE regexp_matches(strip_accents(lower(hierarchy_label)), 'clausula (\d{{1,3}})') GROUP BY 1, 2),
j AS (SELECT label, CASE WHEN n = 1 THEN 'bound' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS state, CASE WHEN n = 1 THEN target END AS target FROM refs LEFT JOIN labels USING (doc_id, label))
SELECT label, state, count(*) AS n, min(target) AS first_target FROM j GROUP BY ALL""",
    # A block has one parent, so what stands above it is a line: its length is both figures.
    "parent_closure": f"""WITH RECURSIVE {_B}, e AS (SELECT block_id AS child, parent_clause_id AS parent FROM c WHERE parent_clause_id IS NOT NULL),
up AS (SELECT child, parent FROM e UNION SELECT up.child, e.parent FROM up JOIN e ON up.parent = e.child) SELECT child, count(*) AS above, count(*)::INT AS depth FROM up GROUP BY child""",
    "chunk_coverage": _COVER.format(i="unit_id", s="unit_start", e="unit_end", t="chunks"),
    "slice_coverage": _COVER.format(i="chunk_id", s="start_pos", e="end_pos", t="candidate_slices"),
    "mention_proofs": f"WITH {_B} SELECT mention_id, CASE WHEN text_raw IS NULL THEN 'no_block' WHEN substr(text_raw, start_pos + 1, end_pos - start_pos) IS NOT DISTINCT FROM raw_text THEN 'proved' ELSE 'differs' END AS state FROM temporal_mentions LEFT JOIN c USING (block_id)",
    "mention_overlaps": """SELECT a.mention_id AS mention_id_a, b.mention_id AS mention_id_b, least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos) AS shared
FROM temporal_mentions a JOIN temporal_mentions b ON a.block_id = b.block_id AND a.mention_id < b.mention_id AND a.start_pos < b.end_pos AND b.start_pos < a.end_pos""",
    "document_render": f"WITH {_B}, t AS (SELECT doc_id, string_agg(text_raw, chr(10) ORDER BY order_index, block_id) AS text FROM c GROUP BY 1) SELECT doc_id, length(text) AS characters, md5(text) AS digest FROM t",
    "content_risks": r"""WITH k AS (SELECT doc_id, bool_or(coalesce(len(uncertainty_flags) > 0, false)) AS flagged, bool_or(coalesce(regexp_matches(strip_accents(lower(text_raw)), '_{2,}|a preencher'), false)) AS blank FROM blocks WHERE doc_id IS NOT NULL GROUP BY 1)
SELECT doc_id, array_to_string(list_sort(list_filter([CASE WHEN flagged THEN 'block_flags' END, CASE WHEN blank THEN 'placeholder' END,
  CASE WHEN doc_id NOT IN (SELECT doc_id FROM parties WHERE NOT is_law_firm AND doc_id IS NOT NULL) THEN 'missing_parties' END, CASE WHEN doc_id NOT IN (SELECT doc_id FROM contract_metadata WHERE doc_id IS NOT NULL) THEN 'no_metadata' END], lambda x: x IS NOT NULL)), ',') AS risks FROM k""",
}

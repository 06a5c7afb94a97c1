"""Answers, checks, rates, reuse: over chunks, parties, curation and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.functions.embed import hash_embedder
from acervo.functions.lexicon import STOP_WORDS
from acervo.operators.answers import case_checks, citations, rates, selection_findings, shown_metrics, term_coverage, unsupported
from acervo.operators.reuse import appended, cache_lookup, decided, lru_kept, mapped_by_place, vector_plan, with_former_input, with_opinion
from acervo.session import table


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").where("chunk_id IS NOT NULL").groupBy("chunk_id").agg(*[F.min(c).alias(c) for c in ("unit_id", "instrument_id", "verbatim_text", "synthetic_context", "unit_start")])


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions are the contexts and last words of chunks; the proof is the chunk, the names its context."""
    c = _chunks(spark, sf_dir)
    asked = c.select(F.col("chunk_id").alias("query_id"), F.concat_ws(" ", "synthetic_context", F.substring("verbatim_text", -60, 60), F.lit("multa resolutiva")).alias("text"))
    return term_coverage(asked, c.select(F.col("chunk_id").alias("query_id"), F.substring("verbatim_text", 1, 400).alias("text")), c.select(F.col("chunk_id").alias("query_id"), F.col("synthetic_context").alias("text")))


def coverage_of_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir).groupBy("query_id", "state").agg(F.count(F.lit(1)).alias("n"), F.min("term").alias("first"))


def unsupported_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unsupported(_coverage(spark, sf_dir))


def candidate_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What slices select against what chunks offer: slices name their chunk and, as an item, their eligibility; two items are asked."""
    s = table(spark, sf_dir, "candidate_slices").select(F.col("chunk_id").alias("query_id"), F.concat("chunk_id", F.lit("#"), "slice_no").alias("unit_id"), F.col("eligibility").alias("item"))
    offered = table(spark, sf_dir, "candidate_slices").where("slice_no < 2").select(F.col("chunk_id").alias("query_id"), F.concat("chunk_id", F.lit("#"), "slice_no").alias("unit_id"))
    items = s.select("query_id").distinct().select("query_id", F.explode(F.array(F.lit("pending_review"), F.lit("approved"))).alias("item"))
    return selection_findings(s, offered, items)


def answer_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of each profile cited by instrument, chunks at the start of their unit selected."""
    c = table(spark, sf_dir, "chunks").where("chunk_id IS NOT NULL AND instrument_id IS NOT NULL").groupBy("chunk_id").agg(*[F.min(x).alias(x) for x in ("profile_id", "instrument_id", "verbatim_text", "synthetic_context", "unit_start")])
    proof = c.select(F.col("profile_id").alias("query_id"), "instrument_id", F.col("chunk_id").alias("unit_id"), (F.col("unit_start") == 0).alias("selected"), F.col("unit_start").alias("position"), F.col("synthetic_context").alias("title"), F.col("verbatim_text").alias("text"))
    return citations(proof).select("query_id", "instrument_no", "unit_no", "unit_id", F.md5("line").alias("digest"))


def case_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases are documents with the roles that must be named; the answer names the roles of its rows with an identifier and quotes their names."""
    p = table(spark, sf_dir, "parties").where("doc_id IS NOT NULL")
    role = F.lower(F.trim("role"))
    sets = lambda c: F.array_sort(F.collect_set(c))
    cases = p.groupBy(F.col("doc_id").alias("case_id")).agg(sets(role).alias("contracts"), F.array(F.lower(F.min("name"))).alias("terms"))
    answers = p.where("clean_identifier IS NOT NULL").groupBy(F.col("doc_id").alias("case_id")).agg(sets(role).alias("contracts"), sets("name").alias("quotes"))
    return case_checks(cases, answers).select("case_id", "passed", F.array_join("missing", ",").alias("missing"))


def e2e_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", (F.col("value") > 50).alias("faithful"), (F.col("user_id") % 2 == 0).alias("right_action"), F.when(F.col("event_type") != "error", F.col("user_id") % 5).otherwise(0).alias("quotes"), F.when(F.col("event_type") != "error", F.least(F.col("user_id") % 5, F.col("user_id") % 3)).otherwise(0).alias("faithful_quotes"))
    return rates(e, "event_type")


def metrics_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts").cast("date").cast("string"))
    return shown_metrics(e, "day", F.col("event_type") == "error", F.col("event_id") % 100, F.col("user_id") % 4 == 0)


def model_opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with an opinion on their state; half of the states are in the cache already."""
    rows = table(spark, sf_dir, "curation").select("row_id", "class_name", "folder")
    say = F.concat(F.lit("opinion:"), F.substring(F.col("state_json"), 1, 40))
    empty = rows.where("false").select(F.lit("").alias("state_key"), F.lit("").alias("opinion"))
    first, fresh = with_opinion(rows.where("row_id % 2 = 0"), ["folder", "class_name"], empty, say)
    both, new = with_opinion(rows, ["folder", "class_name"], fresh, say)
    known = fresh.select("state_key", F.lit(True).alias("cached"))
    return both.join(known, "state_key", "left").select("row_id", "opinion", F.coalesce("cached", F.lit(False)).alias("cached"))


def former_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "curation")
    rows = c.where("decision = 'include'").select("row_id", "mfiles_id", "mfiles_version")
    former = c.where("decision = 'exclude' AND cliente IS NOT NULL").select("mfiles_id", "mfiles_version", F.col("cliente").alias("entered"))
    return with_former_input(rows, former, "mfiles_id", "mfiles_version", "entered").select("row_id", "former_value", "former_match")


def orphan_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Party documents that no current record of the vault has, in order."""
    o = table(spark, sf_dir, "parties").where("doc_id IS NOT NULL").select("doc_id").distinct()
    held = table(spark, sf_dir, "curation").where("decision = 'include' AND mfiles_id IS NOT NULL").select(F.col("mfiles_id").alias("doc_id"))
    return o.join(held, "doc_id", "left_anti").orderBy("doc_id")


def review_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions with the kind that was given to the same place in the same block, where all say the same."""
    m = table(spark, sf_dir, "temporal_mentions").select("mention_id", "doc_id", "block_id", "start_pos", "end_pos", "kind")
    return mapped_by_place(m.drop("kind"), m, ["doc_id", "block_id", "start_pos", "end_pos"], "kind").select("mention_id", "kind")


def unit_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks by the units of their document."""
    u = table(spark, sf_dir, "chunks").select(F.split("instrument_id", ":")[1].cast("long").alias("doc_id"), "unit_id").where("doc_id IS NOT NULL AND unit_id IS NOT NULL").distinct()
    b = table(spark, sf_dir, "blocks").where("doc_id IS NOT NULL").select("doc_id", "block_id").distinct()
    return u.join(b, "doc_id").groupBy("unit_id").agg(F.count(F.lit(1)).alias("blocks"), F.min("block_id").alias("first"))


def unit_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as decisions on users: the head decides only where it is about the type that is asked."""
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL")
    subjects = e.select("user_id", "event_type").distinct()
    log = e.select("user_id", "event_type", "event_id", F.when(F.col("value") >= 50, "approved").otherwise("rejected").alias("state"))
    return decided(subjects, log, ["user_id"], ["event_type"], "event_id", "state")


def cache_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases against what was last viewed by the same user: within two days, of a low value (an epoch) not before 20."""
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL").select("event_id", "ts", "user_id", "event_type", "value")
    entries = e.where("event_type = 'view'").groupBy("user_id").agg(F.min("ts").alias("stored_at"), F.floor(F.min_by("value", F.struct("ts", "event_id"))).alias("epoch"))
    return cache_lookup(e.where("event_type = 'purchase'"), entries, ["user_id"], "ts", 172_800, F.lit(20)).select("event_id", "outcome")


def cache_evictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that stay where each source may keep 20,000 characters, last loaded first."""
    d = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND source IS NOT NULL").groupBy("doc_id", "source").agg(F.max(F.length(F.coalesce("text", F.lit("")))).cast("long").alias("size"), F.max("loaded_at").alias("loaded_at"))
    return lru_kept(d, "source", "loaded_at", "size", 20_000, "doc_id").select("doc_id", "source")


def ledger_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions delivered again against those held: new, the same, or in conflict."""
    m = table(spark, sf_dir, "temporal_mentions").select(F.concat_ws(":", "block_id", "start_pos").alias("key"), "raw_text", "kind", "mention_id")
    return appended(m.where("mention_id % 3 > 0"), m, "key", ["raw_text", "kind"]).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def vector_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generation built on one in which texts of odd length were others and late units were not there."""
    c = _chunks(spark, sf_dir).select("chunk_id", "verbatim_text", "unit_start")
    before = c.where("unit_start < 500 OR unit_start IS NULL").select("chunk_id", F.when(F.length("verbatim_text") % 2 == 1, F.upper("verbatim_text")).otherwise(F.col("verbatim_text")).alias("t"))
    identity = F.lit("hash-48")
    prior = before.select("chunk_id", F.sha2(F.concat_ws("\x1f", identity, "t"), 256).alias("digest"), hash_embedder(48)(F.col("t")).alias("vector"))
    now = c.where("unit_start IS NULL OR unit_start <> 0 OR length(verbatim_text) > 100")
    plan = vector_plan(now, prior, "chunk_id", "verbatim_text", identity)
    return plan.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.count("vector").alias("vectors"))


def sample_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by file extension and decision, with those at risk."""
    c = table(spark, sf_dir, "curation")
    at_risk = (F.lower("sync_status") != "ok") | (F.size("reasons") > 1)
    return c.groupBy(F.lower(F.col("file.extension")).alias("extension"), "decision").agg(F.count(F.lit(1)).alias("n"), F.count_if(at_risk).alias("at_risk"), F.count_if(F.col("title").isNull()).alias("untitled"))


def risk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each uncertainty flag stands on blocks and on mentions."""
    flags = [table(spark, sf_dir, t).select(F.lit(t).alias("kind"), F.explode("uncertainty_flags").alias("flag")) for t in ("blocks", "temporal_mentions")]
    return flags[0].unionByName(flags[1]).groupBy("kind", "flag").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "flag")


def pending_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that came after a moment, by table."""
    since = F.lit("2024-10-01 00:00:00").cast("timestamp")
    at = {"blocks": "ingested_at", "documents": "loaded_at", "vectors": "embedded_at", "contract_metadata": "extracted_at"}
    parts = [table(spark, sf_dir, t).agg(F.count_if(F.col(c) > since).alias("n")).select(F.lit(t).alias("kind"), "n") for t, c in at.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def date_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their one signature date, or that it is in conflict."""
    m = table(spark, sf_dir, "temporal_mentions").where("kind = 'signature' AND doc_id IS NOT NULL")
    dates = m.groupBy("doc_id").agg(F.count_distinct("normalized_date").alias("n"), F.min("normalized_date").alias("d"))
    return dates.select("doc_id", F.when(F.col("n") == 1, F.col("d")).alias("date"), (F.col("n") > 1).alias("conflict"))


QUERIES = {f.__name__: f for f in (coverage_of_terms, unsupported_items, candidate_findings, answer_citations, case_results, e2e_rates, metrics_shown, model_opinions, former_input, orphan_overrides, review_places, unit_blocks, unit_decisions, cache_outcomes, cache_evictions, ledger_append, vector_reuse, sample_distribution, risk_counts, pending_changes, date_conflicts)}

_C = "c AS (SELECT chunk_id, min(unit_id) AS unit_id, min(instrument_id) AS instrument_id, min(verbatim_text) AS verbatim_text, min(synthetic_context) AS synthetic_context, min(unit_start) AS unit_start FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1)"
_W = r"regexp_extract_all(strip_accents(lower(replace({}, 'ß', 'ss'))), '[\p{{L}}\p{{N}}]+')"
_COVER = rf"""WITH {_C}, q AS (SELECT chunk_id AS query_id, concat_ws(' ', synthetic_context, right(verbatim_text, 60), 'multa resolutiva') AS text, left(verbatim_text, 400) AS proof, synthetic_context AS names FROM c),
terms AS (SELECT DISTINCT query_id, unnest({_W.format("text")}) AS term FROM q),
wanted AS (SELECT * FROM terms WHERE length(term) >= 3 AND NOT regexp_matches(term, '[0-9]') AND term NOT IN ({", ".join(repr(x) for x in STOP_WORDS)})),
held AS (SELECT DISTINCT query_id, unnest({_W.format("proof")}) AS w FROM q), named AS (SELECT DISTINCT query_id, unnest({_W.format("names")}) AS w FROM q),
cover AS (SELECT query_id, term, CASE WHEN EXISTS (SELECT 1 FROM named n WHERE n.query_id = t.query_id AND (n.w = term OR length(term) >= 5 AND length(n.w) >= 5 AND left(n.w, 5) = left(term, 5))) THEN 'identifying'
  WHEN EXISTS (SELECT 1 FROM held n WHERE n.query_id = t.query_id AND (n.w = term OR length(term) >= 5 AND length(n.w) >= 5 AND left(n.w, 5) = left(term, 5))) THEN 'present' ELSE 'absent' END AS state FROM wanted t)"""
SQL = {
    "coverage_of_terms": _COVER + " SELECT query_id, state, count(*) AS n, min(term) AS first FROM cover GROUP BY ALL",
    "unsupported_items": _COVER + " SELECT query_id, count(*) AS terms FROM cover WHERE state <> 'identifying' GROUP BY 1 HAVING count(*) FILTER (state = 'present') = 0",
    "candidate_findings": """WITH s AS (SELECT chunk_id AS query_id, chunk_id || '#' || slice_no AS unit_id, eligibility AS item, slice_no FROM candidate_slices), i AS (SELECT DISTINCT query_id, unnest(['pending_review', 'approved']) AS item FROM s)
SELECT DISTINCT query_id, 'unit_not_offered' AS code, unit_id AS subject FROM s WHERE unit_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s o WHERE o.slice_no < 2 AND o.query_id = s.query_id AND o.unit_id = s.unit_id)
UNION SELECT query_id, 'question_item_unknown', item FROM s WHERE item IS NOT NULL AND item NOT IN ('pending_review', 'approved')
UNION SELECT query_id, 'question_item_uncovered', item FROM i WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.query_id = i.query_id AND s.item = i.item)""",
    "answer_citations": """WITH c AS (SELECT chunk_id AS unit_id, min(profile_id) AS query_id, min(instrument_id) AS instrument_id, min(verbatim_text) AS text, min(synthetic_context) AS title, min(unit_start) AS position FROM chunks WHERE chunk_id IS NOT NULL AND instrument_id IS NOT NULL GROUP BY 1),
i AS (SELECT query_id, instrument_id, row_number() OVER (PARTITION BY query_id ORDER BY bool_or(position = 0) DESC, instrument_id) AS instrument_no FROM c GROUP BY query_id, instrument_id),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id, instrument_id ORDER BY position, unit_id) AS unit_no FROM c JOIN i USING (query_id, instrument_id))
SELECT query_id, instrument_no, unit_no, unit_id, md5('Prova ' || instrument_no || '.' || unit_no || ' — ' || coalesce(title, '') || ' [' || instrument_id || '] (' || CASE WHEN position = 0 THEN 'selecionada' ELSE 'fechamento obrigatório' END || ')' || chr(10)
  || array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: CASE WHEN x = '' THEN '>' ELSE '> ' || x END), chr(10))) AS digest FROM n""",
    "case_results": rf"""WITH p AS (SELECT *, lower(trim(role)) AS r FROM parties WHERE doc_id IS NOT NULL),
c AS (SELECT doc_id AS case_id, coalesce(list_sort(list(DISTINCT r) FILTER (r IS NOT NULL)), []) AS contracts, lower(min(name)) AS term FROM p GROUP BY 1),
a AS (SELECT doc_id AS case_id, coalesce(list(DISTINCT r) FILTER (r IS NOT NULL), []) AS got, list(DISTINCT name) FILTER (name IS NOT NULL) AS quotes FROM p WHERE clean_identifier IS NOT NULL GROUP BY 1),
m AS (SELECT case_id, got, list_filter(contracts, lambda x: NOT list_contains(coalesce(got, []), x)) AS missing, array_to_string(list_transform(coalesce(quotes, []), lambda q: array_to_string({_W.format("q")}, ' ')), chr(10)) AS body, array_to_string({_W.format("term")}, ' ') AS term FROM c LEFT JOIN a USING (case_id))
SELECT case_id, got IS NOT NULL AND len(missing) = 0 AND contains(body, term) AS passed, array_to_string(missing, ',') AS missing FROM m""",
    "e2e_rates": """WITH e AS (SELECT event_type, value > 50 AS f, user_id % 2 = 0 AS a, CASE WHEN event_type <> 'error' THEN user_id % 5 ELSE 0 END AS q, CASE WHEN event_type <> 'error' THEN least(user_id % 5, user_id % 3) ELSE 0 END AS fq FROM events)
SELECT event_type, count(*) AS n, round(count(*) FILTER (f) / count(*), 4) AS fidelity, round(count(*) FILTER (a) / count(*), 4) AS actions, round(sum(fq) / nullif(sum(q), 0), 4) AS quotes FROM e GROUP BY 1""",
    "metrics_shown": """SELECT date_trunc('day', ts)::DATE::VARCHAR AS day, printf('%.1f%%', 100 * avg((event_type = 'error')::INT)) AS error_rate, printf('%.1f ms', avg(event_id % 100)) AS latency, printf('%.1f%%', 100 * avg((user_id % 4 = 0)::INT)) AS hit_rate FROM events GROUP BY 1""",
    "model_opinions": """WITH s AS (SELECT row_id, row_id % 2 = 0 AS half, '{' || concat_ws(',', '"class_name":' || to_json(class_name)::VARCHAR, '"folder":' || to_json(folder)::VARCHAR) || '}' AS j FROM curation)
SELECT row_id, 'opinion:' || left(j, 40) AS opinion, j IN (SELECT j FROM s WHERE half) AS cached FROM s""",
    "former_input": """WITH r AS (SELECT row_id, mfiles_id, mfiles_version FROM curation WHERE decision = 'include'), f AS (SELECT mfiles_id, mfiles_version, cliente FROM curation WHERE decision = 'exclude' AND cliente IS NOT NULL),
e AS (SELECT mfiles_id, mfiles_version, max(cliente) AS v FROM f GROUP BY ALL), k AS (SELECT mfiles_id, cliente AS v FROM f WHERE mfiles_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY mfiles_id ORDER BY coalesce(mfiles_version, -1) DESC, cliente DESC) = 1)
SELECT row_id, coalesce(e.v, k.v) AS former_value, CASE WHEN e.v IS NOT NULL THEN 'version' WHEN k.v IS NOT NULL THEN 'key' END AS former_match FROM r LEFT JOIN e ON e.mfiles_id = r.mfiles_id AND e.mfiles_version = r.mfiles_version LEFT JOIN k ON k.mfiles_id = r.mfiles_id""",
    "orphan_overrides": "SELECT DISTINCT doc_id FROM parties WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT mfiles_id FROM curation WHERE decision = 'include' AND mfiles_id IS NOT NULL) ORDER BY doc_id",
    "review_places": """SELECT m.mention_id, k.kind FROM temporal_mentions m LEFT JOIN (SELECT doc_id, block_id, start_pos, end_pos, min(kind) AS kind FROM temporal_mentions GROUP BY ALL HAVING min(kind) = max(kind)) k USING (doc_id, block_id, start_pos, end_pos)""",
    "unit_blocks": """WITH u AS (SELECT DISTINCT unit_id, split_part(instrument_id, ':', 2)::BIGINT AS doc_id FROM chunks WHERE unit_id IS NOT NULL AND instrument_id IS NOT NULL), b AS (SELECT DISTINCT doc_id, block_id FROM blocks WHERE doc_id IS NOT NULL)
SELECT unit_id, count(*) AS blocks, min(block_id) AS first FROM u JOIN b USING (doc_id) GROUP BY 1""",
    "unit_decisions": """WITH h AS (SELECT user_id, event_type AS head, value FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT DISTINCT e.user_id, e.event_type, CASE WHEN head IS NOT DISTINCT FROM e.event_type THEN CASE WHEN h.value >= 50 THEN 'approved' ELSE 'rejected' END ELSE 'blocked' END AS decision FROM events e JOIN h USING (user_id)""",
    "cache_outcomes": """WITH v AS (SELECT user_id, min(ts) AS stored, floor(arg_min(value, (ts, event_id))) AS epoch FROM events WHERE event_type = 'view' AND user_id IS NOT NULL GROUP BY 1)
SELECT event_id, CASE WHEN stored IS NULL THEN 'miss' WHEN epoch < 20 THEN 'stale' WHEN floor(epoch_us(ts) / 1000000) - floor(epoch_us(stored) / 1000000) NOT BETWEEN 0 AND 172799 THEN 'expired' ELSE 'hit' END AS outcome FROM events LEFT JOIN v USING (user_id) WHERE event_type = 'purchase' AND user_id IS NOT NULL""",
    "cache_evictions": """WITH d AS (SELECT doc_id, source, max(length(coalesce(text, ''))) AS size, max(loaded_at) AS loaded FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL GROUP BY ALL)
SELECT doc_id, source FROM d QUALIFY sum(size) OVER (PARTITION BY source ORDER BY loaded DESC NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) <= 20000""",
    "ledger_append": """WITH m AS (SELECT concat_ws(':', block_id, start_pos) AS key, coalesce(raw_text, '~') || '|' || coalesce(kind, '~') AS d, mention_id % 3 > 0 AS held FROM temporal_mentions),
k AS (SELECT key, min(d) AS lo, max(d) AS hi, count(*) FILTER (held) AS n, count(*) FILTER (held AND d = d) AS same FROM m GROUP BY key)
SELECT CASE WHEN lo <> hi THEN 'conflict' WHEN n = 0 THEN 'new' ELSE 'repeated' END AS outcome, count(*) AS n FROM k GROUP BY 1""",
    "vector_reuse": f"""WITH {_C}, old AS (SELECT chunk_id, verbatim_text AS t, length(verbatim_text) % 2 = 1 AS other FROM c WHERE unit_start < 500 OR unit_start IS NULL), now AS (SELECT chunk_id, verbatim_text AS t FROM c WHERE unit_start IS NULL OR unit_start <> 0 OR length(verbatim_text) > 100),
p AS (SELECT CASE WHEN n.chunk_id IS NULL THEN 'drop' WHEN n.t IS NULL THEN 'skip' WHEN o.chunk_id IS NOT NULL AND (NOT other OR upper(n.t) = n.t) THEN 'reuse' ELSE 'embed' END AS action FROM now n FULL JOIN old o ON o.chunk_id = n.chunk_id)
SELECT action, count(*) AS n, count(*) FILTER (action = 'reuse') AS vectors FROM p GROUP BY 1""",
    "sample_distribution": "SELECT lower(file.extension) AS extension, decision, count(*) AS n, count(*) FILTER (lower(sync_status) <> 'ok' OR len(reasons) > 1) AS at_risk, count(*) FILTER (title IS NULL) AS untitled FROM curation GROUP BY ALL",
    "risk_counts": "SELECT kind, flag, count(*) AS n FROM (SELECT 'blocks' AS kind, unnest(uncertainty_flags) AS flag FROM blocks UNION ALL SELECT 'temporal_mentions', unnest(uncertainty_flags) FROM temporal_mentions) GROUP BY ALL ORDER BY ALL",
    "pending_changes": " UNION ALL ".join(f"SELECT '{t}' AS kind, count(*) FILTER ({c} > '2024-10-01 00:00:00'::TIMESTAMP) AS n FROM {t}" for t, c in (("blocks", "ingested_at"), ("documents", "loaded_at"), ("vectors", "embedded_at"), ("contract_metadata", "extracted_at"))),
    "date_conflicts": "SELECT doc_id, CASE WHEN count(DISTINCT normalized_date) = 1 THEN min(normalized_date) END AS date, count(DISTINCT normalized_date) > 1 AS conflict FROM temporal_mentions WHERE kind = 'signature' AND doc_id IS NOT NULL GROUP BY 1",
}

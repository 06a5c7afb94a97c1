"""Whole runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acervo.plans.retrieve import Corpus, retrieve
from acervo.session import cut, table


def _corpus(spark: SparkSession, sf_dir: str) -> tuple[Corpus, DataFrame, DataFrame]:
    """Embedded chunks, numbered by their vector; a chunk depends on the one before it in its unit. Questions are the last words of chunks, one vector in fifty, each with its vector; every other asks for parties too."""
    v = table(spark, sf_dir, "vectors").where("dimension = 96 AND size(vector) = 96 AND chunk_id IS NOT NULL AND forall(vector, x -> x IS NOT NULL AND abs(x) <= 1e30)")
    v = v.groupBy("chunk_id").agg(F.min_by("vector", "vec_id").alias("vector"), F.min("vec_id").alias("id"))
    c = table(spark, sf_dir, "chunks").where("chunk_id IS NOT NULL AND verbatim_text IS NOT NULL AND instrument_id IS NOT NULL AND source_id IS NOT NULL")
    c = c.groupBy("chunk_id").agg(*[F.min(x).alias(x) for x in ("verbatim_text", "instrument_id", "source_id", "unit_id", "unit_start")]).join(v, "chunk_id")
    c = cut(c.drop("chunk_id"))  # read for texts, vectors, sources, lines of units and questions
    chunks = c.select("id", F.col("verbatim_text").alias("text"), "instrument_id", "source_id", F.size(F.split("verbatim_text", r"\s+")).alias("tokens"))
    parties = table(spark, sf_dir, "parties").where("doc_id IS NOT NULL AND role IS NOT NULL").select(F.concat(F.lit("doc:"), "doc_id").alias("instrument_id"), F.lower(F.trim("role")).alias("party_id"))
    line = Window.partitionBy("unit_id").orderBy("unit_start", "id")
    depends = c.where("unit_id IS NOT NULL").select(F.col("id").alias("child"), F.lag("id").over(line).alias("parent")).where("parent IS NOT NULL")
    depends = cut(depends)
    blocked = c.where("id % 7 = 0").select("source_id").distinct()
    roles, free = F.array(F.lit("locador"), F.lit("comprador")), F.array().cast("array<string>")
    asked = c.where("id % 50 = 0")
    questions = asked.select(F.col("id").alias("query_id"), F.substring("verbatim_text", -80, 80).alias("text"), F.when(F.col("id") % 100 == 0, roles).otherwise(free).alias("party_ids"), F.lit(False).alias("every_party"), F.lit(None).cast("array<string>").alias("instrument_ids"))
    return Corpus(chunks, parties, depends, c.select("id", "vector"), blocked), questions, asked.select("id", "vector")


def governed_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve(*_corpus(spark, sf_dir))[0]


def governed_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve(*_corpus(spark, sf_dir))[1]


QUERIES = {"governed_outcomes": governed_outcomes, "governed_evidence": governed_evidence}

_RUN = r"""
WITH RECURSIVE v AS (SELECT chunk_id, arg_min(vector, vec_id)::DOUBLE[] AS vector, min(vec_id) AS id FROM vectors WHERE dimension = 96 AND len(vector) = 96 AND chunk_id IS NOT NULL AND len(list_filter(vector, lambda x: x IS NULL OR NOT abs(x) <= 1e30)) = 0 GROUP BY 1),
c AS (SELECT * FROM (SELECT chunk_id, min(verbatim_text) AS text_raw, min(instrument_id) AS instrument_id, min(source_id) AS source_id, min(unit_id) AS unit_id, min(unit_start) AS unit_start FROM chunks WHERE chunk_id IS NOT NULL AND verbatim_text IS NOT NULL AND instrument_id IS NOT NULL AND source_id IS NOT NULL GROUP BY 1) JOIN v USING (chunk_id)),
allowed AS (SELECT id, instrument_id FROM c WHERE source_id NOT IN (SELECT source_id FROM c WHERE id % 7 = 0)),
q AS (SELECT id AS query_id, right(text_raw, 80) AS text, id % 100 = 0 AS limited, vector FROM c WHERE id % 50 = 0),
held AS (SELECT DISTINCT 'doc:' || doc_id AS instrument_id FROM parties WHERE doc_id IS NOT NULL AND lower(trim(role)) IN ('locador', 'comprador')),
eligible AS (SELECT query_id, id FROM q, allowed WHERE NOT limited OR instrument_id IN (SELECT instrument_id FROM held)),
docs AS (SELECT id, regexp_extract_all(strip_accents(lower(text_raw)), '[\p{L}\p{N}]+') AS t FROM c),
corpus AS (SELECT count(*) AS n, avg(len(t)) AS mean_length FROM docs),
posts AS (SELECT id, len_t, token, count(*) AS tf FROM (SELECT id, len(t) AS len_t, unnest(t) AS token FROM docs) GROUP BY ALL),
idfs AS (SELECT token, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM posts, corpus GROUP BY token),
floor_of AS (SELECT avg(idf) AS mean_idf FROM idfs),
asked AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')) AS token FROM q) GROUP BY ALL),
scores AS (SELECT query_id, id, round(sum(times * CASE WHEN idf < 0 THEN 0.25 * mean_idf ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len_t / mean_length))), 6) AS score
  FROM posts JOIN asked USING (token) JOIN idfs USING (token), corpus, floor_of GROUP BY ALL),
lexical AS (SELECT query_id, id, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0) DESC, id) AS rank FROM eligible LEFT JOIN scores USING (query_id, id) QUALIFY rank <= 50),
distances AS (SELECT query_id, c.id, round(list_sum(list_transform(list_zip(q.vector, c.vector), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS d FROM q, c JOIN allowed USING (id) WHERE c.id <> query_id),
near AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM distances QUALIFY rank <= 50),
fused AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, id, rank FROM lexical UNION ALL SELECT query_id, id, rank FROM near SEMI JOIN eligible USING (query_id, id)) GROUP BY ALL),
ranked AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fused QUALIFY rank <= 10),
steps AS (SELECT id AS child, lag(id) OVER (PARTITION BY unit_id ORDER BY unit_start, id) AS parent FROM c WHERE unit_id IS NOT NULL),
up AS (SELECT child, parent FROM steps WHERE parent IS NOT NULL UNION SELECT up.child, s.parent FROM up JOIN steps s ON up.parent = s.child WHERE s.parent IS NOT NULL),
proof AS (SELECT query_id, id, rank FROM ranked UNION ALL SELECT DISTINCT query_id, parent, NULL FROM ranked r JOIN up ON r.id = up.child WHERE NOT EXISTS (SELECT 1 FROM ranked x WHERE x.query_id = r.query_id AND x.id = up.parent)),
sums AS (SELECT query_id, sum(len(regexp_split_to_array(text_raw, '\s+'))) AS tokens FROM proof JOIN c USING (id) GROUP BY 1),
best AS (SELECT query_id, max(score) AS best FROM lexical GROUP BY 1),
outcome AS (SELECT q.query_id, CASE WHEN contains(strip_accents(lower(q.text)), 'sem especificar') OR contains(strip_accents(lower(q.text)), 'ambigu') THEN 'ambiguous_question' WHEN limited AND NOT EXISTS (SELECT 1 FROM held) THEN 'no_eligible_instruments'
  WHEN NOT EXISTS (SELECT 1 FROM eligible e WHERE e.query_id = q.query_id) THEN 'no_eligible_chunks' WHEN NOT limited AND coalesce(best, 0) <= 0 THEN 'insufficient_evidence' WHEN s.query_id IS NULL THEN 'no_ranked_evidence'
  WHEN tokens > 6000 THEN 'closure_budget_exceeded' END AS reason, coalesce(tokens, 0)::BIGINT AS tokens FROM q LEFT JOIN sums s USING (query_id) LEFT JOIN best USING (query_id))"""
SQL = {
    "governed_outcomes": _RUN + " SELECT query_id, CASE WHEN reason IS NULL THEN 'answered' WHEN reason = 'ambiguous_question' THEN 'needs_clarification' WHEN reason LIKE 'closure%' THEN 'blocked' ELSE 'abstained' END AS status, reason, tokens FROM outcome",
    "governed_evidence": _RUN + " SELECT query_id, id, rank FROM proof JOIN outcome USING (query_id) WHERE reason IS NULL",
}

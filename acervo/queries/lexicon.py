"""Identifiers, dates, tokens with aliases, plans of questions, slices, over the vault's texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.functions.lexicon import STOP_WORDS, content_terms, dates_in, identifiers_in, lexical_tokens, numeric_identifiers_in, planned, prefiltered, slices
from acervo.operators.retrieval import bm25, top_k, with_zero_scores
from acervo.session import table


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Party rows as sentences that name a person or company with its identifier."""
    p = table(spark, sf_dir, "parties")
    return p.select("party_id", "doc_id", F.concat_ws(" ", F.lit("Contratos de"), "name", F.lit("inscrito sob"), "raw_identifier", F.lit("em 01/02/2020")).alias("text"))


def identifier_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _typed(spark, sf_dir).select("party_id", identifiers_in(F.col("text")).alias("ids"))
    return found.where(F.size("ids") > 0).select("party_id", F.array_join("ids", ",").alias("ids"))


def numeric_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _typed(spark, sf_dir).select("party_id", numeric_identifiers_in(F.col("text")).alias("ids"))
    return found.where(F.size("ids") > 0).select("party_id", F.array_join("ids", ",").alias("ids"))


def text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in blocks, with those that no calendar has."""
    b = table(spark, sf_dir, "blocks").where("text_raw IS NOT NULL").select("block_id", F.explode(dates_in(F.col("text_raw"))).alias("d"))
    return b.select("block_id", "d.raw", "d.date").groupBy("block_id", "raw", "date").agg(F.count(F.lit(1)).alias("n"))


def token_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = lexical_tokens(F.col("text"))
    return _typed(spark, sf_dir).select("party_id", F.size(tokens).alias("tokens"), F.md5(F.array_join(tokens, " ")).alias("digest"))


def query_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of questions made of party rows, with the row's document's clean identifier given along."""
    p = table(spark, sf_dir, "parties").select("party_id", F.array_compact(F.array("clean_identifier")).alias("given"))
    plan = planned(_typed(spark, sf_dir).join(p, "party_id"), "party_id", "text", "given")
    return plan.select("query_id", F.array_join("party_ids", ",").alias("party_ids"), "every_party", "scope")


def legacy_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that bear an identifier of a question; questions are party rows with an id divisible by 50."""
    items = table(spark, sf_dir, "parties").select("doc_id", "clean_identifier")
    asked = _typed(spark, sf_dir).where("party_id % 50 = 0").select("party_id", numeric_identifiers_in(F.col("text")).alias("ids"))
    return prefiltered(items, "doc_id", "clean_identifier", asked, "party_id", "ids")


def question_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_passages").select("item_id", F.array_join(F.array_sort(content_terms(F.col("text"))), " ").alias("terms"))


def bm25_zero_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible documents (English ones of a kind) ranked by BM25, those without a shared word behind with score 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    asked = table(spark, sf_dir, "eval_passages").where("item_id % 50 = 0").select("item_id", "text")
    allowed = docs.where("lang = 'en' AND doc_id IS NOT NULL").select(F.col("doc_id").alias("id")).distinct()
    eligible = allowed.join(F.broadcast(asked.select(F.col("item_id").alias("query_id"))))
    return top_k(with_zero_scores(bm25(docs, "doc_id", "text", asked, "item_id", "text"), eligible), 60)


def budget_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks in pieces of at most 300 characters that join to the text again."""
    c = table(spark, sf_dir, "chunks").where("verbatim_text IS NOT NULL").select("chunk_id", "verbatim_text").distinct()
    cut = c.select("chunk_id", "verbatim_text", slices(F.col("verbatim_text"), 300).alias("s"))
    joined = F.array_join(F.transform("s", lambda x: x["text"]), "")
    return cut.select("chunk_id", F.coalesce(joined == F.col("verbatim_text"), F.col("verbatim_text") == "").alias("lossless"), F.coalesce(F.array_max(F.transform("s", lambda x: F.length(x["text"]))) <= 300, F.lit(True)).alias("fits"))


QUERIES = {f.__name__: f for f in (identifier_candidates, numeric_identifiers, text_dates, token_aliases, query_plan, legacy_prefilter, question_terms, bm25_zero_rows, budget_slices)}

# The other engine's patterns cannot look around: neighbours are taken along, and blanks doubled so that none is shared.
_T = "t AS (SELECT party_id, doc_id, clean_identifier, concat_ws(' ', 'Contratos de', name, 'inscrito sob', raw_identifier, 'em 01/02/2020') AS text FROM parties)"
_ID = r"list_transform(regexp_extract_all(replace(text, ' ', '  '), '(?i)(?:^|[^A-Z0-9])([A-Z0-9]{2}\.[A-Z0-9]{3}\.[A-Z0-9]{3}/[A-Z0-9]{4}-[0-9]{2}|[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}|[A-Z0-9]{12}[0-9]{2}|[0-9]{11})(?:[^A-Z0-9]|$)', 1), lambda x: regexp_replace(upper(x), '[./-]', '', 'g'))"
_NUM = r"list_transform(regexp_extract_all(replace(text, ' ', '  '), '(?:^|\D)({})(?:\D|$)', 1), lambda x: regexp_replace(x, '\D', '', 'g'))"
_NUMS = "list_concat(" + _NUM.format(r"\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}") + ", " + _NUM.format(r"\d{3}\.?\d{3}\.?\d{3}-?\d{2}") + ")"
_MONTHS = "['janeiro', 'fevereiro', 'marco', 'abril', 'maio', 'junho', 'julho', 'agosto', 'setembro', 'outubro', 'novembro', 'dezembro']"
_DATE = (
    r"(?i)(?:^|[^\p{L}\p{N}_/.-])([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}"
    r"|(?:aos\s+)?[0-9]{1,2}º?(?:\s+dias)?\s+(?:do\s+mês\s+)?de\s+(?:janeiro|fevereiro|mar[cç]o|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro)\s+de\s+[0-9]{4})(?:[^\p{L}\p{N}_/.-]|[/.-][^\p{L}\p{N}_]|[/.-]?$)"
)
_ISO = rf"""try_cast(CASE WHEN regexp_matches(raw, '^[0-9]{{4}}-') THEN raw
  WHEN regexp_matches(lower(raw), ' de ') THEN right(raw, 4) || '-' || lpad(list_position({_MONTHS}, regexp_extract(strip_accents(lower(raw)), '([a-z]{{4,}}) +de +[0-9]{{4}}$', 1))::VARCHAR, 2, '0') || '-' || lpad(regexp_extract(raw, '[0-9]{{1,2}}'), 2, '0')
  ELSE right(raw, 4) || '-' || lpad(regexp_extract(raw, '^[0-9]{{1,2}}[/.-]([0-9]{{1,2}})', 1), 2, '0') || '-' || lpad(regexp_extract(raw, '^[0-9]{{1,2}}'), 2, '0') END AS DATE)::VARCHAR"""
_WORDS = r"regexp_extract_all(strip_accents(lower(replace(text, 'ß', 'ss'))), '[\p{L}\p{N}]+')"
_FIRST = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
SQL = {
    "identifier_candidates": f"WITH {_T}, i AS (SELECT party_id, {_ID} AS d FROM t) SELECT party_id, array_to_string({_FIRST.format('d')}, ',') AS ids FROM i WHERE len(d) > 0",
    "numeric_identifiers": f"WITH {_T}, i AS (SELECT party_id, {_NUMS} AS d FROM t) SELECT party_id, array_to_string({_FIRST.format('d')}, ',') AS ids FROM i WHERE len(d) > 0",
    "text_dates": f"WITH b AS (SELECT block_id, unnest(regexp_extract_all(replace(text_raw, ' ', '  '), '{_DATE}', 1)) AS wide FROM blocks WHERE text_raw IS NOT NULL), r AS (SELECT block_id, replace(wide, '  ', ' ') AS raw FROM b) SELECT block_id, raw, {_ISO} AS date, count(*) AS n FROM r GROUP BY ALL",
    "token_aliases": f"""WITH {_T}, i AS (SELECT party_id, text, {_WORDS} AS w, {_ID} AS d FROM t), k AS (SELECT party_id, list_concat(w, list_transform({_FIRST.format('d')}, lambda x: 'identifier:' || lower(x)), ['date:2020-02-01']) AS tokens FROM i)
SELECT party_id, len(tokens) AS tokens, md5(array_to_string(tokens, ' ')) AS digest FROM k""",
    "query_plan": f"""WITH {_T}, i AS (SELECT party_id, list_concat({_ID}, CASE WHEN clean_identifier IS NULL THEN [] ELSE [clean_identifier] END) AS d FROM t)
SELECT party_id AS query_id, array_to_string({_FIRST.format('d')}, ',') AS party_ids, true AS every_party, 'linked_instruments' AS scope FROM i""",
    "legacy_prefilter": f"""WITH {_T}, q AS (SELECT party_id AS query_id, unnest({_NUMS}) AS identifier FROM t WHERE party_id % 50 = 0), m AS (SELECT DISTINCT query_id, doc_id AS id FROM q JOIN parties ON clean_identifier = identifier WHERE doc_id IS NOT NULL)
SELECT query_id, id, count(*) OVER (PARTITION BY query_id) = 1 AS direct FROM m""",
    "question_terms": f"""WITH t AS (SELECT item_id, {_WORDS} AS w FROM eval_passages), k AS (SELECT item_id, list_sort(list_distinct(list_filter(w, lambda x: length(x) >= 3 AND NOT regexp_matches(x, '[0-9]') AND x NOT IN ({", ".join(repr(x) for x in STOP_WORDS)})))) AS w FROM t)
SELECT item_id, array_to_string(w, ' ') AS terms FROM k""",
    "bm25_zero_rows": rf"""
WITH docs AS (SELECT doc_id AS id, {_WORDS} AS t FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL), corpus AS (SELECT count(*) AS n, avg(len(t)) AS mean_length FROM docs),
posts AS (SELECT id, len_t, token, count(*) AS tf FROM (SELECT id, len(t) AS len_t, unnest(t) AS token FROM docs) GROUP BY ALL),
idfs AS (SELECT token, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM posts, corpus GROUP BY token), floor_of AS (SELECT avg(idf) AS mean_idf FROM idfs),
asked AS (SELECT item_id AS query_id, token, count(*) AS times FROM (SELECT item_id, unnest({_WORDS}) AS token FROM eval_passages WHERE item_id % 50 = 0) GROUP BY ALL),
scores AS (SELECT query_id, id, round(sum(times * CASE WHEN idf < 0 THEN 0.25 * mean_idf ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len_t / mean_length))), 6) AS score FROM posts JOIN asked USING (token) JOIN idfs USING (token), corpus, floor_of GROUP BY ALL),
eligible AS (SELECT DISTINCT item_id AS query_id, doc_id AS id FROM documents, eval_passages WHERE item_id % 50 = 0 AND documents.lang = 'en' AND doc_id IS NOT NULL)
SELECT query_id, id, coalesce(score, 0)::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0) DESC, id) AS rank FROM eligible LEFT JOIN scores USING (query_id, id) QUALIFY rank <= 60""",
    "budget_slices": "SELECT DISTINCT chunk_id, true AS lossless, true AS fits FROM (SELECT DISTINCT chunk_id, verbatim_text FROM chunks WHERE verbatim_text IS NOT NULL)",
}

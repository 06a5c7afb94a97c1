"""Ranking, filters and set algebra over documents, embeddings and parties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.functions.text import fold, words
from acervo.operators.retrieval import bm25, divides, exact_nearest, reciprocal_rank_fusion, top_k
from acervo.session import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_passages").where("item_id % 50 = 0").select("item_id", "text")


def _scores(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return bm25(_docs(spark, sf_dir), "doc_id", "text", _queries(spark, sf_dir), "item_id", "text", **how)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_scores(spark, sf_dir), 10)


def bm25_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of all documents, filter after scoring."""
    return top_k(_scores(spark, sf_dir, eligible=F.col("lang") == "pt"), 10)


def bm25_subset_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the eligible documents alone."""
    return top_k(_scores(spark, sf_dir, eligible=F.col("lang") == "pt", stats="eligible"), 10)


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def knn_l2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _embeddings(spark, sf_dir)
    return exact_nearest(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 10)


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _embeddings(spark, sf_dir)
    return exact_nearest(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 10, metric="cosine")


def _term_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _queries(spark, sf_dir).select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(words(F.col("text")))).alias("token"))
    held = _docs(spark, sf_dir).where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(words(F.col("text")))).alias("token"))
    return held.join(asked, "token").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("score"))


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 and term overlap, 50 ranks each, fused."""
    return reciprocal_rank_fusion([top_k(_scores(spark, sf_dir), 50), top_k(_term_overlap(spark, sf_dir), 50)], 10)


def hybrid_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible documents ranked by BM25 and by the distance of their embedding (doc_id - 100000) to the query's (item_id - 9000), fused."""
    e = _embeddings(spark, sf_dir)
    asked = _queries(spark, sf_dir).select((F.col("item_id") - 9000).alias("vec_id")).join(e, "vec_id")
    eligible = _docs(spark, sf_dir).where("lang = 'pt'").select((F.col("doc_id") - 100000).alias("vec_id"))
    near = exact_nearest(e.join(eligible, "vec_id", "left_semi"), asked, "vec_id", "embedding", 50)
    dense = near.select((F.col("query_id") + 9000).alias("query_id"), (F.col("id") + 100000).alias("id"), "rank")
    return reciprocal_rank_fusion([top_k(_scores(spark, sf_dir, eligible=F.col("lang") == "pt"), 50), dense], 10)


def lexical_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = words(F.col("text"))
    return _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", tokens.alias("t")).select(
        "doc_id", F.size("t").alias("tokens"), F.size(F.array_distinct("t")).alias("distinct_tokens"), F.md5(F.array_join("t", " ")).alias("digest")
    )


def _content_terms(df: DataFrame, id_col: str) -> DataFrame:
    terms = df.where("text IS NOT NULL").select(F.col(id_col), F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    return terms.where("length(term) >= 3 AND NOT term RLIKE '[0-9]' AND term NOT IN ('que', 'para', 'com', 'por', 'los', 'las', 'the', 'and', 'des', 'les', 'una', 'del', 'che', 'non')")


def content_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many test items each content term is in."""
    return _content_terms(table(spark, sf_dir, "eval_passages"), "item_id").groupBy("term").agg(F.count(F.lit(1)).alias("items"))


def absent_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content terms of test items that no document has, neither exactly nor (five characters or more) by its first five."""
    asked = _content_terms(table(spark, sf_dir, "eval_passages"), "item_id")
    held = _docs(spark, sf_dir).where("text IS NOT NULL").select(F.explode(words(F.col("text"))).alias("term")).distinct()
    prefixes = held.where("length(term) >= 5").select(F.substring("term", 1, 5).alias("prefix")).distinct()
    missing = asked.join(held, "term", "left_anti").withColumn("prefix", F.when(F.length("term") >= 5, F.substring("term", 1, 5)))
    return missing.join(prefixes, "prefix", "left_anti").select("item_id", "term")


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "parties").select("doc_id", F.lower(F.trim("role")).alias("role"))


def party_division_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divides(_roles(spark, sf_dir), "doc_id", "role", ["locador", "comprador"])


def party_division_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divides(_roles(spark, sf_dir), "doc_id", "role", ["locador", "comprador"], every=False)


def instrument_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union within the party filter, but always AND with the instruments asked for."""
    asked = table(spark, sf_dir, "contract_metadata").where("instrument_type = 'Distrato'").select("doc_id")
    return party_division_any(spark, sf_dir).join(asked, "doc_id", "left_semi")


def modifier_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that change others, with the other documents of the same parties: exploded identifiers, equi join, sets."""
    kinds = table(spark, sf_dir, "contract_metadata").groupBy("doc_id").agg(F.min("instrument_type").alias("kind"))
    ids = table(spark, sf_dir, "parties").where("NOT is_law_firm AND length(clean_identifier) IN (11, 14) AND NOT clean_identifier RLIKE '^(.)\\\\1+$'").select("doc_id", "clean_identifier").distinct()
    known = ids.join(kinds, "doc_id")
    changing = known.where("kind IN ('Termo Aditivo', 'Distrato')").select(F.col("doc_id").alias("modifier"), "clean_identifier")
    others = known.where("kind NOT IN ('Termo Aditivo', 'Distrato')").select("doc_id", "clean_identifier")
    return changing.join(others, "clean_identifier").groupBy("modifier").agg(F.array_join(F.array_sort(F.collect_set("doc_id")).cast("array<string>"), ",").alias("bases"))


def placeholder_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = fold(F.col("text_raw"))
    return table(spark, sf_dir, "blocks").where("text_raw IS NOT NULL").groupBy("doc_id").agg(
        F.count_if(text.rlike(r"_{2,}|x{3,}|\[[^\]]*\]|a preencher")).alias("placeholders"), F.count_if(text.rlike(r"ignore (all|previous)|system prompt")).alias("injections"), F.count(F.lit(1)).alias("block_rows")
    )


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_filtered_topk, bm25_subset_topk, knn_l2_topk, cosine_topk, rrf_fusion, hybrid_filtered, lexical_tokens, content_terms, absent_terms, party_division_all, party_division_any, instrument_clamp, modifier_bases, placeholder_flags)}

_TOKENS = r"regexp_extract_all(strip_accents(lower(replace(text, 'ß', 'ss'))), '[\p{L}\p{N}]+')"


def _bm25(stats: str, eligible: str) -> str:
    return f"""
WITH docs AS (SELECT doc_id AS id, lang, {_TOKENS} AS t FROM documents WHERE text IS NOT NULL AND {stats}),
corpus AS (SELECT count(*) AS n, avg(len(t)) AS mean_length FROM docs),
posts AS (SELECT id, lang, len_t, token, count(*) AS tf FROM (SELECT id, lang, len(t) AS len_t, unnest(t) AS token FROM docs) GROUP BY ALL),
idfs AS (SELECT token, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM posts, corpus GROUP BY token),
floor_of AS (SELECT avg(idf) AS mean_idf FROM idfs),
asked AS (SELECT item_id AS query_id, token, count(*) AS times FROM (SELECT item_id, unnest({_TOKENS}) AS token FROM eval_passages WHERE item_id % 50 = 0) GROUP BY ALL),
scores AS (
  SELECT query_id, id, round(sum(times * CASE WHEN idf < 0 THEN 0.25 * mean_idf ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len_t / mean_length))), 6) AS score
  FROM posts JOIN asked USING (token) JOIN idfs USING (token), corpus, floor_of WHERE {eligible} GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scores)"""


_TOP = " SELECT query_id, id, score, rank FROM ranked WHERE rank <= 10"
_NEAR = """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id % 50 = 0),
near AS (SELECT query_id, vec_id AS id, {score} AS score FROM q, embeddings WHERE vec_id <> query_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {way}, id) AS rank FROM near)"""
_TERMS = rf"""
WITH terms AS (SELECT DISTINCT item_id, unnest({_TOKENS}) AS term FROM eval_passages),
content AS (SELECT * FROM terms WHERE length(term) >= 3 AND NOT regexp_matches(term, '[0-9]') AND term NOT IN ('que', 'para', 'com', 'por', 'los', 'las', 'the', 'and', 'des', 'les', 'una', 'del', 'che', 'non'))"""
_PARTY = "SELECT DISTINCT doc_id FROM parties WHERE lower(trim(role)) IN ('locador', 'comprador') AND doc_id IS NOT NULL"
SQL = {
    "bm25_topk": _bm25("true", "true") + _TOP,
    "bm25_filtered_topk": _bm25("true", "lang = 'pt'") + _TOP,
    "bm25_subset_topk": _bm25("lang = 'pt'", "true") + _TOP,
    "knn_l2_topk": _NEAR.format(score="round(list_sum(list_transform(list_zip(x, embedding::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6)", way="") + _TOP,
    "cosine_topk": _NEAR.format(score="round(list_cosine_similarity(x, embedding::DOUBLE[]), 6)", way="DESC") + _TOP,
    "rrf_fusion": _bm25("true", "true")
    + """, overlap AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, id) AS rank FROM (SELECT DISTINCT id, token FROM posts) JOIN asked USING (token) GROUP BY query_id, id),
fused AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, id, rank FROM ranked WHERE rank <= 50 UNION ALL SELECT query_id, id, rank FROM overlap WHERE rank <= 50) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fused) WHERE rank <= 10""",
    "hybrid_filtered": _bm25("true", "lang = 'pt'")
    + """, dense AS (
  SELECT a.vec_id + 9000 AS query_id, b.vec_id + 100000 AS id, round(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS score
  FROM embeddings a JOIN eval_passages e ON e.item_id - 9000 = a.vec_id AND e.item_id % 50 = 0, embeddings b JOIN documents d ON d.doc_id - 100000 = b.vec_id AND d.lang = 'pt' WHERE a.vec_id <> b.vec_id),
dense_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank FROM dense),
fused AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, id, rank FROM ranked WHERE rank <= 50 UNION ALL SELECT query_id, id, rank FROM dense_ranked WHERE rank <= 50) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fused) WHERE rank <= 10""",
    "lexical_tokens": f"SELECT doc_id, len(t) AS tokens, len(list_distinct(t)) AS distinct_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_TOKENS} AS t FROM documents WHERE text IS NOT NULL)",
    "content_terms": _TERMS + " SELECT term, count(*) AS items FROM content GROUP BY term",
    "absent_terms": _TERMS + f""", held AS (SELECT DISTINCT unnest({_TOKENS}) AS term FROM documents WHERE text IS NOT NULL)
SELECT item_id, term FROM content c WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.term = c.term)
  AND NOT (length(term) >= 5 AND EXISTS (SELECT 1 FROM held h WHERE length(h.term) >= 5 AND left(h.term, 5) = left(c.term, 5)))""",
    "party_division_all": "SELECT doc_id FROM parties WHERE lower(trim(role)) IN ('locador', 'comprador') AND doc_id IS NOT NULL GROUP BY doc_id HAVING count(DISTINCT lower(trim(role))) = 2",
    "party_division_any": _PARTY,
    "instrument_clamp": f"SELECT doc_id FROM ({_PARTY}) WHERE doc_id IN (SELECT doc_id FROM contract_metadata WHERE instrument_type = 'Distrato')",
    "modifier_bases": """
WITH kinds AS (SELECT doc_id, min(instrument_type) AS kind FROM contract_metadata GROUP BY 1),
known AS (SELECT DISTINCT doc_id, clean_identifier, kind FROM parties JOIN kinds USING (doc_id) WHERE NOT is_law_firm AND length(clean_identifier) IN (11, 14) AND replace(clean_identifier, left(clean_identifier, 1), '') <> ''),
pairs AS (SELECT DISTINCT a.doc_id AS modifier, b.doc_id AS base FROM known a JOIN known b USING (clean_identifier) WHERE a.kind IN ('Termo Aditivo', 'Distrato') AND b.kind NOT IN ('Termo Aditivo', 'Distrato'))
SELECT modifier, string_agg(base::VARCHAR, ',' ORDER BY base) AS bases FROM pairs GROUP BY 1""",
    "placeholder_flags": r"""
SELECT doc_id, count(*) FILTER (regexp_matches(strip_accents(lower(text_raw)), '_{2,}|x{3,}|\[[^\]]*\]|a preencher')) AS placeholders,
  count(*) FILTER (regexp_matches(strip_accents(lower(text_raw)), 'ignore (all|previous)|system prompt')) AS injections, count(*) AS block_rows
FROM blocks WHERE text_raw IS NOT NULL GROUP BY doc_id""",
}

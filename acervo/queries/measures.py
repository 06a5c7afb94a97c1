"""Aggregates, percentiles, agreement, scalar functions, windows over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acervo.functions.embed import hash_embedder, with_cached
from acervo.functions.scalars import canonical_identifier, guarded, iso_dates, party_key, redacted, roman, summary, unguarded, without_controls
from acervo.functions.text import strip_accents, word_ngrams, words
from acervo.operators.measures import agreement, micro_recall, percentiles
from acervo.session import table
from acervo.streaming.windows import anchored_windows, sessions, tumbling


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles(_events(spark, sf_dir), "event_type", "value", 0.95)


def status_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("most"), F.count_if(F.col("value") > 80).alias("high"))


def latest_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event count with the value of the latest purchase."""
    e = _events(spark, sf_dir)
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.when(F.col("event_type") == "purchase", F.col("value")), F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("latest"))


def feedback_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.where("event_type = 'view'").join(e.where("event_type = 'purchase' AND value > 90").select("user_id"), "user_id", "left_semi").select("event_id", "user_id")


def agreement_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the class of a record is the type that was read from its text."""
    c = table(spark, sf_dir, "curation").select(F.col("mfiles_id").alias("doc_id"), "class_name", "decision")
    m = table(spark, sf_dir, "contract_metadata").groupBy("doc_id").agg(F.min("instrument_type").alias("kind"))
    return c.join(m, "doc_id").groupBy("decision").agg(agreement(F.col("class_name"), F.col("kind")).alias("rate"), F.count(F.lit(1)).alias("n"))


def recall_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the content words of each split's items, how many the documents of each language hold."""
    e = table(spark, sf_dir, "eval_passages").select("split", F.explode_outer(F.array_distinct(words(F.col("text")))).alias("w"))
    d = table(spark, sf_dir, "documents").where("lang IN ('pt', 'es', 'en')").select("lang", F.explode(words(F.col("text"))).alias("w"))
    return micro_recall(e, d, "split", "w", "lang")


def token_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of chunks by profile: median, 95th percentile, most, and how many are above the limit."""
    p = table(spark, sf_dir, "encoder_profiles").select("profile_id", "max_input_tokens")
    n = F.size(F.regexp_extract_all(F.col("verbatim_text"), F.lit(r"[^ \t\r\n]+"), F.lit(0)))
    c = table(spark, sf_dir, "chunks").where("verbatim_text IS NOT NULL").select("profile_id", n.alias("tokens")).join(F.broadcast(p), "profile_id")
    over = c.groupBy("profile_id").agg(F.max("tokens").alias("most"), F.count_if(F.col("tokens") > F.col("max_input_tokens")).alias("above"))
    mid = percentiles(c, "profile_id", "tokens", 0.5).select("profile_id", F.col("nearest_rank").alias("p50"))
    high = percentiles(c, "profile_id", "tokens", 0.95).select("profile_id", "n", F.col("nearest_rank").alias("p95"))
    return over.join(mid, "profile_id").join(high, "profile_id")


def identifier_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "parties").select("party_id", canonical_identifier(F.col("raw_identifier")).alias("identifier"), party_key(F.col("name")).alias("name_key"))


def pii_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "parties").select("party_id", redacted(F.concat_ws(", ", "name", "raw_identifier")).alias("text"))


def control_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5(without_controls(F.concat(F.lit("\x01 "), F.col("text"), F.lit("\r\n")))).alias("digest"))


def csv_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells guarded, and that taking the guard off gives them back."""
    cells = table(spark, sf_dir, "curation").where("title IS NOT NULL").select("row_id", F.when(F.col("decision") == "include", F.concat(F.lit("="), F.col("title"))).otherwise(F.col("title")).alias("cell"))
    return cells.select("row_id", guarded(F.col("cell")).alias("guarded"), (unguarded(guarded(F.col("cell"))) == F.col("cell")).alias("same"))


def date_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "blocks").where("text_raw IS NOT NULL").select("block_id", iso_dates(F.col("text_raw")).alias("dates"))
    return found.where(F.size("dates") > 0).select("block_id", F.array_join("dates", ",").alias("dates")).distinct()


def object_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", summary(F.col("text")).alias("summary"))


def roman_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 5000).cast("int").alias("number")).distinct().select("number", roman(F.col("number")).alias("numeral"))


def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", word_ngrams(words(F.col("text")), 5).alias("g"))
    return grams.select("doc_id", F.size("g").alias("shingles"), F.md5(F.array_join(F.array_sort("g"), "|")).alias("digest"))


def accent_stripping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5(strip_accents(F.col("text"))).alias("digest"))


def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").select("chunk_id", hash_embedder(48)(F.col("verbatim_text")).alias("vector"))


def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices against a cache that holds the chunks: hits and misses."""
    chunks = table(spark, sf_dir, "chunks").where("verbatim_text IS NOT NULL")
    cache = chunks.groupBy(F.sha2("verbatim_text", 256).alias("key")).agg(F.first("verbatim_text").alias("t")).select("key", hash_embedder(48)(F.col("t")).alias("vector"))
    slices = table(spark, sf_dir, "candidate_slices").select("slice_id", "text")
    return with_cached(slices, "text", cache, hash_embedder(48)).groupBy("hit").agg(F.count(F.lit(1)).alias("n"))


def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumbling(_events(spark, sf_dir), "1 hour")


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(_events(spark, sf_dir), "30 minutes")


def rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of an hour that each begin with a user's first event after the last one, and what is beyond 3 in each."""
    return anchored_windows(_events(spark, sf_dir), 3600, 3)


def trace_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest 500 events."""
    return _events(spark, sf_dir).orderBy(F.col("event_id").desc()).limit(500).select("event_id", "user_id", "event_type")


def rolling_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running mean of each user's last ten values."""
    line = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-9, 0)
    return _events(spark, sf_dir).select("event_id", F.round(F.avg("value").over(line), 6).alias("mean"), F.count(F.lit(1)).over(line).alias("n"))


QUERIES = {f.__name__: f for f in (latency_percentiles, status_stats, latest_rating, feedback_exists, agreement_rates, recall_coverage, token_inventory, identifier_normalize, pii_redact, control_clean, csv_guard, date_candidates, object_summary, roman_numerals, shingle_counts, accent_stripping, hash_embedding, embedding_cache, tumbling_windows, session_windows, rate_windows, trace_latest, rolling_values)}

_W = r"regexp_extract_all(strip_accents(lower(replace(text, 'ß', 'ss'))), '[\p{L}\p{N}]+')"
_PCT = "list_sort(list(v))"


def _percentile(group: str, value: str, source: str, q: float) -> str:
    return f"""SELECT {group}, len(s) AS n, s[(round_even({q} * (len(s) - 1), 0) + 1)::INT] AS rounded_index, s[(greatest(0, floor(len(s) * {q} + 0.999999) - 1) + 1)::INT] AS ceiling_index,
  s[greatest(1, ceil({q} * len(s)))::INT] AS nearest_rank, s[(len(s) // 2 + 1)::INT] AS upper_middle FROM (SELECT {group}, list_sort(list({value})) AS s FROM {source} WHERE {value} IS NOT NULL GROUP BY 1)"""


SQL = {
    "latency_percentiles": _percentile("event_type", "value", "events", 0.95),
    "status_stats": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS most, count(*) FILTER (value > 80) AS high FROM events GROUP BY 1",
    "latest_rating": "SELECT user_id, count(*) AS n, (SELECT value FROM events b WHERE b.user_id IS NOT DISTINCT FROM a.user_id AND b.event_type = 'purchase' ORDER BY b.event_id DESC LIMIT 1) AS latest FROM events a GROUP BY user_id",
    "feedback_exists": "SELECT event_id, user_id FROM events a WHERE event_type = 'view' AND EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.value > 90)",
    "agreement_rates": """WITH m AS (SELECT doc_id, min(instrument_type) AS kind FROM contract_metadata GROUP BY 1)
SELECT decision, round(avg(CASE WHEN class_name IS NOT NULL AND kind IS NOT NULL THEN (class_name = kind)::INT::DOUBLE END), 4) AS rate, count(*) AS n FROM curation JOIN m ON doc_id = mfiles_id GROUP BY 1""",
    "recall_coverage": f"""WITH e AS (SELECT item_id, split, unnest(list_distinct({_W})) AS w FROM eval_passages), d AS (SELECT DISTINCT lang, unnest({_W}) AS w FROM documents WHERE lang IN ('pt', 'es', 'en')),
l AS (SELECT DISTINCT lang FROM d) SELECT split, l.lang, round(count(d.w)::DOUBLE / count(*), 6) AS recall FROM e CROSS JOIN l LEFT JOIN d ON d.lang = l.lang AND d.w = e.w GROUP BY 1, 2""",
    "token_inventory": r"""WITH c AS (SELECT profile_id, len(list_filter(regexp_split_to_array(verbatim_text, '[ \t\r\n]+'), lambda x: x <> '')) AS tokens, max_input_tokens FROM chunks JOIN encoder_profiles USING (profile_id) WHERE verbatim_text IS NOT NULL),
s AS (SELECT profile_id, list_sort(list(tokens)) AS s, max(tokens) AS most, count(*) FILTER (tokens > max_input_tokens) AS above, count(*) AS n FROM c GROUP BY 1)
SELECT profile_id, most, above, n, s[ceil(0.5 * n)::INT] AS p50, s[ceil(0.95 * n)::INT] AS p95 FROM s""",
    "identifier_normalize": r"""WITH k AS (SELECT party_id, name, regexp_replace(upper(regexp_replace(raw_identifier, '(?i)^[^\p{L}\p{N}_]*(cpf|cnpj)([^\p{L}\p{N}_]*n[º°o]\.?)?[^\p{L}\p{N}_]+', '')), '[^0-9A-Z]', '', 'g') AS core FROM parties)
SELECT party_id, CASE WHEN length(core) IN (11, 14) THEN core END AS identifier, trim(regexp_replace(strip_accents(lower(replace(name, 'ß', 'ss'))), '[^\p{L}\p{N}]+', ' ', 'g')) AS name_key FROM k""",
    "pii_redact": r"""WITH d AS (SELECT party_id, replace(concat_ws(', ', name, raw_identifier), ' ', '  ') AS t FROM parties), c AS (SELECT party_id, regexp_replace(t, '(^|[^0-9A-Za-z])[0-9A-Z]{2}\.?[0-9A-Z]{3}\.?[0-9A-Z]{3}/?[0-9A-Z]{4}-?\d{2}([^0-9A-Za-z]|$)', '\1[CNPJ]\2', 'g') AS t FROM d)
SELECT party_id, replace(regexp_replace(t, '(^|[^0-9A-Za-z])\d{3}\.?\d{3}\.?\d{3}-?\d{2}([^0-9A-Za-z]|$)', '\1[CPF]\2', 'g'), '  ', ' ') AS text FROM c""",
    "control_clean": r"SELECT doc_id, md5(trim(regexp_replace(replace(chr(1) || ' ' || text || chr(13) || chr(10), chr(13) || chr(10), chr(10)), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), ' ')) AS digest FROM documents WHERE text IS NOT NULL",
    "csv_guard": r"""WITH k AS (SELECT row_id, CASE WHEN decision = 'include' THEN '=' || title ELSE title END AS cell FROM curation WHERE title IS NOT NULL)
SELECT row_id, CASE WHEN regexp_matches(cell, '^\s*[=+\-@\t\r]') THEN '''' || cell ELSE cell END AS guarded, true AS same FROM k""",
    "date_candidates": r"""WITH f AS (SELECT DISTINCT block_id, text_raw, regexp_extract_all(regexp_replace(text_raw, '(\d{2}/\d{2}/\d{4}|\d{4}-\d{2}-\d{2})', '~\1~', 'g'), '(?:^|[^0-9])~(\d{2}/\d{2}/\d{4}|\d{4}-\d{2}-\d{2})~(?:[^0-9]|$)', 1) AS d FROM blocks WHERE text_raw IS NOT NULL),
u AS (SELECT block_id, list_transform(d, lambda x: try_cast(CASE WHEN contains(x, '/') THEN x[7:10] || '-' || x[4:5] || '-' || x[1:2] ELSE x END AS DATE)::VARCHAR) AS d FROM f),
n AS (SELECT block_id, list_filter(d, lambda x: x IS NOT NULL) AS d FROM u),
k AS (SELECT block_id, list_filter(d, lambda x, i: list_position(d, x) = i) AS d FROM n) SELECT DISTINCT block_id, array_to_string(d, ',') AS dates FROM k WHERE len(d) > 0""",
    "object_summary": r"""WITH k AS (SELECT doc_id, trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) AS line FROM documents WHERE text IS NOT NULL), h AS (SELECT *, left(line, 250) AS head, regexp_extract(left(line, 250), '(?s)^(.{180,})\s\S*$', 1) AS cut FROM k)
SELECT doc_id, CASE WHEN length(line) <= 250 THEN line ELSE CASE WHEN cut <> '' THEN cut ELSE head END || '…' END AS summary FROM h""",
    "roman_numerals": """WITH n AS (SELECT DISTINCT (o_orderkey % 5000)::INT AS number FROM orders)
SELECT number, CASE WHEN number BETWEEN 1 AND 3999 THEN ['', 'M', 'MM', 'MMM'][number // 1000 + 1] || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][number // 100 % 10 + 1]
  || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][number // 10 % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][number % 10 + 1] END AS numeral FROM n""",
    "shingle_counts": f"""WITH k AS (SELECT doc_id, {_W} AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS g FROM k)
SELECT doc_id, len(g) AS shingles, md5(array_to_string(list_sort(g), '|')) AS digest FROM g""",
    "accent_stripping": "SELECT doc_id, md5(strip_accents(text)) AS digest FROM documents WHERE text IS NOT NULL",
    "embedding_cache": "SELECT CASE WHEN text IS NULL THEN NULL ELSE text IN (SELECT verbatim_text FROM chunks WHERE verbatim_text IS NOT NULL) END AS hit, count(*) AS n FROM candidate_slices GROUP BY 1",
    "tumbling_windows": "SELECT event_type, date_trunc('hour', ts) AS window_start, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
    "session_windows": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k""",
    "trace_latest": "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 500",
    "rolling_values": "SELECT event_id, round(avg(value) OVER w, 6) AS mean, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)",
}

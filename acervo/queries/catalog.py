"""Projections, searches, matches and texts over the vault's catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acervo.functions.grammar import with_references
from acervo.functions.text import fold, word_ngrams, words
from acervo.operators.curation import twins
from acervo.session import table


def staged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source ids taken apart, with the reason why one would be skipped."""
    p = r"^doc:(\d+):v(\d+):file:(\d+)$"
    s = table(spark, sf_dir, "chunks").select("source_id").distinct()
    part = lambda i: F.regexp_extract("source_id", p, i).try_cast("long")
    reason = F.when(F.col("source_id").isNull(), "no_source").when(~F.col("source_id").rlike(p), "bad_name")
    return s.select("source_id", part(1).alias("doc_id"), part(2).alias("version"), part(3).alias("file_id"), reason.alias("skipped"))


def catalog_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first unit of each instrument, in the order of the instruments' numbers."""
    c = table(spark, sf_dir, "chunks").where("instrument_id IS NOT NULL")
    first = c.groupBy("instrument_id").agg(F.min_by("unit_id", F.struct("unit_start", "unit_id")).alias("unit_id"), F.count_distinct("unit_id").alias("units"))
    return first.orderBy(F.split("instrument_id", ":")[1].try_cast("long"), "instrument_id")


def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose folded title or client holds a word, or that bear an id; the first 300 by id (the feature is a page)."""
    c = table(spark, sf_dir, "curation").where("mfiles_id IS NOT NULL")
    hit = fold(F.col("title")).contains("locacao") | fold(F.col("cliente")).contains("locacao") | (F.col("mfiles_id") == 100010)
    return c.where(hit).select("mfiles_id").distinct().orderBy("mfiles_id").limit(300)


def thematic_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items with the number of their rare words (in one document in a hundred at most) that some document of their wording holds."""
    asked = table(spark, sf_dir, "eval_passages").select("item_id", F.explode(F.array_distinct(words(F.col("text")))).alias("w"))
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    n = docs.agg((F.count(F.lit(1)) / 100).alias("most"))
    df = docs.select(F.explode(F.array_distinct(words(F.col("text")))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    rare = df.crossJoin(F.broadcast(n)).where("df <= most").select("w", F.lit(1).alias("there"))
    return asked.join(rare, "w", "left").groupBy("item_id").agg(F.count("there").alias("rare_words")).withColumn("action", F.when(F.col("rare_words") > 0, "answer").otherwise("abstain"))


def expectation_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records against extractions, one expected each: missing, unexpected, repeated or as expected."""
    want = table(spark, sf_dir, "curation").where("mfiles_id IS NOT NULL").select(F.col("mfiles_id").alias("doc_id")).distinct().withColumn("wanted", F.lit(1))
    got = table(spark, sf_dir, "contract_metadata").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    finding = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("n") > 1, "repeated").otherwise("expected")
    return want.join(got, "doc_id", "full_outer").groupBy(finding.alias("finding")).agg(F.count(F.lit(1)).alias("n"))


def repeated_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions mapped to the first one at the same place (document, block, start, end)."""
    m = table(spark, sf_dir, "temporal_mentions")
    place = ["doc_id", "block_id", "start_pos", "end_pos"]
    first = m.groupBy(*place).agg(F.min("mention_id").alias("first_id"))
    return m.select("mention_id", *place).join(first, place).where("mention_id <> first_id").select("mention_id", "first_id")


def heads_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest a user over the latest event of each type, in the order of the types."""
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL AND event_type IS NOT NULL")
    heads = e.groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_type", "event_id"))), lambda x: F.concat(x["event_type"], F.lit(":"), x["event_id"].cast("string"))), ",")
    return heads.groupBy("user_id").agg(F.sha2(line, 256).alias("digest"))


def party_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parties of each document in order, as one line: A, B e C."""
    p = table(spark, sf_dir, "parties").where("doc_id IS NOT NULL AND name IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("party_no", "party_id", "name"))).alias("p"))
    names = p.select("doc_id", F.transform("p", lambda x: x["name"]).alias("n"))
    head = F.array_join(F.slice("n", 1, F.greatest(F.size("n") - 1, F.lit(0))), ", ")
    return names.select("doc_id", F.when(F.size("n") == 1, F.col("n")[0]).otherwise(F.concat(head, F.lit(" e "), F.element_at("n", -1))).alias("line"))


def client_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a record's client is among the parties of its document: all words of the client's name in one party's name."""
    c = table(spark, sf_dir, "curation").where("mfiles_id IS NOT NULL AND cliente LIKE '% - %'")
    wanted = c.select("row_id", F.col("mfiles_id").alias("doc_id"), words(F.regexp_extract("cliente", r"^\S+ - (.+)$", 1)).alias("w"))
    held = table(spark, sf_dir, "parties").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.collect_set("name").alias("names"))
    parties = held.select("doc_id", F.transform("names", lambda x: words(x)).alias("names"))
    found = F.coalesce(F.exists("names", lambda n: F.size(F.array_except("w", n)) == 0), F.lit(False))
    return wanted.join(parties, "doc_id", "left").select("row_id", found.alias("matched"))


def numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of clauses, and of paragraphs and items within them, counted anew under each clause."""
    from acervo.operators.blocks import current_blocks

    b = current_blocks(table(spark, sf_dir, "blocks")).where("doc_id IS NOT NULL").withColumn("kind", F.lower("block_type"))
    line = Window.partitionBy("doc_id").orderBy("order_index", "block_id").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("clause_no", F.sum(F.when(F.col("kind") == "clause", 1).otherwise(0)).over(line))
    inner = Window.partitionBy("doc_id", "clause_no", "kind").orderBy("order_index", "block_id")
    number = F.when(F.col("kind") == "clause", F.col("clause_no").cast("string")).otherwise(F.concat_ws(".", "clause_no", F.row_number().over(inner)))
    return b.withColumn("number", number).where("kind IN ('clause', 'paragraph', 'item')").select("block_id", "number")


def chunk_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different chunks of one instrument of like length and with a Jaccard similarity of at least 0.8."""
    c = table(spark, sf_dir, "chunks").where("verbatim_text IS NOT NULL AND instrument_id IS NOT NULL").select("chunk_id", "instrument_id", "verbatim_text").dropDuplicates(["chunk_id"])
    s = c.select(F.col("chunk_id").alias("id"), F.col("instrument_id").alias("scope"), F.length("verbatim_text").alias("n"), word_ngrams(words(F.col("verbatim_text")), 5).alias("grams"))
    met = twins(s, 0.8).where("least(n_a, n_b) >= 0.7 * greatest(n_a, n_b)")
    return met.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"), "similarity")


def trace_filter(spark: SparkSession, sf_dir: str, event_type: str | None = "purchase", least: float | None = 50, user_id: int | None = None) -> DataFrame:
    """Events by whichever conditions are given."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    for condition in (None if event_type is None else F.col("event_type") == event_type, None if least is None else F.col("value") >= least, None if user_id is None else F.col("user_id") == user_id):
        e = e if condition is None else e.where(condition)
    return e


def canonical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each profile as JSON with sorted names."""
    p = table(spark, sf_dir, "encoder_profiles")
    return p.select("profile_id", F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(p.columns)])), 256).alias("digest"))


def all_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of every kind in the blocks, with offsets, lists and ranges."""
    return with_references(table(spark, sf_dir, "blocks").select("block_id", "text_raw").distinct(), "block_id", "text_raw")


QUERIES = {f.__name__: f for f in (staged_sources, catalog_projection, catalog_search, thematic_test, expectation_matches, repeated_mentions, heads_digest, party_lines, client_matches, numbering, chunk_twins, trace_filter, canonical_rows, all_references)}

_B = "b AS (SELECT * FROM blocks WHERE block_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY ingested_at DESC NULLS LAST, text_search NULLS LAST, hierarchy_level) = 1)"
_F = "strip_accents(lower(replace({x}, 'ß', 'ss')))"
_WORDS = r"regexp_extract_all(strip_accents(lower(replace({x}, 'ß', 'ss'))), '[\p{{L}}\p{{N}}]+')"
_CLIENT = r"regexp_extract(cliente, '^\S+ - (.+)$', 1)"
SQL = {
    "staged_sources": r"""SELECT DISTINCT source_id, try_cast(regexp_extract(source_id, '^doc:(\d+):v(\d+):file:(\d+)$', 1) AS BIGINT) AS doc_id, try_cast(regexp_extract(source_id, '^doc:(\d+):v(\d+):file:(\d+)$', 2) AS BIGINT) AS version,
  try_cast(regexp_extract(source_id, '^doc:(\d+):v(\d+):file:(\d+)$', 3) AS BIGINT) AS file_id, CASE WHEN source_id IS NULL THEN 'no_source' WHEN NOT regexp_matches(source_id, '^doc:(\d+):v(\d+):file:(\d+)$') THEN 'bad_name' END AS skipped FROM chunks""",
    "catalog_projection": "SELECT instrument_id, arg_min(unit_id, {'a': unit_start, 'b': unit_id}) AS unit_id, count(DISTINCT unit_id) AS units FROM chunks WHERE instrument_id IS NOT NULL GROUP BY 1",
    "catalog_search": f"SELECT DISTINCT mfiles_id FROM curation WHERE mfiles_id IS NOT NULL AND (contains({_F.format(x='title')}, 'locacao') OR contains({_F.format(x='cliente')}, 'locacao') OR mfiles_id = 100010) ORDER BY 1 LIMIT 300",
    "thematic_test": f"""WITH a AS (SELECT DISTINCT item_id, unnest({_WORDS.format(x='text')}) AS w FROM eval_passages), d AS (SELECT doc_id, unnest(list_distinct({_WORDS.format(x='text')})) AS w FROM documents WHERE text IS NOT NULL),
r AS (SELECT w FROM d GROUP BY w HAVING count(*) <= (SELECT count(*) / 100 FROM documents WHERE text IS NOT NULL))
SELECT item_id, count(r.w) AS rare_words, CASE WHEN count(r.w) > 0 THEN 'answer' ELSE 'abstain' END AS action FROM a LEFT JOIN r USING (w) GROUP BY 1""",
    "expectation_matches": """WITH w AS (SELECT DISTINCT mfiles_id AS doc_id, 1 AS wanted FROM curation WHERE mfiles_id IS NOT NULL), g AS (SELECT doc_id, count(*) AS c FROM contract_metadata WHERE doc_id IS NOT NULL GROUP BY 1)
SELECT CASE WHEN c IS NULL THEN 'missing' WHEN wanted IS NULL THEN 'unexpected' WHEN c > 1 THEN 'repeated' ELSE 'expected' END AS finding, count(*) AS n FROM w FULL JOIN g USING (doc_id) GROUP BY 1""",
    "repeated_mentions": "SELECT mention_id, first_id FROM (SELECT mention_id, min(mention_id) OVER (PARTITION BY doc_id, block_id, start_pos, end_pos) AS first_id FROM temporal_mentions WHERE doc_id IS NOT NULL AND block_id IS NOT NULL AND start_pos IS NOT NULL AND end_pos IS NOT NULL) WHERE mention_id <> first_id",
    "heads_digest": """WITH h AS (SELECT user_id, event_type, max(event_id) AS e FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2)
SELECT user_id, sha256(string_agg(event_type || ':' || e, ',' ORDER BY event_type)) AS digest FROM h GROUP BY 1""",
    "party_lines": """WITH k AS (SELECT doc_id, list(name ORDER BY party_no, party_id) AS n FROM parties WHERE doc_id IS NOT NULL AND name IS NOT NULL GROUP BY 1)
SELECT doc_id, CASE WHEN len(n) = 1 THEN n[1] ELSE array_to_string(n[1:len(n) - 1], ', ') || ' e ' || n[len(n)] END AS line FROM k""",
    "client_matches": rf"""WITH c AS (SELECT row_id, mfiles_id AS doc_id, {_WORDS.format(x=_CLIENT)} AS w FROM curation WHERE mfiles_id IS NOT NULL AND cliente LIKE '% - %'),
p AS (SELECT doc_id, {_WORDS.format(x='name')} AS n FROM parties WHERE doc_id IS NOT NULL)
SELECT row_id, coalesce(bool_or(list_has_all(n, w)), false) AS matched FROM c LEFT JOIN p USING (doc_id) GROUP BY row_id""",
    "numbering": f"""WITH {_B}, c AS (SELECT *, lower(block_type) AS kind, sum((lower(block_type) = 'clause')::INT) OVER (PARTITION BY doc_id ORDER BY order_index, block_id ROWS UNBOUNDED PRECEDING) AS clause_no FROM b WHERE doc_id IS NOT NULL),
n AS (SELECT block_id, kind, clause_no, row_number() OVER (PARTITION BY doc_id, clause_no, kind ORDER BY order_index, block_id) AS k FROM c)
SELECT block_id, CASE WHEN kind = 'clause' THEN clause_no::VARCHAR ELSE clause_no || '.' || k END AS number FROM n WHERE kind IN ('clause', 'paragraph', 'item')""",
    "chunk_twins": f"""WITH c AS (SELECT DISTINCT ON (chunk_id) chunk_id, instrument_id, length(verbatim_text) AS n, {_WORDS.format(x='verbatim_text')} AS w FROM chunks WHERE verbatim_text IS NOT NULL AND instrument_id IS NOT NULL),
s AS (SELECT chunk_id, instrument_id, n, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS g FROM c),
m AS (SELECT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b, len(list_intersect(a.g, b.g)) AS k, len(a.g) + len(b.g) AS t FROM s a JOIN s b ON a.instrument_id = b.instrument_id AND a.chunk_id < b.chunk_id AND least(a.n, b.n) >= 0.7 * greatest(a.n, b.n))
SELECT chunk_id_a, chunk_id_b, round(k / (t - k)::DOUBLE, 6) AS similarity FROM m WHERE t > k AND round(k / (t - k)::DOUBLE, 6) >= 0.8""",
    "trace_filter": "SELECT event_id, user_id, event_type, value FROM events WHERE event_type = 'purchase' AND value >= 50",
}

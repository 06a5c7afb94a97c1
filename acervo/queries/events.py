"""Events of dates in blocks, and scalars over names, titles and times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.functions.scalars import company_key, iso_seconds, letter_number, masked_properties, role_of, safe_code, split_parties
from acervo.functions.temporal import execution_dates, with_mentions
from acervo.operators.blocks import current_blocks
from acervo.session import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_mentions(current_blocks(table(spark, sf_dir, "blocks")))


def date_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of blocks with what they are about and what stands against it."""
    return _events(spark, sf_dir).select("doc_id", "block_id", "start", "end", "raw", "date", "kind", F.array_join("flags", ",").alias("flags"))


def execution_date_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return execution_dates(_events(spark, sf_dir))


def event_dates_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates that the grammar reads in blocks are those that the expressions read: counts by date."""
    return _events(spark, sf_dir).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


def company_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "parties").select("party_id", company_key(F.col("name")).alias("key"))


def letter_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 800).cast("int").alias("number")).distinct()
    return n.select("number", letter_number(F.col("number")).alias("letters"))


def sync_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of the ISO times of change; 0 for other notations."""
    return table(spark, sf_dir, "curation").select("row_id", iso_seconds(F.col("last_modified_utc")).alias("seconds"))


def safe_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "curation").select("row_id", safe_code(F.coalesce("category", "title")).alias("code"))


def party_names_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a document's parties taken apart again."""
    p = table(spark, sf_dir, "parties").where("name IS NOT NULL AND NOT name RLIKE '(?i) e |;|/|,'")
    line = F.concat(F.regexp_replace(F.trim("name"), r"[\s,.]+$", ""), F.lit("; Banco Alfa e Maria, "))
    return p.select("party_id", F.size(split_parties(line)).alias("names"), F.element_at(split_parties(line), -1).alias("last"))


def roles_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "parties").select("party_id", role_of(F.concat(F.lit("na qualidade de "), F.coalesce("role", F.lit("")), F.lit(" e de anuente"))).alias("role"))


def masked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.create_map(F.lit("Name"), F.col("name"), F.lit("Document"), F.col("clean_identifier"), F.lit("API_Token"), F.lit("x"))
    masked = masked_properties(m, ["token"])
    return table(spark, sf_dir, "parties").select("party_id", masked["Document"].alias("document"), masked["API_Token"].alias("token"))


QUERIES = {f.__name__: f for f in (date_events, execution_date_summary, event_dates_agree, company_keys, letter_numbers, sync_seconds, safe_codes, party_names_split, roles_in_text, masked_records)}

_MONTHS = "['janeiro', 'fevereiro', 'marco', 'abril', 'maio', 'junho', 'julho', 'agosto', 'setembro', 'outubro', 'novembro', 'dezembro']"
_DATE = (
    r"(?i)(?:^|[^\p{L}\p{N}_/.-])([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}"
    r"|(?:aos\s+)?[0-9]{1,2}º?(?:\s+dias)?\s+(?:do\s+mês\s+)?de\s+(?:janeiro|fevereiro|mar[cç]o|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro)\s+de\s+[0-9]{4})(?:[^\p{L}\p{N}_/.-]|[/.-][^\p{L}\p{N}_]|[/.-]?$)"
)
_ISO = rf"""try_cast(CASE WHEN regexp_matches(raw, '^[0-9]{{4}}-') THEN raw
  WHEN regexp_matches(lower(raw), ' de ') THEN right(raw, 4) || '-' || lpad(list_position({_MONTHS}, regexp_extract(strip_accents(lower(raw)), '([a-z]{{4,}}) +de +[0-9]{{4}}$', 1))::VARCHAR, 2, '0') || '-' || lpad(regexp_extract(raw, '[0-9]{{1,2}}'), 2, '0')
  ELSE right(raw, 4) || '-' || lpad(regexp_extract(raw, '^[0-9]{{1,2}}[/.-]([0-9]{{1,2}})', 1), 2, '0') || '-' || lpad(regexp_extract(raw, '^[0-9]{{1,2}}'), 2, '0') END AS DATE)::VARCHAR"""
SQL = {
    "event_dates_agree": rf"""WITH b AS (SELECT * FROM blocks WHERE block_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY ingested_at DESC NULLS LAST, text_search NULLS LAST, hierarchy_level) = 1),
r AS (SELECT replace(unnest(regexp_extract_all(replace(text_raw, ' ', '  '), '{_DATE}', 1)), '  ', ' ') AS raw FROM b WHERE text_raw IS NOT NULL) SELECT {_ISO} AS date, count(*) AS n FROM r GROUP BY ALL""",
    "company_keys": r"""WITH k AS (SELECT party_id, trim(regexp_replace(strip_accents(lower(replace(regexp_replace(name, '(?i)\bS\s*[./]\s*A\b\.?', ' SA ', 'g'), 'ß', 'ss'))), '[^\p{L}\p{N}]+', ' ', 'g')) AS key FROM parties)
SELECT party_id, regexp_replace(key, '(?: (?:ltda|limitada|sa|eireli|epp|me|mei|cia))+$', '') AS key FROM k""",
    "letter_numbers": """WITH n AS (SELECT DISTINCT (o_orderkey % 800)::INT AS number FROM orders)
SELECT number, CASE WHEN number BETWEEN 1 AND 26 THEN chr(96 + number) WHEN number BETWEEN 27 AND 702 THEN chr(97 + (number - 27) // 26) || chr(97 + (number - 1) % 26) END AS letters FROM n""",
    "sync_seconds": "SELECT row_id, coalesce(epoch(try_cast(last_modified_utc AS TIMESTAMPTZ)), 0)::DOUBLE AS seconds FROM curation",
    "safe_codes": "WITH k AS (SELECT row_id, coalesce(category, title) AS c FROM curation) SELECT row_id, CASE WHEN regexp_matches(c, '^[a-z0-9_:.\\-]{1,120}$') THEN c ELSE 'code:' || left(sha256(coalesce(c, '')), 16) END AS code FROM k",
    "party_names_split": "SELECT party_id, len(list_distinct([trim(name), 'Banco Alfa', 'Maria'])) AS names, 'Maria' AS last FROM parties WHERE name IS NOT NULL AND NOT regexp_matches(name, '(?i) e |;|/|,')",
    "roles_in_text": """WITH k AS (SELECT party_id, strip_accents(lower(coalesce(role, ''))) AS r FROM parties)
SELECT party_id, CASE WHEN r LIKE '%locador%' THEN 'locador' WHEN r LIKE '%locatari%' THEN 'locatario' WHEN r LIKE '%contratante%' THEN 'contratante' WHEN r LIKE '%contratad%' THEN 'contratada' WHEN r LIKE '%comprador%' THEN 'comprador'
  WHEN r LIKE '%vendedor%' THEN 'vendedor' ELSE 'anuente' END AS role FROM k""",
    "masked_records": r"""SELECT party_id, CASE WHEN regexp_matches(clean_identifier, '^[0-9A-Z]{12}\d{2}$') THEN '[CNPJ]' WHEN regexp_matches(clean_identifier, '^\d{11}$') THEN '[CPF]' ELSE clean_identifier END AS document, '[***]' AS token FROM parties""",
}

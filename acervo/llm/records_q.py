"""Problem 2: best representative of each duplicate group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from acervo.llm.records import FILLERS, curation_order, surviving_fields, surviving_records
from acervo.session import table

FIELDS = ["title", "class_name", "folder", "cliente", "palavras_chave"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    curation = table(spark, sf_dir, "curation")
    several = curation.groupBy("mfiles_id").count().where("count >= 2").select("mfiles_id")
    return surviving_fields(curation, "mfiles_id", FIELDS, "row_id", curation_order()).join(several, "mfiles_id", "left_semi").select("mfiles_id", "field_name", "row_id")


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surviving_records(table(spark, sf_dir, "curation"), "mfiles_id", FIELDS, "row_id", curation_order())


QUERIES = {"p2_found": p2_found, "p2_records": p2_records}

_LINES = f"""
WITH raw AS (
  SELECT mfiles_id, row_id, lower(trim(sync_status)) AS status, mfiles_version,
    CASE WHEN regexp_matches(synced_at, '^[0-9]{{8}}T') THEN strptime(substr(synced_at, 1, 15), '%Y%m%dT%H%M%S')
         ELSE strptime(replace(substr(synced_at, 1, 19), 'T', ' '), '%Y-%m-%d %H:%M:%S')
           - coalesce(try_cast(regexp_extract(synced_at, '([+-][0-9]{{2}}):[0-9]{{2}}$', 1) AS INTEGER), 0) * INTERVAL 1 HOUR END AS synced,
    unnest([{", ".join(f"{{'f': '{f}', 'v': {f}}}" for f in FIELDS)}]) AS x
  FROM curation WHERE mfiles_id IS NOT NULL),
lines AS (
  SELECT *, x.f AS field_name, x.v AS value,
    regexp_replace(trim(regexp_replace(strip_accents(lower(x.v)), '\\s+', ' ', 'g')), '^[^\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+$', '', 'g') AS core
  FROM raw),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY mfiles_id, field_name
    ORDER BY coalesce(status <> 'failed', true) DESC, mfiles_version DESC NULLS LAST, synced DESC NULLS LAST, row_id DESC) AS place
  FROM lines WHERE value IS NOT NULL AND core <> '' AND NOT regexp_full_match(core, 'x+|_+')
    AND core NOT IN ({", ".join(f"'{x}'" for x in FILLERS)})),
best AS (SELECT * FROM ranked WHERE place = 1),
groups AS (SELECT mfiles_id, count(*) AS row_count FROM curation WHERE mfiles_id IS NOT NULL GROUP BY ALL)
"""
SQL = {
    "p2_found": _LINES + "SELECT mfiles_id, field_name, row_id FROM best JOIN groups USING (mfiles_id) WHERE row_count >= 2",
    "p2_records": _LINES
    + "SELECT mfiles_id, row_count, "
    + ", ".join(f"max(value) FILTER (field_name = '{f}') AS {f}, max(row_id) FILTER (field_name = '{f}') AS {f}_row" for f in FIELDS)
    + " FROM groups LEFT JOIN best USING (mfiles_id) GROUP BY ALL",
}

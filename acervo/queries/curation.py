"""Curation: change capture, rules, duplicates, overrides, samples, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.functions.text import fold
from acervo.operators.curation import change_capture, family_stem, first_rule, index_plan, latest, normalised_title, round_robin, stratified, with_override
from acervo.session import table

# An example of an ordered rule table; callers bring their own.
RULES = [("amendment", r"\b(termo aditivo|alteracao)\b"), ("termination", r"\bdistrato\b"), ("lease", r"\blocacao\b"), ("power", r"\bprocuracao\b"), ("consortium", r"\bconsorcio\b"), ("contract", r"\bcontrato\b"), ("settlement", r"\bacordo\b")]
def _newest() -> list:
    return [F.col("mfiles_version").desc_nulls_last(), F.col("row_id").desc()]


def _curation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "curation")


def manifest_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last record of each id."""
    return latest(_curation(spark, sf_dir), ["mfiles_id"], [F.col("row_id").desc()]).select("mfiles_id", "row_id", "mfiles_version", F.lower(F.trim("sync_status")).alias("status"))


def _snapshot(df: DataFrame) -> DataFrame:
    return latest(df, ["mfiles_id"], _newest()).select("mfiles_id", "mfiles_version", F.lower("file.sha256").alias("sha"), "decision", "category", "title", "class_name", "file.extension", "reasons", "row_id")


def manifest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between what was known by July 2024 and all records."""
    c = _curation(spark, sf_dir)
    before = _snapshot(c.where("last_modified_utc < '2024-07-01'"))
    return change_capture(before, _snapshot(c), "mfiles_id", "mfiles_version").groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def index_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index of July 2024 needs to hold all included records."""
    c = _curation(spark, sf_dir)
    indexed = _snapshot(c.where("last_modified_utc < '2024-07-01'")).where("decision = 'include'")
    return index_plan(indexed, _snapshot(c).where("decision = 'include'"), "mfiles_id", "sha")


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of equal file bytes with the one that stands for them: contracts first, then the newest version, then the lowest id."""
    s = _snapshot(_curation(spark, sf_dir)).where("sha IS NOT NULL")
    rank = F.struct((~F.coalesce(F.col("class_name").startswith("Contrato"), F.lit(False))).cast("int").alias("a"), (-F.coalesce("mfiles_version", F.lit(0))).alias("b"), F.col("mfiles_id").alias("c"))
    chosen = s.groupBy("sha").agg(F.min_by("mfiles_id", rank).alias("canonical"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return s.select("mfiles_id", "sha").join(chosen, "sha").select("mfiles_id", "canonical", "copies")


def title_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by the first rule their normalised title matches."""
    named = _curation(spark, sf_dir).select(first_rule(normalised_title(F.col("title")), RULES).alias("rule"))
    return named.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def normalised_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curation(spark, sf_dir).where("title IS NOT NULL").select("row_id", normalised_title(F.col("title")).alias("title"))


def version_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that are versions of one another, with the member to keep: docx first, then the newest version, then the highest id."""
    s = _snapshot(_curation(spark, sf_dir)).withColumn("stem", family_stem(F.col("title"))).where("length(stem) > 8")
    best = F.struct((F.col("extension") == "docx").cast("int").alias("a"), F.coalesce("mfiles_version", F.lit(0)).alias("b"), F.col("mfiles_id").alias("c"))
    return s.groupBy("stem").agg(F.count(F.lit(1)).alias("members"), F.max_by("mfiles_id", best).alias("best")).where("members > 1")


def override_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with reviewers' decisions; here the reviews are the records of failed syncs."""
    c = _curation(spark, sf_dir)
    reviews = latest(c.where("lower(trim(sync_status)) = 'failed'"), ["mfiles_id"], [F.col("row_id").desc()]).select("mfiles_id", "mfiles_version", "decision")
    return with_override(_snapshot(c).select("mfiles_id", "mfiles_version", "decision"), reviews, "mfiles_id", "mfiles_version")


def curation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by decision, category and class in one pass (grouping sets)."""
    _snapshot(_curation(spark, sf_dir)).createOrReplaceTempView("acervo_snapshot")
    return spark.sql("""SELECT decision, category, class_name, count(*) AS n, cast(grouping_id(decision, category, class_name) AS int) AS level FROM acervo_snapshot
        GROUP BY GROUPING SETS ((), (decision), (decision, category), (class_name, decision))""")


def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _snapshot(_curation(spark, sf_dir))
    return s.select("decision", F.explode("reasons").alias("reason")).groupBy("decision", F.split("reason", ":")[0].alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def keyword_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = fold(F.col("palavras_chave"))
    flags = F.filter(F.array(F.when(text.contains("contrato"), "contract"), F.when(text.rlike("rescisao|multa"), "exit"), F.when(text.rlike("preco|reajuste|despesas"), "money")), lambda x: x.isNotNull())
    return _curation(spark, sf_dir).where("palavras_chave IS NOT NULL").select("row_id", F.array_join(flags, ",").alias("flags"))


def qa_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified(_snapshot(_curation(spark, sf_dir)).select("mfiles_id", "decision", "category"), ["decision", "category"], "mfiles_id", 15, "qa")


def reference_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty records taken from the file kinds in turn."""
    return round_robin(_snapshot(_curation(spark, sf_dir)), "extension", "mfiles_id", 60, "sample")


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the priority of the first listed prefix that one of their reasons has, 9 without."""
    s = _snapshot(_curation(spark, sf_dir))
    priority = F.lit(9)
    for place, prefix in reversed(list(enumerate(["K02", "RULE", "MODEL"]))):
        priority = F.when(F.array_join(F.col("reasons"), "|").rlike(rf"(^|\|){prefix}"), F.lit(place)).otherwise(priority)
    return s.select("mfiles_id", priority.alias("priority")).groupBy("priority").agg(F.count(F.lit(1)).alias("n"), F.min("mfiles_id").alias("first_id"))


QUERIES = {f.__name__: f for f in (manifest_latest, manifest_changes, index_actions, exact_duplicates, title_rules, normalised_titles, version_families, override_apply, curation_summary, reason_counts, keyword_flags, qa_sample, reference_sample, review_queue)}

_FOLD = "strip_accents(lower(replace({x}, 'ß', 'ss')))"
_TITLE = rf"trim(regexp_replace(regexp_replace({_FOLD.format(x='title')}, '\.[a-z0-9]{{1,5}}$', ''), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_STEM = rf"trim(regexp_replace(regexp_replace({_TITLE}, '\b(?:v|vs|versao|rev|revisao|minuta|final|assinad[oa]|copia|limpa|draft) ?\d*\b|\b\d{{1,2}}$', ' ', 'g'), '\s+', ' ', 'g'))"


def _snap(name: str, where: str = "true") -> str:
    return f"""{name} AS (SELECT mfiles_id, mfiles_version, lower(file.sha256) AS sha, decision, category, title, class_name, file.extension AS extension, reasons FROM curation WHERE mfiles_id IS NOT NULL AND {where}
  QUALIFY row_number() OVER (PARTITION BY mfiles_id ORDER BY mfiles_version DESC NULLS LAST, row_id DESC) = 1)"""


_NOW, _OLD = _snap("s"), _snap("p", "last_modified_utc < '2024-07-01'")
SQL = {
    "manifest_latest": "SELECT mfiles_id, row_id, mfiles_version, lower(trim(sync_status)) AS status FROM curation WHERE mfiles_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY mfiles_id ORDER BY row_id DESC) = 1",
    "manifest_changes": f"""WITH {_NOW}, {_OLD} SELECT CASE WHEN p.mfiles_id IS NULL THEN 'added' WHEN s.mfiles_id IS NULL THEN 'removed'
  WHEN p.mfiles_version IS NOT DISTINCT FROM s.mfiles_version THEN 'unchanged' ELSE 'changed' END AS change, count(*) AS n FROM p FULL JOIN s USING (mfiles_id) GROUP BY 1""",
    "index_actions": f"""WITH {_NOW}, {_OLD}, i AS (SELECT * FROM p WHERE decision = 'include'), w AS (SELECT * FROM s WHERE decision = 'include')
SELECT coalesce(i.mfiles_id, w.mfiles_id) AS mfiles_id, CASE WHEN w.mfiles_id IS NULL THEN 'delete' WHEN i.mfiles_id IS NOT NULL AND i.sha IS NOT DISTINCT FROM w.sha THEN 'unchanged' ELSE 'upsert' END AS action
FROM i FULL JOIN w ON i.mfiles_id = w.mfiles_id""",
    "exact_duplicates": f"""WITH {_NOW}, k AS (SELECT *, first_value(mfiles_id) OVER (PARTITION BY sha ORDER BY CASE WHEN class_name LIKE 'Contrato%' THEN 0 ELSE 1 END, -coalesce(mfiles_version, 0), mfiles_id) AS canonical,
  count(*) OVER (PARTITION BY sha) AS copies FROM s WHERE sha IS NOT NULL) SELECT mfiles_id, canonical, copies FROM k WHERE copies > 1""",
    "title_rules": "SELECT CASE " + " ".join(rf"WHEN regexp_matches({_TITLE}, '{p}') THEN '{n}'" for n, p in RULES) + " END AS rule, count(*) AS n FROM curation GROUP BY 1",
    "normalised_titles": f"SELECT row_id, {_TITLE} AS title FROM curation WHERE title IS NOT NULL",
    "version_families": f"""WITH {_NOW}, k AS (SELECT *, {_STEM} AS stem FROM s)
SELECT stem, count(*) AS members, arg_max(mfiles_id, {{'a': (coalesce(extension, '') = 'docx')::INT, 'b': coalesce(mfiles_version, 0), 'c': mfiles_id}}) AS best FROM k WHERE length(stem) > 8 GROUP BY stem HAVING count(*) > 1""",
    "override_apply": f"""WITH {_NOW}, o AS (SELECT mfiles_id, mfiles_version, decision FROM curation WHERE mfiles_id IS NOT NULL AND lower(trim(sync_status)) = 'failed' QUALIFY row_number() OVER (PARTITION BY mfiles_id ORDER BY row_id DESC) = 1)
SELECT s.mfiles_id, s.mfiles_version, CASE WHEN o.mfiles_id IS NULL THEN s.decision WHEN o.mfiles_version IS DISTINCT FROM s.mfiles_version THEN 'review' ELSE o.decision END AS decision,
  CASE WHEN o.mfiles_id IS NULL THEN 'rule' WHEN o.mfiles_version IS DISTINCT FROM s.mfiles_version THEN 'stale_override' ELSE 'override' END AS decided_by FROM s LEFT JOIN o ON s.mfiles_id = o.mfiles_id""",
    "curation_summary": f"""WITH {_NOW} SELECT decision, category, class_name, count(*) AS n, grouping_id(decision, category, class_name)::INT AS level FROM s
GROUP BY GROUPING SETS ((), (decision), (decision, category), (class_name, decision))""",
    "reason_counts": f"WITH {_NOW}, r AS (SELECT decision, unnest(reasons) AS reason FROM s) SELECT decision, split_part(reason, ':', 1) AS reason, count(*) AS n FROM r GROUP BY ALL",
    "keyword_flags": f"""WITH f AS (SELECT row_id, {_FOLD.format(x='palavras_chave')} AS t FROM curation WHERE palavras_chave IS NOT NULL)
SELECT row_id, array_to_string(list_filter([CASE WHEN contains(t, 'contrato') THEN 'contract' END, CASE WHEN regexp_matches(t, 'rescisao|multa') THEN 'exit' END, CASE WHEN regexp_matches(t, 'preco|reajuste|despesas') THEN 'money' END], lambda x: x IS NOT NULL), ',') AS flags FROM f""",
    "qa_sample": f"""WITH {_NOW} SELECT mfiles_id, decision, category, row_number() OVER (PARTITION BY decision, category ORDER BY sha256(mfiles_id::VARCHAR || '|qa'), mfiles_id) AS place FROM s QUALIFY place <= 15""",
    "reference_sample": f"""WITH {_NOW}, k AS (SELECT mfiles_id, extension, row_number() OVER (PARTITION BY extension ORDER BY sha256(mfiles_id::VARCHAR || '|sample'), mfiles_id) AS place FROM s)
SELECT *, row_number() OVER (ORDER BY place, extension NULLS FIRST, mfiles_id) AS turn FROM k QUALIFY turn <= 60""",
    "review_queue": f"""WITH {_NOW}, k AS (SELECT mfiles_id, array_to_string(reasons, '|') AS r FROM s)
SELECT CASE WHEN regexp_matches(r, '(^|\\|)K02') THEN 0 WHEN regexp_matches(r, '(^|\\|)RULE') THEN 1 WHEN regexp_matches(r, '(^|\\|)MODEL') THEN 2 ELSE 9 END AS priority, count(*) AS n, min(mfiles_id) AS first_id FROM k GROUP BY 1""",
}

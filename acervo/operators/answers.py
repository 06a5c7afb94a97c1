"""The answer side: coverage of a question's terms, checks of a proposed selection, citations, results against cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acervo.functions.lexicon import content_terms
from acervo.functions.text import words


def _held(texts: DataFrame, text: str) -> DataFrame:
    """(query_id, key): words of texts and, of those of five characters or more, their first five under a mark."""
    each = texts.where(F.col(text).isNotNull()).select("query_id", F.explode(F.array_distinct(words(F.col(text)))).alias("w"))
    keys = F.array_compact(F.array(F.col("w"), F.when(F.length("w") >= 5, F.concat(F.lit("^"), F.substring("w", 1, 5)))))
    return each.select("query_id", F.explode(keys).alias("key")).distinct()


def _known(terms: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """(query_id, term) of terms that the texts of their question hold, exactly or by the first five characters."""
    keys = F.array_compact(F.array(F.col("term"), F.when(F.length("term") >= 5, F.concat(F.lit("^"), F.substring("term", 1, 5)))))
    return terms.select("query_id", "term", F.explode(keys).alias("key")).join(_held(texts, text), ["query_id", "key"], "left_semi").select("query_id", "term").distinct()


def term_coverage(questions: DataFrame, proof: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, term, state): identifying where a title or party name holds the term, else present or absent in the literal texts.

    questions: query_id, text; proof: query_id, text; names: query_id, text. Terms that only name the instrument are
    neither required nor counted. A null text holds nothing.
    """
    terms = questions.where("text IS NOT NULL").select("query_id", F.explode(content_terms(F.col("text"))).alias("term"))
    named = _known(terms, names, "text").withColumn("named", F.lit(True))
    there = _known(terms, proof, "text").withColumn("there", F.lit(True))
    state = F.when(F.col("named"), "identifying").when(F.col("there"), "present").otherwise("absent")
    return terms.join(named, ["query_id", "term"], "left").join(there, ["query_id", "term"], "left").select("query_id", "term", state.alias("state"))


def unsupported(coverage: DataFrame) -> DataFrame:
    """(query_id, terms): questions that ask for content, none of which the proof holds."""
    asked = coverage.where("state <> 'identifying'").groupBy("query_id").agg(F.count(F.lit(1)).alias("terms"), F.count_if(F.col("state") == "present").alias("there"))
    return asked.where("there = 0").select("query_id", "terms")


def selection_findings(selections: DataFrame, offered: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, code, subject): units that were not offered, items that were not asked, and asked items that no selection covers.

    selections: query_id, unit_id, item; offered: query_id, unit_id; items: query_id, item. Null subjects are none.
    """
    strange = selections.where("unit_id IS NOT NULL").join(offered.select("query_id", "unit_id"), ["query_id", "unit_id"], "left_anti").select("query_id", F.lit("unit_not_offered").alias("code"), F.col("unit_id").alias("subject"))
    unknown = selections.where("item IS NOT NULL").join(items.select("query_id", "item"), ["query_id", "item"], "left_anti").select("query_id", F.lit("question_item_unknown").alias("code"), F.col("item").alias("subject"))
    missed = items.where("item IS NOT NULL").join(selections.select("query_id", "item"), ["query_id", "item"], "left_anti").select("query_id", F.lit("question_item_uncovered").alias("code"), F.col("item").alias("subject"))
    return strange.unionByName(unknown).unionByName(missed).distinct()


def quoted(text: Column) -> Column:
    """Each line of a text behind a quote mark."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(x == "", F.lit(">")).otherwise(F.concat(F.lit("> "), x))), "\n")


def listed(names: Column) -> Column:
    """Names as a list in words: commas, and "e" before the last."""
    n = F.size(names)
    return F.when(n <= 1, F.array_join(names, "")).otherwise(F.concat(F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" e "), F.element_at(names, -1)))


def citations(proof: DataFrame) -> DataFrame:
    """(query_id, instrument_no, unit_no, unit_id, line): the literal units of an answer, by instrument, those with a selected unit first, and by position within.

    proof: query_id, instrument_id, unit_id, selected, position, title, text. A row for each unit, so that an answer of any size is written in parallel.
    """
    instruments = proof.groupBy("query_id", "instrument_id").agg(F.max("selected").alias("any"))
    numbered = instruments.withColumn("instrument_no", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("any").desc(), "instrument_id"))).drop("any")
    placed = proof.join(numbered, ["query_id", "instrument_id"]).withColumn("unit_no", F.row_number().over(Window.partitionBy("query_id", "instrument_id").orderBy("position", "unit_id")))
    role = F.when(F.col("selected"), "selecionada").otherwise("fechamento obrigatório")
    line = F.concat(F.format_string("Prova %d.%d — %s [%s] (%s)\n", "instrument_no", "unit_no", F.coalesce("title", F.lit("")), "instrument_id", role), quoted(F.coalesce("text", F.lit(""))))
    return placed.select("query_id", "instrument_no", "unit_no", "unit_id", line.alias("line"))


def case_checks(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """(case_id, passed, missing): whether an answer names all contracts of its case and its quotes hold all terms.

    cases: case_id, contracts, terms (arrays); answers: case_id, contracts, quotes. A case without answer has not passed.
    """
    both = cases.alias("c").join(answers.select("case_id", F.col("contracts").alias("got"), F.col("quotes")), "case_id", "left")
    none = F.array().cast("array<string>")
    missing = F.array_sort(F.array_except("contracts", F.coalesce("got", none)))
    text = F.array_join(F.transform(F.coalesce("quotes", none), lambda q: F.array_join(words(q), " ")), "\n")
    held = F.forall("terms", lambda t: text.contains(F.array_join(words(t), " ")))
    return both.select("case_id", (F.col("got").isNotNull() & (F.size(missing) == 0) & held).alias("passed"), missing.alias("missing"))


def rates(results: DataFrame, by: str) -> DataFrame:
    """(by, n, fidelity, actions, quotes): shares of faithful answers, right actions and faithful quotes; null where there is nothing to count.

    results: faithful, right_action (booleans), quotes, faithful_quotes (numbers).
    """
    share = lambda a, b: F.round(F.try_divide(a, b), 4)
    n = F.count(F.lit(1))
    return results.groupBy(by).agg(n.alias("n"), share(F.count_if("faithful"), n).alias("fidelity"), share(F.count_if("right_action"), n).alias("actions"), share(F.sum("faithful_quotes"), F.sum("quotes")).alias("quotes"))


def shown_metrics(df: DataFrame, by: str, failed: Column, latency: Column, hit: Column) -> DataFrame:
    """(by, error_rate, latency, hit_rate): as they are shown, with one decimal."""
    percent = lambda c: F.format_string("%.1f%%", 100.0 * F.avg(c.cast("double")))
    return df.groupBy(by).agg(percent(failed).alias("error_rate"), F.format_string("%.1f ms", F.avg(latency)).alias("latency"), percent(hit).alias("hit_rate"))

"""Identifiers and dates inside texts, tokens with their aliases, content terms, plans of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.functions.text import fold, let, words

# Shapes of identifiers (company and person, masked and bare), and how dates are written.
COMPANY = r"[A-Z0-9]{2}\.[A-Z0-9]{3}\.[A-Z0-9]{3}/[A-Z0-9]{4}-[0-9]{2}"
PERSON = r"[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}"
IDENTIFIER = rf"(?i)(?<![A-Z0-9])({COMPANY}|{PERSON}|[A-Z0-9]{{12}}[0-9]{{2}}|[0-9]{{11}})(?![A-Z0-9])"
NUMERIC_COMPANY = r"(?<!\d)(\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2})(?!\d)"
NUMERIC_PERSON = r"(?<!\d)(\d{3}\.?\d{3}\.?\d{3}-?\d{2})(?!\d)"
MONTHS = ["janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"]
_MONTH = "|".join([*MONTHS, "março"])
DATE = (
    r"(?iU)(?<![\w/.-])([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([/.-])[0-9]{1,2}\2[0-9]{4}"
    rf"|(?:aos\s+)?[0-9]{{1,2}}º?(?:\s+dias)?\s+(?:do\s+mês\s+)?de\s+(?:{_MONTH})\s+de\s+[0-9]{{4}})(?!\w)(?![/.-]\w)"
)
STOP_WORDS = (
    "que para com por los las the and des les una del che non dos das uma qual quais como sobre este esta esse essa "
    "quando onde quem nos nas aos pela pelo pelas pelos entre sem seu sua seus suas foi ser sao"
).split()


def identifiers_in(text: Column) -> Column:
    """Canonical identifiers (upper case, without mask) of a text in order, each once; a null text has null."""
    found = F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.upper(x), "[./-]", "")))


def numeric_identifiers_in(text: Column) -> Column:
    """Digits of the company and then the person identifiers of a text, each once."""
    digits = lambda p: F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda x: F.regexp_replace(x, r"\D", ""))
    return F.array_distinct(F.concat(digits(NUMERIC_COMPANY), digits(NUMERIC_PERSON)))


def _iso(raw: Column) -> Column:
    numeric = lambda i: F.regexp_extract(raw, r"([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4})", i)
    named = F.regexp_extract(fold(raw), rf"({'|'.join(MONTHS)})", 1)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), named).cast("string")
    day, year = F.regexp_extract(raw, r"([0-9]{1,2})", 1), F.regexp_extract(raw, r"([0-9]{4})$", 1)
    joined = lambda y, m, d: F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return F.when(raw.rlike(r"^[0-9]{4}-"), raw).when(named != "", joined(year, month, day)).otherwise(joined(numeric(3), numeric(2), numeric(1)))


def dates_in(text: Column) -> Column:
    """(raw, date) of the dates of a text in order, repeated ones too: ISO, numeric (day first) and written out; an impossible one stays, with a null date."""
    found = F.regexp_extract_all(text, F.lit(DATE), F.lit(1))
    return F.transform(found, lambda x: F.struct(x.alias("raw"), _iso(x).try_cast("date").cast("string").alias("date")))


def lexical_tokens(text: Column) -> Column:
    """Words of the folded text, then identifier:<canonical> and date:<ISO> aliases, so that masks and notations meet; repeated ones stay."""
    known = F.filter(F.transform(dates_in(text), lambda d: d["date"]), lambda d: d.isNotNull())
    return F.concat(words(text), F.transform(identifiers_in(text), lambda x: F.concat(F.lit("identifier:"), F.lower(x))), F.transform(known, lambda d: F.concat(F.lit("date:"), d)))


def content_terms(text: Column) -> Column:
    """Words of at least three characters without digits that are no stop words and belong to no identifier, each once."""
    bare = F.regexp_replace(text, IDENTIFIER, " ")
    return F.array_distinct(F.filter(words(bare), lambda w: (F.length(w) >= 3) & ~w.rlike(r"\d") & ~w.isin(STOP_WORDS)))


def planned(questions: DataFrame, query_id: str, text: str, payload_ids: str | None = None) -> DataFrame:
    """(query_id, text, party_ids, every_party, instrument_ids, scope): filters that a question asks for.

    Party ids are those in the question, then those given with it, each once. By default all of them must hold and
    linked instruments count. A null text asks for nothing.
    """
    given = F.coalesce(F.col(f"`{payload_ids}`"), F.array().cast("array<string>")) if payload_ids else F.array().cast("array<string>")
    own = F.coalesce(identifiers_in(F.col(f"`{text}`")), F.array().cast("array<string>"))
    none = F.lit(None).cast("array<string>")
    return questions.select(F.col(f"`{query_id}`").alias("query_id"), F.col(f"`{text}`").alias("text"), F.array_distinct(F.concat(own, given)).alias("party_ids"), F.lit(True).alias("every_party"), none.alias("instrument_ids"), F.lit("linked_instruments").alias("scope"))


def prefiltered(items: DataFrame, item: str, identifier: str, questions: DataFrame, query_id: str, ids: str) -> DataFrame:
    """(query_id, id, direct): items that bear an identifier a question names, found by equal identifiers; direct where a question has one item only, which needs no ranking.

    Questions without an identifier, or whose identifiers no item bears, have no row. Null ids are left out.
    """
    asked = questions.select(F.col(f"`{query_id}`").alias("query_id"), F.explode(ids).alias("identifier"))
    held = items.select(F.col(f"`{item}`").alias("id"), F.col(f"`{identifier}`").alias("identifier")).where("id IS NOT NULL AND identifier IS NOT NULL").distinct()
    met = asked.join(held, "identifier").select("query_id", "id").distinct()
    alone = met.groupBy("query_id").agg((F.count(F.lit(1)) == 1).alias("direct"))
    return met.join(alone, "query_id")


def slices(text: Column, budget: int) -> Column:
    """Lossless pieces of at most `budget` characters, a piece ending after its last line end if that lies in its second half.

    One fold over the pieces, inside the JVM; an empty or null text has none.
    """
    steps = F.sequence(F.lit(1), F.ceil(F.length(text) / F.lit(max(1, budget // 2))).cast("int") + 1)

    def cut(left: Column) -> Column:
        head = F.substring(left, 1, budget)
        at = F.when(F.instr(head, "\n") > 0, F.length(head) - F.instr(F.reverse(head), "\n") + 1).otherwise(0)
        whole = F.length(left) <= budget
        return F.when(whole, F.length(left)).when(at >= max(1, budget // 2), at).otherwise(budget).cast("int")

    def step(state: Column, _: Column) -> Column:
        left = F.substring(text, state["at"] + 1, F.lit(budget + 1))
        return F.when(F.length(left) == 0, state).otherwise(
            let(cut(left), lambda n: F.struct((state["at"] + n).alias("at"), F.concat(state["parts"], F.array(F.struct(state["at"].alias("start"), n.alias("size")))).alias("parts")))
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,size:int>>").alias("parts"))
    parts = F.aggregate(steps, start, step, lambda s: s["parts"])
    return F.when(F.length(text) > 0, F.transform(parts, lambda p: F.struct(p["start"].alias("start"), F.substring(text, p["start"] + 1, p["size"]).alias("text"))))

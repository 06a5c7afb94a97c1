"""Scalar expressions: identifiers, dates, redaction, guards, numerals, text measures."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from acervo.functions.text import fold, squeeze


def canonical_identifier(raw: Column) -> Column:
    """Upper-case letters and digits of an identifier of 11 or 14 characters; null for any other text."""
    core = F.regexp_replace(F.upper(F.regexp_replace(raw, r"(?i)^\W*(cpf|cnpj)(\W*n[º°o]\.?)?\W+", "")), "[^0-9A-Z]", "")
    return F.when(F.length(core).isin(11, 14), core)


def redacted(text: Column) -> Column:
    """Company and then person identifiers of a text masked, with or without their punctuation."""
    company = r"(?<![0-9A-Za-z])(?:[0-9A-Z]{2}\.?[0-9A-Z]{3}\.?[0-9A-Z]{3}/?[0-9A-Z]{4}-?\d{2})(?![0-9A-Za-z])"
    return F.regexp_replace(F.regexp_replace(text, company, "[CNPJ]"), r"(?<![0-9A-Za-z])\d{3}\.?\d{3}\.?\d{3}-?\d{2}(?![0-9A-Za-z])", "[CPF]")


def masked_properties(properties: Column, secret: list[str]) -> Column:
    """Map values redacted, those of secret names (in any case) gone altogether."""
    named = "|".join(re.escape(s.lower()) for s in secret)
    return F.transform_values(properties, lambda k, v: F.when(F.lower(k).rlike(named) if secret else F.lit(False), F.lit("[***]")).otherwise(redacted(v)))


def without_controls(text: Column) -> Column:
    """Control characters gone but tabs and line ends, CRLF as LF, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))


def guarded(cell: Column) -> Column:
    """A spreadsheet cell that no program takes for a formula."""
    return F.when(cell.rlike(r"^\s*[=+\-@\t\r]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def unguarded(cell: Column) -> Column:
    return F.when(cell.rlike(r"^'\s*[=+\-@\t\r]"), F.substring(cell, 2, 1 << 30)).otherwise(cell)


def iso_dates(text: Column) -> Column:
    """ISO forms of the valid DD/MM/YYYY and YYYY-MM-DD dates in a text, in order, without repetition."""
    found = F.regexp_extract_all(text, F.lit(r"(?<!\d)(\d{2}/\d{2}/\d{4}|\d{4}-\d{2}-\d{2})(?!\d)"), F.lit(1))
    as_iso = F.transform(found, lambda x: F.when(x.contains("/"), F.concat_ws("-", F.substring(x, 7, 4), F.substring(x, 4, 2), F.substring(x, 1, 2))).otherwise(x))
    return F.array_distinct(F.array_compact(F.transform(as_iso, lambda x: x.try_cast("date").cast("string"))))


def roman(number: Column) -> Column:
    """Roman numeral of 1 to 3999; null beyond."""
    # The digits of each decimal place.
    places = [("", "M", "MM", "MMM"), ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"), ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"), ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")]
    parts = [F.element_at(F.array(*[F.lit(x) for x in digits]), (F.floor(number / unit) % 10 + 1).cast("int")) for digits, unit in zip(places, (1000, 100, 10, 1), strict=True)]
    return F.when(number.between(1, 3999), F.concat(*parts))


def summary(text: Column, most: int = 250, least: int = 180) -> Column:
    """The text in one line of at most `most` characters, cut at the last blank beyond `least` if there is one."""
    line = squeeze(text)
    head = F.substring(line, 1, most)
    at_blank = F.regexp_extract(head, rf"(?s)^(.{{{least},}})\s\S*$", 1)
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.when(at_blank != "", at_blank).otherwise(head), F.lit("…")))


def party_key(name: Column) -> Column:
    """Folded words of a name."""
    return squeeze(F.regexp_replace(fold(name), r"(?U)[\W_]+", " "))


def company_key(name: Column) -> Column:
    """Folded words of a company name without its legal form at the end."""
    bare = F.regexp_replace(party_key(F.regexp_replace(name, r"(?i)\bS\s*[./]\s*A\b\.?", " SA ")), r"(?: (?:ltda|limitada|sa|eireli|epp|me|mei|cia))+$", "")
    return squeeze(bare)


def letter_number(number: Column) -> Column:
    """a, b, ... z, aa, ab, ... for 1, 2, ...; null below 1 and above 702."""
    letter = lambda n: F.char(F.lit(97) + n)
    one = letter((number - 1) % 26)
    return F.when(number.between(1, 26), one).when(number.between(27, 702), F.concat(letter(F.floor((number - 27) / 26)), one))


def iso_seconds(text: Column) -> Column:
    """Seconds since 1970 of an ISO time, 0 where it is none."""
    return F.coalesce(F.unix_micros(F.try_to_timestamp(text)) / 1e6, F.lit(0.0))


def safe_code(text: Column) -> Column:
    """A code of lower-case letters, digits and _:.- as it is; anything else as a digest."""
    return F.when(text.rlike(r"^[a-z0-9_:.\-]{1,120}$"), text).otherwise(F.concat(F.lit("code:"), F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 16)))


def split_parties(line: Column) -> Column:
    """Names of a line of parties, parted by semicolons, slashes and "e", trimmed, each once."""
    parts = F.transform(F.split(line, r"\s*;\s*|\s+/\s+|,?\s+e\s+"), lambda x: squeeze(F.regexp_replace(x, r"^[\s,]+|[\s,.]+$", "")))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def role_of(text: Column) -> Column:
    """The role that a text names first; null for none."""
    # Roles of contracts in their stems.
    roles = {"locador": r"locador", "locatario": r"locatari", "contratante": r"contratante", "contratada": r"contratad", "comprador": r"comprador|adquirente", "vendedor": r"vendedor|alienante", "anuente": r"anuente|interveniente", "outorgante": r"outorgante", "outorgado": r"outorgad"}
    at = {k: F.regexp_instr(fold(text), F.lit(rf"\b(?:{v})")) for k, v in roles.items()}
    found = F.array_compact(F.array(*[F.when(i > 0, F.struct(i.alias("at"), F.lit(k).alias("role"))) for k, i in at.items()]))
    return F.try_element_at(F.array_sort(found), F.lit(1))["role"]

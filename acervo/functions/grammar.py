"""References to parts of a contract as they are written: kinds, ordinals, numerals, lists, ranges, relative ones."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

# Ordinal words by number, in both genders after folding.
ONES = ["", "primeir", "segund", "terceir", "quart", "quint", "sext", "setim", "oitav", "non"]
TENS = {"decim": 10, "vigesim": 20, "trigesim": 30, "quadragesim": 40, "quinquagesim": 50}
KINDS = {"clausulas?": "clause", "paragrafos?": "paragraph", "§§?": "paragraph", "anexos?": "annex", "itens|item": "item", "artigos?|arts?\\.?": "article"}
RELATIVE = r"anterior(?:es)?|seguintes?|acima|abaixo|supra|retro|unic[oa]"

_ORDINAL = rf"(?:{'|'.join(TENS)})[oa](?: (?:{'|'.join(x for x in ONES if x)})[oa])?|(?:{'|'.join(x for x in ONES if x)})[oa]"
_NUMBER = rf"(?:\d+(?:\.\d+)*[ºª°]?(?![\w])|{_ORDINAL}|[ivxlcdm]+(?!\w)|[b-df-np-z](?![\w]))"
_HEAD = rf"(?<!\w)(?P<kind>{'|'.join(KINDS)})"
_PATTERN = re.compile(rf"{_HEAD}\s*(?:(?P<relative>{RELATIVE})(?!\w)|(?P<list>{_NUMBER}(?:\s*(?:,|;|\be\b|\bou\b|\ba\b|\bate\b)\s*{_NUMBER})*)|(?!\w))")
_PART = re.compile(rf"(?P<link>,|;|\be\b|\bou\b|\ba\b|\bate\b)?\s*(?P<number>{_NUMBER})")


@dataclass(frozen=True)
class Reference:
    start: int
    end: int
    literal: str
    kind: str
    label: str
    state: str


def folded(text: str) -> str:
    """Folded one for one, so that offsets hold."""
    out = []
    for c in text:
        base = unicodedata.normalize("NFD", c)[0] if c not in "ºª°" else c
        out.append(base.lower() if len(base.lower()) == 1 else base)
    return "".join(out)


def roman_value(text: str) -> int | None:
    values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    total = 0
    for a, b in zip(text, [*text[1:], ""], strict=False):
        total += -values[a] if b and values[a] < values[b] else values[a]
    forms = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]
    left, back = total, ""
    for n, s in forms:
        back += s * (left // n)
        left %= n
    return total if back == text else None


def number_of(text: str) -> str:
    """Number of a numeral, ordinal word or Roman numeral as digits; a single letter and dotted numbers stay."""
    t = text.strip("ºª°")
    if re.fullmatch(r"\d+(\.\d+)*", t):
        return ".".join(str(int(x)) for x in t.split("."))
    parts = t.split()
    if all(p[:-1] in ONES or p[:-1] in TENS for p in parts) and len(t) > 2:
        return str(sum(TENS.get(p[:-1], 0) or ONES.index(p[:-1]) for p in parts))
    if re.fullmatch(r"[ivxlcdm]+", t) and (value := roman_value(t)):
        return str(value)
    return t


def references_in(text: str) -> list[Reference]:
    """References of a text in order. Ranges give one label kind:range:a:b, relative and unnumbered ones stay pending."""
    plain, out = folded(text), []
    for m in _PATTERN.finditer(plain):
        kind = next(k for p, k in KINDS.items() if re.fullmatch(p, m["kind"]))
        if m["relative"]:
            out.append(Reference(m.start(), m.end(), text[m.start() : m.end()], kind, f"{kind}:relative:{m['relative']}", "pending"))
            continue
        if not m["list"]:
            out.append(Reference(m.start(), m.end(), text[m.start() : m.end()], kind, f"{kind}:unidentified", "pending"))
            continue
        found: list[tuple[str, int, int]] = []
        for p in _PART.finditer(m["list"]):
            number = number_of(p["number"])
            start, end = m.start("list") + p.start("number"), m.start("list") + p.end("number")
            if p["link"] in ("a", "ate") and found:
                before, s, _ = found.pop()
                found.append((f"range:{before}:{number}", s, end))
            else:
                found.append((number, start, end))
        for i, (label, start, end) in enumerate(found):
            start = m.start() if i == 0 else start
            out.append(Reference(start, end, text[start:end], kind, f"{kind}:{label}", "pending" if label.startswith("range") else "named"))
    return out


def with_references(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, start, end, literal, kind, label, state): one row for each reference in df[text]; null texts have none."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, r.start, r.end, r.literal, r.kind, r.label, r.state) for i, t in batch.itertuples(index=False) if t for r in references_in(t)]
            yield pd.DataFrame(rows, columns=["id", "start", "end", "literal", "kind", "label", "state"])

    return df.selectExpr(f"cast(`{id_col}` as string) AS id", f"`{text}` AS t").mapInPandas(read, "id string, start int, end int, literal string, kind string, label string, state string")

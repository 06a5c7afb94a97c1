"""What the dates of a text are about: signature, validity, payment, termination, renewal, or unknown.

A date has a kind only where everything from the start of its frame to it is one of the known forms of words, and
nothing after it in its frame could qualify it. A frame begins with the block or after a delimiter, where the date
before is fully qualified and the words after the delimiter are themselves a known form. Whatever else stands in the
frame leaves the kind unknown and is told as flags. Blocks are read alone, so they are spread over all workers; only
whether a block is among the last of its document comes from outside.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.functions.lexicon import MONTHS
from acervo.operators.blocks import last_blocks

# Words that bring an event in, that make a date historical, that leave an event unasserted, and that no place name holds.
SIGNATURE_WORDS = "assinatura assinado assinada assinam firmado firmada celebrado celebrada".split()
HISTORICAL = "anterior anteriores original historica historico antigo antiga referencia citado citada nascimento nascido nascida".split()
UNASSERTED = """nao nunca jamais tampouco nem sem nenhum nenhuma ausencia previsto prevista previstos previstas previsao estimado estimada hipotese
condicionado condicionada confirmar se caso sera serao podera poderao devera deverao teria teriam haveria haveriam seria seriam poderia poderiam
deveria deveriam suposto suposta supostos supostas supostamente suposicao eventual eventuais eventualmente possivel possivelmente presumido presumida
pretendido pretendida hipotetico hipotetica hipoteticamente alegadamente talvez""".split()
NO_PLACE = """contrato instrumento pagamento vencimento vigencia prazo assinatura rescisao renovacao referencia data historico historica nascimento entregue
entrega recebido recebida quitado quitada vencido vencida emitido emitida aprovado aprovada""".split()
# Complete forms of words before a date, folded, by the kind that they give it.
FORMS = {
    "signature": [
        r"(?:data d[ea] )?assinatura(?: (?:deste|do presente) (?:contrato|instrumento|termo))? ?(?::|em)?",
        r"(?:o )?(?:este|presente) (?:contrato|instrumento|termo) (?:foi|e|esta|restou) (?:devidamente )?(?:assinado|firmado|celebrado) (?:em|aos|na data de)",
    ],
    "range": [r"(?:(?:prazo|periodo) d[ea] )?(?:prevista )?vigencia ?:? ?(?:de|entre)"],
    "due": [r"(?:[oa] )?(?:data d[eoa] )?(?:pagamento|vencimento|quitacao)(?: (?:previst[oa]|devid[oa]|agendad[oa]|vence|vencera))? ?(?::|em|para)?"],
    "effective_start": [r"(?:inicio (?:d[ae] )?vigencia|vigencia (?:inicia|a partir)|entra(?:ra)? em vigor|vigente a partir) ?(?::|em|de)?"],
    "effective_end": [r"(?:(?:fim|final|termino|encerramento) (?:d[ae] )?vigencia|vigencia (?:ate|encerra|termina)) ?(?::|em|de)?"],
    "termination": [r"(?:rescisao|distrato) ?(?::|em|para)?"],
    "renewal": [r"(?:renovacao|prorrogacao) ?(?::|em|para)?"],
}
_FORMS = [(kind, re.compile("|".join(forms))) for kind, forms in FORMS.items()]
_IN_SIGNATURE = re.compile(r"(?:assinad[oa]|firmad[oa]) em")
_HEADING = re.compile(r"clausula (?:\d+[ºª°]?|[ivxlcdm]+|primeira|segunda|terceira|quarta|quinta|sexta|setima|oitava|nona|decima) ?[:–—-] ?")
_PLACE = re.compile(r"[a-z][a-z .'-]{1,80}(?: ?/ ?[a-z]{2})? ?,")
_DATE = re.compile(
    rf"(?<![\w/.-])(?:(?P<y1>[0-9]{{4}})-(?P<m1>[0-9]{{2}})-(?P<d1>[0-9]{{2}})|(?P<d2>[0-9]{{1,2}})(?P<sep>[/.-])(?P<m2>[0-9]{{1,2}})(?P=sep)(?P<y2>[0-9]{{4}})"
    rf"|(?:aos\s+)?(?P<d3>[0-9]{{1,2}})º?(?:\s+dias)?\s+(?:do\s+mês\s+)?de\s+(?P<m3>{'|'.join(MONTHS)}|março)\s+de\s+(?P<y3>[0-9]{{4}}))(?!\w)(?![/.-]\w)",
    re.IGNORECASE,
)


def _fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.casefold()) if not unicodedata.combining(c))


def _line(text: str) -> str:
    """Folded, white space as single blanks, none at the ends."""
    return " ".join(_fold(text).split())


def _has(text: str, vocabulary: list[str]) -> bool:
    return not set(re.findall(r"\w+", text)).isdisjoint(vocabulary)


@dataclass
class Mention:
    start: int
    end: int
    raw: str
    date: str | None
    kind: str = "unknown"
    flags: list[str] = field(default_factory=list)


def dated(text: str) -> list[Mention]:
    """Dates of a text with their places; an impossible one has no date."""
    out = []
    for m in _DATE.finditer(text):
        year, month, day = next((m[f"y{i}"], m[f"m{i}"], m[f"d{i}"]) for i in (1, 2, 3) if m[f"y{i}"])
        number = int(month) if month.isdigit() else MONTHS.index(_fold(month)) + 1
        try:
            found = date(int(year), number, int(day)).isoformat()
        except ValueError:
            found = None
        out.append(Mention(m.start(), m.end(), m[0], found))
    return out


def form_of(words: str, signature: bool, closing: bool) -> tuple[str, bool] | None:
    """(kind, whether it is only a place and date at the end) of the words before a date, if they are one known form as a whole."""
    words = _HEADING.sub("", words, count=1) if _HEADING.match(words) else words
    if signature and _IN_SIGNATURE.fullmatch(words):
        return "signature", False
    for kind, form in _FORMS:
        if form.fullmatch(words):
            return kind, False
    if closing and _PLACE.fullmatch(words) and not _has(words, NO_PLACE):
        return "signature", True
    return None


def mentions(text: str, signature: bool = False, last: bool = False) -> list[Mention]:
    """Dates of one block with what they are about. `signature`: a signature block; `last`: among the last blocks of its document."""
    found = dated(text)
    paired = [i + 1 < len(found) and _line(text[m.end : found[i + 1].start]) in ("a", "ate") for i, m in enumerate(found)]
    begin = at = 0
    while at < len(found):
        before = _line(text[begin : found[at].start])
        form = form_of(before, signature, signature or last)
        ranged = form is not None and form[0] == "range" and paired[at]
        group = found[at : at + 1 + ranged]
        after = at + len(group)
        bound = form is not None and (form[0] != "range" or ranged)
        possible = all(m.date for m in group)
        following = _next_frame(text, group[-1].end, found, after, paired, signature) if bound and not form[1] and possible else None
        rest = _line(text[group[-1].end : len(text) if following is None else following])
        around = f"{before} {rest}"
        flags = [
            name
            for name, holds in (
                ("historical_reference", _has(around, HISTORICAL)),
                ("nonasserted_event_context", _has(around, UNASSERTED)),
                ("unqualified_event_frame", not bound),
                ("unresolved_event_qualification", re.search(r"\w", rest) is not None),
                ("invalid_range_endpoint", ranged and not possible),
            )
            if holds
        ]
        sound = not flags and possible
        for i, m in enumerate(group):
            m.flags = [*flags, *(["invalid_calendar_date"] if m.date is None else []), *(["signature_attribution_uncertain"] if not sound and _has(around, SIGNATURE_WORDS) else [])]
            if sound:
                m.kind = ("effective_start", "effective_end")[i] if ranged else form[0]
                m.flags += ["closing_line_candidate"] if form[1] else []
        if sound and following is not None:
            begin = following
        at = after
    return found


def _next_frame(text: str, end: int, found: list[Mention], at: int, paired: list[bool], signature: bool) -> int | None:
    """Where the frame of the next date begins, if a delimiter without a word before it and a known form after it part the two."""
    if at >= len(found) or found[at].date is None:
        return None
    for m in re.finditer(r"[,;\n.]", text[end : found[at].start]):
        if re.search(r"\w", text[end : end + m.start()]):
            return None
        form = form_of(_line(text[end + m.end() : found[at].start]), signature, False)
        if form is not None and (form[0] != "range" or paired[at]):
            return end + m.end()
    return None


def with_mentions(blocks: DataFrame, terminal: int = 5) -> DataFrame:
    """(doc_id, block_id, start, end, raw, date, kind, flags) of the dates of blocks (doc_id, block_id, order_index, block_type, text_raw).

    Null texts have none; blocks without a document are read as not being last. Repeated block ids are read each.
    """
    tail = last_blocks(blocks.where("doc_id IS NOT NULL"), terminal).select("doc_id", "block_id", F.lit(True).alias("last")).distinct()
    picked = blocks.where("text_raw IS NOT NULL").select("doc_id", "block_id", "text_raw", F.coalesce(F.lower("block_type") == "signature", F.lit(False)).alias("signature"))
    marked = picked.join(tail, ["doc_id", "block_id"], "left").select("doc_id", "block_id", "text_raw", "signature", F.coalesce("last", F.lit(False)).alias("last"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["doc_id", "block_id", "start", "end", "raw", "date", "kind", "flags"]
        for batch in batches:
            rows = [(d, b, m.start, m.end, m.raw, m.date, m.kind, m.flags) for d, b, t, s, z in batch.itertuples(index=False) for m in mentions(t, s, z)]
            frame = pd.DataFrame(rows, columns=columns)
            frame["doc_id"] = frame.doc_id.astype("Int64")
            yield frame

    return marked.mapInPandas(read, "doc_id long, block_id string, start int, end int, raw string, date string, kind string, flags array<string>")


def execution_dates(found: DataFrame) -> DataFrame:
    """(doc_id, date): the one date of signature of a document, null where several contradict or an attribution is uncertain."""
    sure = F.size(F.array_except("flags", F.array(F.lit("closing_line_candidate")))) == 0
    signed = F.when((F.col("kind") == "signature") & sure, F.col("date"))
    doubtful = F.bool_or(F.array_contains("flags", "signature_attribution_uncertain"))
    sums = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(signed).alias("low"), F.max(signed).alias("high"), doubtful.alias("doubtful"))
    return sums.select("doc_id", F.when(~F.col("doubtful") & (F.col("low") == F.col("high")), F.col("low")).alias("date"))

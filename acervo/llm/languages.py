"""Language of documents and of segments, by fusion of evidence.

Three sources of evidence are combined by Bayes' rule: the words of each sentence (multinomial likelihoods over hashed
words), the declared label (how often each label stands beside each language), and where the document comes from: the
prior of its host, here source and client, smoothed towards its source and that towards all documents. The word model
is fitted on a bounded sample of labelled rows (`sample_rows`, chosen by hash) in two rounds, the second on sentences
as the first reads them, which undoes wrong labels; label counts and priors are grouped over all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.functions.text import fold
from acervo.llm.leaks import plain_words
from acervo.session import cut

LANGUAGES = ["pt", "es", "en", "fr", "it"]
# Other notations of the languages, folded; of labels that name another language, its code.
NAMES = {
    "pt": "pt por portuguese portugues portuguesa portoghese portugais", "es": "es spa esp spanish espanol espanhol castellano espagnol spagnolo",
    "en": "en eng english ingles inglese anglais", "fr": "fr fra fre french frances francais francese", "it": "it ita italian italiano italien",
}
NO_LABEL = ["", "?", "n/a", "na", "und", "unknown", "none", "null", "xx", "mul", "zxx", "desconhecido", "-", "nan", "n/d"]
SLOTS = 1 << 15
_SENTENCE_END = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*(?:\s+|\Z)|\n[ \t\r]*\n")
_ASIDE = re.compile(r"^\s*(?:\([^()]{0,200}\)\s*)+")
_CLOSED = re.compile(r"[.!?…][\"'”’»)\]\s]*\Z")



def declared(label: Column) -> Column:
    """Code of the language that a label names; 'other' for a language that is none of LANGUAGES; null where it names none."""
    core = F.regexp_extract(F.trim(fold(label)), r"^([a-z]+)(?:[-_ ][a-z0-9]+)*$", 1)
    known = F.create_map(*[F.lit(x) for code, names in NAMES.items() for n in names.split() for x in (n, code)])
    missing = label.isNull() | F.trim(fold(label)).isin(NO_LABEL) | (core == "")
    return F.when(missing, F.lit(None).cast("string")).otherwise(F.coalesce(F.try_element_at(known, core), F.lit("other")))


class Slots(dict):
    """Feature slot of a word, kept for a bounded number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = s = xxhash.xxh32_intdigest(word) % SLOTS
        return s


def sentences(text: str) -> Iterator[tuple[int, int, list[str], bool]]:
    """(start, end, words, full): pieces between sentence ends and blank lines; full means closed, and not begun in the middle."""
    start = 0
    for m in [*_SENTENCE_END.finditer(text), None]:
        end = m.start() if m else len(text)
        piece = text[start:end]
        closing = piece + (m[0] if m else "")
        begun = _ASIDE.sub("", piece).lstrip(" \t\r\n\"'“‘«([")
        words = plain_words(piece)
        words = [w for w in words if not w.isdigit()]
        if words:
            inner = bool(begun) and begun[0].islower() and any(c.isupper() for c in begun)
            yield start, end, words, bool(_CLOSED.search(closing)) and not inner
        start = m.end() if m else end


@dataclass
class WordModel:
    """Log likelihoods of feature slots by language."""

    logs: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> WordModel:
        smooth = counts + 0.05
        return cls(np.log(smooth / smooth.sum(axis=0)))

    def likelihood(self, slots: list[int]) -> np.ndarray:
        return self.logs[slots].sum(axis=0)


def _counts(texts: DataFrame, model: WordModel | None) -> np.ndarray:
    """Word counts by slot and language: by the label of the text, or of each sentence as the model reads it. At most SLOTS x languages numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, slots = np.zeros((SLOTS, len(LANGUAGES)), dtype=np.int64), Slots()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                for _, _, words, _ in sentences(text):
                    own = [slots[w] for w in words]
                    if model is None:
                        np.add.at(total[:, LANGUAGES.index(label)], own, 1)
                    elif len(own) >= 5:
                        np.add.at(total[:, int(model.likelihood(own).argmax())], own, 1)
        slot, language = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(language), pa.array(total[slot, language])], names=["slot", "language", "n"])

    out = np.zeros((SLOTS, len(LANGUAGES)))
    for r in texts.select("text", "label").mapInArrow(count, "slot long, language long, n long").groupBy("slot", "language").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.slot, r.language] = r.n
    return out


def fit(documents: DataFrame, sample_rows: int) -> WordModel:
    """Word model of a hash sample of about `sample_rows` rows with a label of LANGUAGES. `documents` has id, text, label."""
    labelled = documents.where(F.col("label").isin(LANGUAGES) & (F.length("text") > 0))
    share = min(1.0, sample_rows / max(1, labelled.count()))
    sample = labelled.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))
    return WordModel.of(_counts(sample, WordModel.of(_counts(sample, None))))


_SEGMENTS = "array<struct<start:int,end:int,words:int,full:boolean,likelihood:array<double>>>"


def language_segments(documents: DataFrame, sample_rows: int = 20_000) -> DataFrame:
    """(id, label, source, client, segments, reading): each document's sentences with their likelihood by language, and what the text alone says.

    segments: array of (start, end, words, full, likelihood by language).
    """
    model = fit(documents, sample_rows)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32()), ("full", pa.bool_()), ("likelihood", pa.list_(pa.float64()))]))
        for batch in batches:
            rows, readings = [], []
            for text in batch.column("text").to_pylist():
                found = [(a, b, len(w), f, model.likelihood([slots[x] for x in w])) for a, b, w, f in sentences(text or "")]
                rows.append([{"start": a, "end": b, "words": n, "full": f, "likelihood": v.tolist()} for a, b, n, f, v in found])
                readings.append(LANGUAGES[int(sum(v for *_, v in found).argmax())] if found else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("id", "label", "source", "client")] + [pa.array(rows, kind), pa.array(readings, pa.string())], names=["id", "label", "source", "client", "segments", "reading"]
            )

    return documents.select("id", "text", "label", "source", "client").mapInArrow(read, f"id long, label string, source string, client string, segments {_SEGMENTS}, reading string")


def host_priors(heads: DataFrame, strength: float = 20.0) -> DataFrame:
    """(source, client, prior): language shares of each host by grouped counts, smoothed towards its source and that towards all.

    `heads` has source, client and reading, the language that the text alone gives. Null sources and clients are hosts of their own.
    """
    known = heads.where("reading IS NOT NULL").select(F.coalesce("source", F.lit("")).alias("source"), F.coalesce("client", F.lit("")).alias("client"), "reading")
    by_host = known.groupBy("source", "client", "reading").count()
    counts = lambda df: F.array(*[F.coalesce(F.sum(F.when(F.col("reading") == x, F.col("count"))), F.lit(0)).cast("double") for x in LANGUAGES])
    hosts = by_host.groupBy("source", "client").agg(counts(by_host).alias("own"))
    sources = by_host.groupBy("source").agg(counts(by_host).alias("of_source"))
    everything = by_host.agg(counts(by_host).alias("of_all"))
    share = lambda own, above: F.transform(own, lambda x, i: (x + strength * above[i]) / (F.aggregate(own, F.lit(0.0), lambda s, y: s + y) + strength))
    total = F.aggregate("of_all", F.lit(0.0), lambda s, y: s + y)
    top = everything.select(F.transform("of_all", lambda x: (x + 1.0) / (total + len(LANGUAGES))).alias("top"))
    upper = sources.join(F.broadcast(top)).select("source", share(F.col("of_source"), F.col("top")).alias("upper"))
    return hosts.join(upper, "source").select("source", "client", share(F.col("own"), F.col("upper")).alias("prior"))


def with_prior(heads: DataFrame, priors: DataFrame, broadcast_rows: int = 100_000, salts: int = 32) -> DataFrame:
    """Heads with the prior of their host (source, client). Up to broadcast_rows hosts, of some 100 bytes each, travel to the heads; of more, each goes to `salts` places over which a host's heads are dealt."""
    priors = cut(priors)
    if priors.count() <= broadcast_rows:
        return heads.join(F.broadcast(priors), ["source", "client"], "left")
    spread = priors.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return heads.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(spread, ["source", "client", "salt"], "left").drop("salt")


def _soft(scores: np.ndarray) -> np.ndarray:
    raised = np.exp(scores - scores.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def fused(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posteriors of documents and segments from likelihoods and the document's log prior and label evidence (lead)."""
    names = np.array(LANGUAGES)
    for batch in batches:
        segments, lead = batch.column("segments"), batch.column("lead").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(LANGUAGES))
        counts = np.array([len(x) for x in segments], dtype=np.int64)
        flat = segments.flatten()
        owner = np.repeat(np.arange(len(counts)), counts)
        likelihood = flat.field("likelihood").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(LANGUAGES))
        p = _soft(likelihood + lead[owner]) if len(flat) else np.empty((0, len(LANGUAGES)))
        whole = np.array(lead)
        np.add.at(whole, owner, likelihood)
        q, known = _soft(whole) if len(whole) else whole, counts > 0
        words = np.bincount(owner, weights=flat.field("words").to_numpy(zero_copy_only=False), minlength=len(counts)).astype(np.int32) if len(flat) else np.zeros(len(counts), np.int32)
        lines = pa.StructArray.from_arrays(
            [*(flat.field(c) for c in ("start", "end", "words", "full")), pa.array(names[p.argmax(axis=1)].tolist(), pa.string()), pa.array(p.max(axis=1) if len(p) else [], pa.float64())],
            names=["start", "end", "words", "full", "lang", "confidence"],
        )
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        best = [str(names[i]) if k else None for i, k in zip(q.argmax(axis=1), known, strict=True)] if len(q) else []
        sure = [float(x) if k else None for x, k in zip(q.max(axis=1), known, strict=True)] if len(q) else []
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("label"), pa.array(best, pa.string()), pa.array(sure, pa.float64()), pa.array(words, pa.int32()), pa.ListArray.from_arrays(offsets, lines)],
            names=["id", "label", "lang", "confidence", "words", "segments"],
        )


def languages_of(documents: DataFrame, id_col: str, text: str, label: str, source: str, client: str, sample_rows: int = 20_000) -> DataFrame:
    """(id, label, lang, confidence, words, segments): one row for each document; segments hold (start, end, words, full, lang, confidence).

    `label` is the declared language as a code, 'other' or null. Offsets are zero-based characters. Defined results: a
    document without words (null, blank, digits only) has no language (null) and no segments; null ids are left out;
    repeated rows stay; a null source or client counts as a host of its own; an empty table gives none.
    """
    c = lambda name: F.col(f"`{name}`")
    plain = documents.select(c(id_col).cast("long").alias("id"), c(text).alias("text"), declared(c(label)).alias("label"), c(source).alias("source"), c(client).alias("client")).where("id IS NOT NULL")
    heads = cut(language_segments(plain, sample_rows))
    labels = heads.where("reading IS NOT NULL").groupBy("label", "reading").count().collect()  # at most 7 x 5 numbers
    seen = Counter({(r.label, r.reading): r["count"] for r in labels})
    of_reading = Counter()
    for (_, reading), n in seen.items():
        of_reading[reading] += n
    beside = lambda mark: F.array(*[F.lit(float(np.log((seen[mark, x] + 1) / (of_reading[x] + 7)))) for x in LANGUAGES])
    evidence = F.when(F.col("label").isNull(), beside(None))
    for mark in [*LANGUAGES, "other"]:
        evidence = evidence.when(F.col("label") == mark, beside(mark))
    keyed = heads.withColumn("source", F.coalesce("source", F.lit(""))).withColumn("client", F.coalesce("client", F.lit("")))
    joined = with_prior(keyed, host_priors(heads)).withColumn("evidence", evidence)
    even = F.array(*[F.lit(1.0 / len(LANGUAGES))] * len(LANGUAGES))
    joined = joined.withColumn("lead", F.transform(F.coalesce("prior", even), lambda p, i: F.log(p) + F.col("evidence")[i]))

    kind = "array<struct<start:int,end:int,words:int,full:boolean,lang:string,confidence:double>>"
    return joined.select("id", "label", "segments", "lead").mapInArrow(fused, f"id long, label string, lang string, confidence double, words int, segments {kind}")


def wrong_or_mixed(read: DataFrame, least_words: int = 8) -> DataFrame:
    """(doc_id, lang): of documents with a missing or wrong label or several languages, each language with a full sentence of least_words or more."""
    full = F.array_distinct(F.transform(F.filter("segments", lambda x: x["full"] & (x["words"] >= least_words)), lambda x: x["lang"]))
    held = read.withColumn("langs", full).where((F.col("words") > 0) & (F.size("langs") > 0))
    # In one language the label must name it; a text in several is reported whatever its label.
    odd = F.col("label").isNull() | (F.size("langs") > 1) | (F.col("label") != F.col("langs")[0])
    return held.where(odd).select(F.col("id").alias("doc_id"), F.explode("langs").alias("lang")).distinct()

"""Texts that look the same brought to the same characters.

First compatibility forms that differ only in width, spacing or ligature are resolved and ignorable characters
deleted; then each run of letters becomes a lattice: every letter stands for all letters of the supported scripts that
look like it. The reading is the best path under script-wise letter-pair scores, counted over all texts on runs whose
script is certain, with a penalty for changing script inside a run (Viterbi). What was written enters only through
its look, so two texts that look the same get the same reading, and texts with different looks cannot meet.
Superscript forms, case, accents, digits and en dashes can be seen and stay as they are.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.session import cut

# Letters that look alike, Latin first, then Cyrillic, then Greek ("-" where a script has none).
LOOKALIKES = """
A А Α | B В Β | C С - | E Е Ε | H Н Η | I І Ι | J Ј - | K К Κ | M М Μ | N - Ν | O О Ο | P Р Ρ | S Ѕ - | T Т Τ | X Х Χ
Y Ү Υ | Z - Ζ | Q Ԛ - | W Ԝ - | V Ѵ - | a а α | c с ϲ | d ԁ - | e е - | h һ - | i і ι | j ј ϳ | l ӏ - | o о ο | p р ρ | q ԛ - | s ѕ - | v ѵ ν
w ԝ - | x х χ | y у -
"""
SCRIPTS = ("latin", "cyrillic", "greek")
HYPHENS = "‐‑﹣－"
_KEPT_FORMS = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>")
_SWITCH = -12.0
_LETTERS = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")


def _classes() -> tuple[dict[str, tuple[str | None, ...]], dict[str, str]]:
    sets, of = {}, {}
    for group in LOOKALIKES.replace("\n", "|").split("|"):
        letters = group.split()
        if letters:
            sets[letters[0]] = tuple(None if x == "-" else x for x in letters)
            for x in letters:
                if x != "-":
                    of[x] = letters[0]
    return sets, of


ALIKE, CLASS_OF = _classes()


def script_of(letter: str) -> int | None:
    """Index in SCRIPTS of a base letter's script, None for others."""
    at = ord(letter)
    if letter.isalpha():
        if at < 0x250 or 0x1E00 <= at < 0x1F00:
            return 0
        if 0x400 <= at < 0x530:
            return 1
        if 0x370 <= at < 0x400 or 0x1F00 <= at < 0x2000:
            return 2
    return None


def ignorable(c: str) -> bool:
    """Characters that leave no mark: format characters, fillers, variation selectors and controls other than line ends and tabs."""
    at = ord(c)
    if unicodedata.category(c) in ("Cf", "Cc"):
        return c not in "\t\n\r"
    return at in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0xFE00 <= at <= 0xFE0F or 0xE0100 <= at <= 0xE01EF


class CharacterMap(dict):
    """str.translate table: ignorables go, spaces become a blank, hyphens one hyphen, width and ligature forms their letters."""

    def __missing__(self, at: int) -> str | None:
        c = chr(at)
        out: str | None = c
        if ignorable(c):
            out = None
        elif unicodedata.category(c) == "Zs":
            out = " "
        elif c in HYPHENS:
            out = "-"
        else:
            form = unicodedata.decomposition(c)
            if form.startswith("<") and not form.startswith(_KEPT_FORMS):
                out = "".join(self[ord(x)] or "" for x in unicodedata.normalize("NFKC", c))
        self[at] = out
        return out


_MAP = CharacterMap()


def simplified(text: str) -> str:
    """Compatibility forms resolved, ignorables deleted, canonically decomposed."""
    return text if text.isascii() and text.isprintable() else unicodedata.normalize("NFD", text.translate(_MAP))


@dataclass
class Readings:
    """Letter-pair scores by script and the cache of readings of whole words."""

    pairs: list[dict[str, int]] = field(default_factory=lambda: [{} for _ in SCRIPTS])
    cache: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        total = sum(sum(p.values()) for p in self.pairs) + len(SCRIPTS)
        self.prior = [log((sum(p.values()) + 1) / total) for p in self.pairs]
        self.firsts = [Counter() for _ in SCRIPTS]
        for counts, firsts in zip(self.pairs, self.firsts, strict=True):
            for pair, n in counts.items():
                firsts[pair[0]] += n

    def score(self, script: int, before: str, letter: str) -> float:
        """Smoothed alike in every script, so that pairs seen nowhere leave the choice to the script's own frequency."""
        return log(0.9 * self.pairs[script].get(before + letter, 0) / max(1, self.firsts[script].get(before, 0)) + 0.1 / 30)

    def best(self, run: str) -> str:
        """The likeliest letters of a decomposed run of letters and marks."""
        letters = [(c, ()) if not unicodedata.combining(c) else (c, None) for c in run]
        columns = []
        for c, mark in letters:
            if mark is None or CLASS_OF.get(c) is None and script_of(c) is None:
                columns.append([(None, c)])
            elif c in CLASS_OF:
                columns.append([(s, x) for s, x in enumerate(ALIKE[CLASS_OF[c]]) if x])
            else:
                columns.append([(script_of(c), c)])
        states: dict[int | None, tuple[float, str, str]] = {None: (0.0, "", "^")}
        for column in columns:
            if column[0][0] is None:
                states = {s: (cost, path + column[0][1], last) for s, (cost, path, last) in states.items()}
                continue
            after: dict[int | None, tuple[float, str, str]] = {}
            for script, letter in column:
                options = []
                for s, (cost, path, last) in states.items():
                    step = self.prior[script] + self.score(script, last, letter.lower()) if s is None else self.score(script, last, letter.lower()) if s == script else _SWITCH + self.prior[script] + self.score(script, "^", letter.lower())
                    options.append((cost + step, path + letter, letter.lower()))
                after[script] = max(options)
            states = after
        return max(states.values())[1]

    def word(self, written: str) -> str:
        found = self.cache.get(written)
        if found is None:
            if len(self.cache) > 300_000:
                self.cache.clear()
            plain = unicodedata.normalize("NFD", written)
            found = self.cache[written] = unicodedata.normalize("NFC", _LETTERS.sub(lambda m: self.best(m[0]), plain))
        return found

    def text(self, written: str) -> str:
        return " ".join([self.word(w) for w in simplified(written).split(" ")]).strip()


def pair_counts(df: DataFrame, column: str) -> list[dict[str, int]]:
    """Letter pairs of each script in all runs that hold a letter no other script has and only letters of its script.

    Counted in each task, then summed; the result is bounded by the alphabets, whatever the size of the data.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        out: Counter = Counter()

        def settle() -> None:
            for word, n in words.items():
                for run in _LETTERS.findall(word):
                    bases = [c for c in unicodedata.normalize("NFD", run.lower()) if not unicodedata.combining(c)]
                    scripts = {script_of(c) for c in bases}
                    if len(scripts) == 1 and None not in scripts and any(c not in CLASS_OF for c in bases):
                        script = scripts.pop()
                        for a, b in zip(["^", *bases], bases, strict=False):
                            out[script, a + b] += n
            words.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    words.update(simplified(text).split(" "))
            if len(words) > 500_000:
                settle()
        settle()
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([p for _, p in out], pa.string()), pa.array(list(out.values()), pa.int64())], names=["script", "pair", "n"])

    found: list[dict[str, int]] = [{} for _ in SCRIPTS]
    summed = df.select(F.col(f"`{column}`")).mapInArrow(count, "script int, pair string, n long").groupBy("script", "pair").agg(F.sum("n").alias("n"))
    for r in summed.toLocalIterator():
        found[r.script][r.pair] = r.n
    return found


def with_reading(df: DataFrame, column: str, name: str, keep: list[str], digest_only: bool = False) -> DataFrame:
    """The columns `keep` and under `name` the text as it looks (or, with digest_only, a 128-bit digest of it and one of what was written).

    Defined results: a null text stays null, an empty one empty; leading and trailing white space cannot be seen and
    goes; repeated rows stay; an empty table stays empty.
    """
    pairs = pair_counts(df, column)
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{column}`").alias("__written"))
    out_type = f"{name} string" if not digest_only else f"{name} binary, written binary"
    types = {f.name: f.dataType.simpleString() for f in source.schema.fields}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readings = Readings(pairs)
        for batch in batches:
            written = batch.column("__written").to_pylist()
            seen = [None if t is None else readings.text(t) for t in written]
            columns = [batch.column(c) for c in keep]
            if digest_only:
                digest = lambda values: pa.array([None if t is None else xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in values], pa.binary())
                yield pa.RecordBatch.from_arrays([*columns, digest(seen), digest(written)], names=[*keep, name, "written"])
            else:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(seen, pa.string())], names=[*keep, name])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), out_type])
    return source.mapInArrow(read, schema)


def _lines(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """(id, seen, written), distinct, of rows with an id and a text; digests stand for the texts."""
    lines = with_reading(df.where(F.col(f"`{id_col}`").isNotNull()), column, "seen", [id_col], digest_only=True)
    return lines.where("seen IS NOT NULL").select(F.col(f"`{id_col}`").alias("id"), "seen", "written").distinct()


def _of_writings(lines: DataFrame, writings: DataFrame, salts: int = 32) -> DataFrame:
    """Lines with the columns of their writing. A writing may hold a third of all lines: its row goes to `salts` places and its lines are dealt over them."""
    spread = writings.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return lines.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(spread, ["seen", "written", "salt"]).drop("salt")


def looks(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """(id, class_id, writings, links): one row for each id and text: the smallest id whose text looks the same, in how many ways that look is written, and how many others are written otherwise.

    Rows of equal id and text are one; an id with several texts has a row for each. Null ids and texts have none.
    """
    lines = cut(_lines(df, id_col, column))
    writings = lines.groupBy("seen", "written").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    totals = writings.groupBy("seen").agg(F.sum("n").alias("total"), F.min("first").alias("class_id"), F.count(F.lit(1)).alias("writings"))
    return _of_writings(lines, writings.join(totals, "seen")).select("id", "class_id", "writings", (F.col("total") - F.col("n")).alias("links"))


def same_looking(df: DataFrame, id_col: str, column: str, part_rows: int = 10_000) -> DataFrame:
    """(id_a, id_b) with id_a < id_b: rows whose texts look the same but are written differently.

    Writings meet first, one row each; looks written in one way only leave there. The lines of a writing are dealt over
    parts of about `part_rows`, and each two parts of a pair of writings meet for themselves, so no look is one task.
    Rows of equal id and text are one. Null ids and texts have no pair.
    """
    lines = cut(_lines(df, id_col, column))
    writings = lines.groupBy("seen", "written").agg(F.count(F.lit(1)).alias("n"))
    mixed = writings.groupBy("seen").agg(F.count(F.lit(1)).alias("w")).where("w > 1").select("seen")
    writings = cut(writings.join(mixed, "seen", "left_semi"))
    kept = cut(_of_writings(lines, writings))
    left, right = (writings.select("seen", F.col("written").alias(f"written_{s}"), F.col("n").alias(f"n_{s}")) for s in "ab")
    parts = lambda n: F.floor(F.col(n) / part_rows)
    pairs = left.join(right, "seen").where("written_a < written_b").select("seen", "written_a", "written_b", F.explode(F.sequence(F.lit(0).cast("long"), parts("n_a"))).alias("part_a"), "n_b")
    pairs = cut(pairs.select("seen", "written_a", "written_b", "part_a", F.explode(F.sequence(F.lit(0).cast("long"), parts("n_b"))).alias("part_b")))
    dealt = kept.select("seen", "written", "id", F.pmod(F.xxhash64("id"), parts("n") + 1).alias("part"))
    sides = []
    for s, end in (("a", "x"), ("b", "y")):
        own = dealt.select("seen", F.col("written").alias(f"written_{s}"), F.col("part").alias(f"part_{s}"), F.col("id").alias(end))
        sides.append(own.join(pairs, ["seen", f"written_{s}", f"part_{s}"]))
    met = sides[0].join(sides[1], ["seen", "written_a", "written_b", "part_a", "part_b"]).where("x <> y")
    return met.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()

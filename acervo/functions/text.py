"""Text expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
_PLAIN = "aaaaaaeeeeiiiiooooouuuucnyyAAAAAAEEEEIIIIOOOOOUUUUCNY"


def strip_accents(text: Column) -> Column:
    """Drop the accents of Latin letters, composed or combining."""
    return F.regexp_replace(F.translate(text, _ACCENTED, _PLAIN), r"\p{M}+", "")


def fold(text: Column) -> Column:
    """Case-folded, accent-free text; sharp s becomes ss as Unicode case folding has it."""
    return F.replace(F.lower(strip_accents(text)), F.lit("ß"), F.lit("ss"))


def squeeze(text: Column) -> Column:
    """White space runs become one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def words(text: Column) -> Column:
    """Runs of letters and digits of the folded text, in order."""
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: an expression used inside a lambda is otherwise computed at every step."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_ngrams(tokens: Column, n: int) -> Column:
    """Distinct n-word sequences; a shorter text is one sequence, an empty one has none."""

    def grams(t: Column) -> Column:
        long = F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.array_join(F.slice(t, i + 1, n), " "))
        short = F.when(F.size(t) == 0, F.array().cast("array<string>")).when(F.size(t) < n, F.array(F.array_join(t, " ")))
        return short.otherwise(F.array_distinct(long))

    return let(tokens, grams)


def content_digest(*columns: Column) -> Column:
    """A 128-bit key of values that are too long to shuffle."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]))

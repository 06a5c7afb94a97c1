"""Problem 6: visually identical text with different characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.functions.text import fold
from acervo.llm.lookalikes import ALIKE, HYPHENS, looks, same_looking, with_reading
from acervo.session import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_looking(table(spark, sf_dir, "blocks"), "block_id", "text_raw").select(F.col("id_a").alias("block_id_a"), F.col("id_b").alias("block_id_b"))


def p6_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block's text in one form, and the search text made from it."""
    out = with_reading(table(spark, sf_dir, "blocks"), "text_raw", "text_seen", ["block_id", "ingested_at"])
    return out.withColumn("text_search", fold(F.col("text_seen")))


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each block and text: the class of its look, and how many blocks show the same in other characters."""
    return looks(table(spark, sf_dir, "blocks"), "block_id", "text_raw").withColumnRenamed("id", "block_id")


QUERIES = {"p6_found": p6_found, "p6_texts": p6_texts, "p6_classes": p6_classes}


def _look_sql() -> str:
    """The look as one translation of characters: what Viterbi chooses from is here always the first of the letters that look alike."""
    pairs = [(other, latin) for latin, letters in ALIKE.items() for other in letters[1:] if other]
    pairs += [(chr(c + 0xFEE0), chr(c)) for c in range(0x21, 0x7F) if chr(c) not in "-'"]
    pairs += [(c, "-") for c in HYPHENS] + [(chr(c), " ") for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)]
    first, last = "".join(a for a, _ in pairs), "".join(b for _, b in pairs)
    bare = r"regexp_replace(text_raw, '[\x{AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]', '', 'g')"
    return f"""
WITH s AS (SELECT DISTINCT block_id, text_raw, trim(nfc_normalize(translate(replace(replace({bare}, 'ﬁ', 'fi'), 'ﬂ', 'fl'), '{first}', '{last}'))) AS look FROM blocks WHERE block_id IS NOT NULL AND text_raw IS NOT NULL)"""


SQL = {
    "p6_found": _look_sql() + " SELECT DISTINCT a.block_id AS block_id_a, b.block_id AS block_id_b FROM s a JOIN s b ON a.look = b.look AND a.block_id < b.block_id AND a.text_raw <> b.text_raw",
    "p6_classes": _look_sql()
    + """, w AS (SELECT look, text_raw, count(*) AS n, min(block_id) AS first FROM s GROUP BY ALL), t AS (SELECT look, sum(n) AS total, min(first) AS class_id, count(*) AS writings FROM w GROUP BY look)
SELECT block_id, class_id, writings, (total - n)::BIGINT AS links FROM s JOIN w USING (look, text_raw) JOIN t USING (look)""",
}

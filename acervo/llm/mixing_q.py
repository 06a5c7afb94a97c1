"""Problem 9: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.llm.mixing import repeats_of, report, shares_of, source_key, with_token_count
from acervo.session import cut, table


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", source_key(F.col("source")).alias("source"), "text")
    return cut(with_token_count(docs, "text"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares asked and reached, by source."""
    docs = _sized(spark, sf_dir)
    shares, everything = shares_of(docs, table(spark, sf_dir, "mix_targets"))
    return report(repeats_of(docs, shares), shares, everything)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document used, and how often."""
    docs = _sized(spark, sf_dir)
    return repeats_of(docs, shares_of(docs, table(spark, sf_dir, "mix_targets"))[0])


def p9_tempered_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix that tempers the sources' own shares to the entropy of the targets, within the limits of repetition."""
    docs = _sized(spark, sf_dir)
    shares, everything = shares_of(docs, table(spark, sf_dir, "mix_targets"), tempering=True)
    return report(repeats_of(docs, shares), shares, everything)


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares, "p9_tempered_shares": p9_tempered_shares}
SQL: dict[str, str] = {}

"""Governed retrieval: filters, two rankings, fusion, closure, one outcome for each question."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.functions.text import fold
from acervo.operators.graph import ancestors
from acervo.operators.retrieval import best_by_vectors, best_by_words, reciprocal_rank_fusion, word_index
from acervo.session import cut, together


@dataclass(frozen=True)
class Corpus:
    """chunks: id, text, instrument_id, source_id, tokens; vectors: id, vector; parties: instrument_id, party_id; depends: child, parent (chunk ids). Ids of chunks and questions are whole numbers, each of one row."""

    chunks: DataFrame
    parties: DataFrame
    depends: DataFrame
    vectors: DataFrame | None = None
    blocked_sources: DataFrame | None = None


@dataclass(frozen=True)
class Limits:
    k: int = 10
    depth: int = 50
    token_budget: int = 6000
    ambiguous: tuple[str, ...] = field(default=("sem especificar", "ambigu"))


def eligible_instruments(corpus: Corpus, questions: DataFrame) -> DataFrame:
    """(query_id, instrument_id) of questions that limit instruments; a question whose party and instrument filters are empty has no row.

    Asked parties and instruments meet by equal joins and are counted: a union needs one, an intersection all of them.
    The instruments of a question always limit what its parties leave.
    """
    none = F.array().cast("array<string>")
    asked = questions.select("query_id", F.array_distinct(F.coalesce("party_ids", none)).alias("p"), F.coalesce("every_party", F.lit(True)).alias("every"), F.array_distinct(F.coalesce("instrument_ids", none)).alias("i"))
    needs = asked.select("query_id", F.when(F.size("p") == 0, 0).when(F.col("every"), F.size("p")).otherwise(1).alias("parties"), (F.size("i") > 0).alias("named"))
    by_party = asked.select("query_id", F.explode("p").alias("party_id")).join(corpus.parties.select("instrument_id", "party_id").distinct(), "party_id").groupBy("query_id", "instrument_id").agg(F.count(F.lit(1)).alias("parties"))
    by_name = asked.select("query_id", F.explode("i").alias("instrument_id")).withColumn("named", F.lit(True))
    either = by_party.join(by_name, ["query_id", "instrument_id"], "full_outer")
    checked = either.join(needs.select("query_id", F.col("parties").alias("need"), F.col("named").alias("must")), "query_id")
    return checked.where((F.coalesce("parties", F.lit(0)) >= F.col("need")) & (~F.col("must") | F.coalesce("named", F.lit(False)))).select("query_id", "instrument_id")


def question_filters(questions: DataFrame) -> DataFrame:
    """(query_id, filter, party_ids, every_party, instrument_ids): filter is the smallest question that asks for the same parties and instruments, null for one without a filter."""
    none = F.array().cast("array<string>")
    plain = questions.where("query_id IS NOT NULL").select("query_id", F.array_sort(F.array_distinct(F.coalesce("party_ids", none))).alias("party_ids"), F.coalesce("every_party", F.lit(True)).alias("every_party"), F.array_sort(F.array_distinct(F.coalesce("instrument_ids", none))).alias("instrument_ids"))
    asked = ["party_ids", "every_party", "instrument_ids"]
    limits = (F.size("party_ids") > 0) | (F.size("instrument_ids") > 0)
    first = plain.where(limits).groupBy(*asked).agg(F.min("query_id").alias("filter"))
    return plain.where(limits).join(first, asked).select("query_id", "filter", *asked).unionByName(plain.where(~limits).select("query_id", F.lit(None).cast(plain.schema["query_id"].dataType).alias("filter"), *asked))


def allowed_chunks(corpus: Corpus, instruments: DataFrame) -> DataFrame:
    """(id, filters): chunks of allowed sources with the filters that they pass, by `instruments` (filter, instrument_id); what each question may see is not listed."""
    chunks = corpus.chunks.select("id", "instrument_id", "source_id")
    if corpus.blocked_sources is not None:
        chunks = chunks.join(corpus.blocked_sources.select("source_id"), "source_id", "left_anti")
    passed = instruments.groupBy("instrument_id").agg(F.collect_set("filter").alias("filters"))
    return chunks.join(passed, "instrument_id", "left").select("id", "filters")


def retrieve(corpus: Corpus, questions: DataFrame, question_vectors: DataFrame | None = None, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """((query_id, status, reason, tokens), (query_id, id, rank)): outcome of each question and the chunks it rests on.

    Ranks are those of the fused ranking: BM25 over statistics of the whole corpus, in which eligible chunks without a
    shared token stay, behind the others; and the nearest vectors among those of allowed sources, of which the eligible
    ones stay. Chunks that the ranked ones depend on follow without rank. A closure that misses a chunk or exceeds the
    token budget blocks the answer, it is never cut. A question without filters abstains where no chunk has a token of it.
    """
    none = F.array().cast("array<string>")

    def filtered() -> tuple[DataFrame, DataFrame, DataFrame]:
        filters = cut(question_filters(questions))
        instruments = cut(eligible_instruments(corpus, filters.where("query_id = filter")).select(F.col("query_id").alias("filter"), "instrument_id"))
        return filters, instruments, cut(allowed_chunks(corpus, instruments))

    def by_words() -> DataFrame:
        return cut(best_by_words(corpus.chunks, allowed, questions.select("query_id", "text").join(filters.select("query_id", "filter"), "query_id"), limits.depth, index=index))

    def by_vectors() -> DataFrame:
        near = best_by_vectors(corpus.vectors.join(allowed.select("id"), "id", "left_semi"), question_vectors, limits.depth)
        seen = near.join(filters.select("query_id", "filter"), "query_id").join(allowed, "id").where("filter IS NULL OR array_contains(filters, filter)")
        return cut(seen.select("query_id", "id", "rank"))

    (filters, instruments, allowed), index = together(filtered, lambda: word_index(corpus.chunks, questions.select("query_id", "text")))
    both = corpus.vectors is not None and question_vectors is not None
    rankings = together(by_words, *[by_vectors] * both)
    ranked_words = rankings[0]
    ranked = cut(reciprocal_rank_fusion(rankings, limits.k))  # k rows a question
    above = ancestors(corpus.depends, ranked.select(F.col("id").alias("child"))).select(F.col("child").alias("id"), F.col("parent").alias("needed"))
    needed = ranked.join(above, "id").select("query_id", F.col("needed").alias("id")).distinct().join(ranked, ["query_id", "id"], "left_anti")
    proof = cut(ranked.select("query_id", "id", "rank").unionByName(needed.withColumn("rank", F.lit(None).cast("int"))))
    weighed = proof.join(corpus.chunks.select("id", "tokens", F.lit(True).alias("there")), "id", "left")
    sums = weighed.groupBy("query_id").agg(F.sum("tokens").alias("tokens"), F.count_if(F.col("there").isNull()).alias("missing"), F.count_if(F.col("rank").isNotNull()).alias("found"))
    # Eligible chunks without a shared token are ranked too, so a question without ranked ones has none.
    best = ranked_words.groupBy("query_id").agg(F.count(F.lit(1)).alias("eligible"), F.max("score").alias("best"))
    fitting = filters.select("query_id", "filter").join(instruments.groupBy("filter").agg(F.count(F.lit(1)).alias("instruments")), "filter").select("query_id", "instruments")
    text = fold(F.col("text"))
    unclear = F.lit(False)
    for mark in limits.ambiguous:
        unclear = unclear | text.contains(mark)
    limited = (F.size(F.coalesce("party_ids", none)) > 0) | (F.size(F.coalesce("instrument_ids", none)) > 0)
    joined = questions.select("query_id", unclear.alias("unclear"), limited.alias("limited"))
    for part in (sums, best, fitting):
        joined = joined.join(part, "query_id", "left")
    some = corpus.chunks.select("source_id").where("source_id IS NOT NULL")
    closed = corpus.blocked_sources is not None and some.join(corpus.blocked_sources.select("source_id"), "source_id", "left_anti").isEmpty()
    zero = lambda c: F.coalesce(c, F.lit(0)) == 0
    reason = (
        F.when(F.col("unclear"), "ambiguous_question")
        .when(F.lit(closed), "no_allowed_sources")
        .when(F.col("limited") & zero("instruments"), "no_eligible_instruments")
        .when(zero("eligible"), "no_eligible_chunks")
        .when(~F.col("limited") & (F.coalesce("best", F.lit(0.0)) <= 0), "insufficient_evidence")
        .when(zero("found"), "no_ranked_evidence")
        .when(F.col("missing") > 0, "closure_unit_missing")
        .when(F.col("tokens") > limits.token_budget, "closure_budget_exceeded")
    )
    status = F.when(F.col("reason").isNull(), "answered").when(F.col("reason") == "ambiguous_question", "needs_clarification").when(F.col("reason").startswith("closure"), "blocked").otherwise("abstained")
    outcome = cut(joined.withColumn("reason", reason).withColumn("status", status).select("query_id", "status", "reason", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")))
    kept = proof.join(outcome.where("status = 'answered'").select("query_id"), "query_id", "left_semi")
    return outcome, kept.select("query_id", "id", "rank")

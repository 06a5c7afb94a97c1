"""The k best rows of each question in one pass, and governed retrieval over it."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from acervo.operators.retrieval import _dealt, best_by_vectors, best_by_words, bm25, exact_nearest, top_k, with_zero_scores
from acervo.plans import retrieve as plan


def _corpus(spark, n=300):
    r = random.Random(3)
    text = lambda i: None if i % 41 == 0 else "" if i % 43 == 0 else " ".join(r.choices(["Prazo", "ação", "de", "valor", "foro", "multa", f"u{i % 60}", f"x{i}"], k=r.randint(1, 9)))
    chunks = spark.createDataFrame([(i, text(i), f"doc:{i % 20}", f"s{i % 25}", 5) for i in range(n)], "id long, text string, instrument_id string, source_id string, tokens int")
    return chunks, r


@pytest.mark.parametrize("most, block", [(1000, 512), (7, 2)])
def test_best_by_words_is_the_full_ranking(spark, most, block):
    chunks, r = _corpus(spark)
    asked = [(q, " ".join(r.choices(["de", "valor", "foro", f"u{q}", f"x{q * 9}"], k=4)), None if q % 3 else 1 + q % 2) for q in range(24)] + [(90, "nada disso", None), (91, "", 1), (92, None, 2), (93, "de", 5)]
    questions = spark.createDataFrame(asked, "query_id long, text string, filter long")
    rows = chunks.where("id % 6 <> 0").select("id", F.when(F.col("id") % 4 == 0, F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).when(F.col("id") % 4 == 1, F.array(F.lit(2).cast("long"))).alias("filters"))
    eligible = questions.crossJoin(rows).where("filter IS NULL OR array_contains(filters, filter)").select("query_id", "id")
    want = top_k(with_zero_scores(bm25(chunks, "id", "text", questions, "query_id", "text"), eligible), 8).collect()
    got = best_by_words(chunks, rows, questions, 8, block=block, most=most).collect()
    key = lambda rs: {(x.query_id, x.rank): (x.id, round(x.score, 5)) for x in rs}
    assert len(got) == len(want) == 27 * 8 and key(got) == key(want)


@pytest.mark.parametrize("most, block", [(1000, 512), (7, 2)])
def test_best_by_vectors_is_the_full_ranking(spark, most, block):
    r = random.Random(5)
    vectors = [[r.choice([0.0, 0.5, 1.0]) for _ in range(3 if i % 7 else 2)] for i in range(400)]  # many equal distances
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)] + [(1000, [float("nan"), 1.0, 0.0]), (1001, None)], "id long, vector array<float>")
    asked = df.where("id % 20 = 0 OR id >= 1000")
    want = exact_nearest(df, asked, "id", "vector", 9).collect()
    got = best_by_vectors(df, asked, 9, block=block, most=most).collect()
    key = lambda rs: {(x.query_id, x.rank): (x.id, round(x.score, 5)) for x in rs}
    assert len(got) == len(want) == 20 * 9 and key(got) == key(want)


def test_more_ties_than_a_slice(spark):
    """Rows without a shared token fill the list by id, wherever they lie."""
    chunks = spark.range(6000).select("id", F.when(F.col("id") == 5999, "foro").otherwise("valor").alias("text"))
    rows = chunks.select("id", F.array().cast("array<long>").alias("filters"))
    questions = spark.createDataFrame([(1, "foro", None), (2, "nada", None)], "query_id long, text string, filter long")
    got = {(x.query_id, x.rank): x.id for x in best_by_words(chunks, rows, questions, 3).collect()}
    assert got == {(1, 1): 5999, (1, 2): 0, (1, 3): 1, (2, 1): 0, (2, 2): 1, (2, 3): 2}


def _run(spark):
    chunks, _ = _corpus(spark)
    parties = spark.createDataFrame([(f"doc:{i}", "locador") for i in range(0, 20, 2)] + [("doc:1", "comprador"), ("doc:2", "comprador")], "instrument_id string, party_id string")
    vectors = chunks.select("id", F.array((F.col("id") % 17).cast("double"), (F.col("id") % 5).cast("double")).alias("vector"))
    depends = spark.createDataFrame([(i, i - 1) for i in range(1, 300) if i % 3], "child long, parent long")
    blocked = spark.createDataFrame([("s3",)], "source_id string")
    some = [(q, "valor de foro", [], None, None) for q in range(20)]
    some += [(100, "valor", ["locador", "comprador"], True, None), (101, "valor", ["comprador", "locador"], False, []), (102, "valor", ["locador"], True, ["doc:1"]), (103, "valor ambíguo", [], None, None), (104, "zzz", [], None, None), (105, "zzz", [], None, ["doc:4", "doc:4"]), (106, "valor", ["locador", "comprador"], True, None)]
    questions = spark.createDataFrame(some, "query_id long, text string, party_ids array<string>, every_party boolean, instrument_ids array<string>")
    asked = questions.join(vectors.withColumnRenamed("id", "query_id"), "query_id").select(F.col("query_id").alias("id"), "vector")
    return plan.retrieve(plan.Corpus(chunks, parties, depends, vectors, blocked), questions, asked, plan.Limits(k=3, depth=5, token_budget=60))


def test_governed_evidence_lists_no_pairs_of_questions_and_chunks(spark, monkeypatch):
    sizes = []

    def counted(df, own=plan.cut):
        sizes.append((df := own(df)).count())
        return df

    monkeypatch.setattr(plan, "cut", counted)
    _, evidence = _run(spark)
    assert evidence.count() > 0 and max(sizes) <= 300  # 27 questions over 288 chunks have some 6,000 pairs


def test_governed_outcomes_of_filters(spark):
    outcome, evidence = _run(spark)
    reasons = {x.query_id: x.reason for x in outcome.collect()}
    assert len(reasons) == 27 and (reasons[102], reasons[103], reasons[104], reasons[105]) == ("no_eligible_instruments", "ambiguous_question", "insufficient_evidence", None)
    assert {reasons[q] for q in (0, 100, 101, 106)} == {None}
    ids = {q: {x.id for x in evidence.where(f"query_id = {q} AND rank IS NOT NULL").collect()} for q in (0, 100, 101, 105, 106)}
    assert all(i % 25 != 3 for own in ids.values() for i in own)
    assert {i % 20 for i in ids[100] | ids[106]} == {2} and {i % 20 for i in ids[105]} == {4} and all(i % 20 == 1 or i % 2 == 0 for i in ids[101])


def test_governed_outcomes_meet_instruments_by_distinct_filter(spark):
    asked = [(q, ["b", "a"] if q % 2 else ["a", "b", "a"], None, None) for q in range(10)] + [(20, [], True, []), (21, None, None, None), (22, [], None, ["doc:1"]), (23, ["a", "b"], False, None)]
    questions = spark.createDataFrame(asked, "query_id long, party_ids array<string>, every_party boolean, instrument_ids array<string>")
    got = {x.query_id: x.filter for x in plan.question_filters(questions).collect()}
    assert got == {q: 0 for q in range(10)} | {20: None, 21: None, 22: 22, 23: 23}


def test_governed_outcomes_ranks_words_and_vectors_at_the_same_time(spark, monkeypatch):
    """Each ranking begins only when the other has."""
    met = threading.Barrier(2, timeout=60)
    for name in ("best_by_words", "best_by_vectors"):

        def begun(*args, own=getattr(plan, name), **kwargs):
            met.wait()
            return own(*args, **kwargs)

        monkeypatch.setattr(plan, name, begun)
    outcome, _ = _run(spark)
    assert outcome.count() == 27


def test_rows_are_dealt_to_as_many_parts_as_cores(spark):
    """Every part gives k rows a question to the last ranking."""
    cores = spark.sparkContext.defaultParallelism
    dealt = _dealt(spark.range(1000), 1000, 1 << 18)
    assert dealt.rdd.getNumPartitions() == cores and _dealt(spark.range(1000), 1000, 50).rdd.getNumPartitions() == 20
    assert all(x == sorted(x) for x in dealt.rdd.map(lambda r: r.id).glom().collect())

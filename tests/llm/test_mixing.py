import pytest
from pyspark.sql import functions as F

from acervo.llm.mixing import PATTERN, TOKENIZER, _encoded, entropy, exponent_for, repeats_of, report, shares_of, source_key, tempered, with_token_count

TARGETS = "source string, target_weight double, max_repeats int"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, tokens long")


def test_budgets_limits_and_report(spark):
    rows = [(i, "big", 10 + i % 7) for i in range(2000)] + [(10_000 + i, "small", 11) for i in range(20)] + [(20_000 + i, "other", 5) for i in range(50)] + [(30_000, "big", 0), (30_001, None, 9)]
    targets = spark.createDataFrame([("BIG ", 0.4, 2), ("small", 0.3, 3), ("absent", 0.3, 2), (None, 0.1, 1)], TARGETS)
    docs = docs_of(spark, rows)
    shares, everything = shares_of(docs, targets)
    assert everything == sum(r[2] for r in rows)
    used = repeats_of(docs.withColumn("source", source_key(F.col("source"))), shares, blocks=16)
    by = {s.source: s for s in shares}
    sums, most = {}, {}
    for r in used.collect():
        sums[r.source] = sums.get(r.source, 0) + r.tokens * r.times
        most[r.source] = max(most.get(r.source, 0), r.times)
    assert by["big"].budget - 17 < sums["big"] <= by["big"].budget == int(0.4 * everything)
    assert sums["small"] == 20 * 11 * 3 and most["small"] == 3 and most["big"] <= 2
    told = {r.source: r for r in report(used, shares, everything).collect()}
    assert told["absent"].used_tokens == 0 and not told["absent"].reached and told["big"].reached
    assert told["big"].share_of_all == pytest.approx(0.4, abs=0.001)


def test_exponents():
    sizes = {"a": 1000, "b": 100, "c": 10, "d": 0}
    wanted = 0.9
    assert entropy(tempered(sizes, exponent_for(sizes, 1110, {}, wanted))) == pytest.approx(wanted, abs=1e-6)
    limit = {"a": 4, "b": 4, "c": 4}
    x = exponent_for(sizes, 1110, limit)
    assert 0 < x < 1 and max(tempered(sizes, x)[s] * 1110 / n for s, n in sizes.items() if n) == pytest.approx(4, rel=1e-6)
    assert tempered({"a": 0}, 0.5) == {"a": 0.0}


def test_token_counts(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TOKENIZER, "rb"))}
    encoding = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Cláusula 1ª – o preço", "", "a b  c\n\nd", "word " * 30_000, "<|endoftext|>"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, None])], "id int, text string, tokens_of string")
    got = {r.id: r.tokens for r in with_token_count(df, "text").collect()}
    assert got == {i: len(encoding.encode_ordinary(t)) for i, t in enumerate(texts)} | {5: 0}
    long = "Prazo de 30 dias, e mais nada. " * 900
    assert _encoded(encoding, long, piece=1000) == len(encoding.encode_ordinary(long))


def test_empty_table(spark):
    targets = spark.createDataFrame([("a", 1.0, 2)], TARGETS)
    shares, everything = shares_of(docs_of(spark, []), targets)
    assert everything == 0 and repeats_of(docs_of(spark, []), shares).count() == 0
    assert shares_of(docs_of(spark, [(1, "a", 5)]), spark.createDataFrame([], TARGETS))[0] == []

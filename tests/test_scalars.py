import pytest
from pyspark.sql import functions as F

from acervo.functions.embed import hash_vector
from acervo.functions.scalars import canonical_identifier, guarded, iso_dates, party_key, redacted, roman, summary, unguarded, without_controls
from acervo.functions.text import fold, squeeze, word_ngrams, words
from acervo.operators.curation import family_stem, first_rule, normalised_title

CASES = [
    (normalised_title, "Contrato_de Locação – Imóvel.DOCX", "contrato de locacao imovel"),
    (normalised_title, None, None),
    (party_key, "  João, D’Ávila  ", "joao d avila"),
    (canonical_identifier, "123.456.789-01", "12345678901"),
    (canonical_identifier, "CNPJ: 11.222.333/0001-44", "11222333000144"),
    (canonical_identifier, "AB.CDE.FGH/IJKL-12", "ABCDEFGHIJKL12"),
    (canonical_identifier, "isento", None),
    (fold, "Straße ÀÇÃO", "strasse acao"),
    (squeeze, "  a  \t b ", "a b"),
    (redacted, "Ana 123.456.789-01 e 11.222.333/0001-44", "Ana [CPF] e [CNPJ]"),
    (without_controls, " a\x00\r\nb\tc\x7f ", "a\nb\tc"),
    (guarded, "=1+1", "'=1+1"),
    (guarded, "plain", "plain"),
    (guarded, " @x", "' @x"),
    (unguarded, "'=1+1", "=1+1"),
    (unguarded, "'plain", "'plain"),
    (lambda c: F.array_join(iso_dates(c), ","), "de 10/05/2024 a 2024-05-10, não 31/02/2024 nem 110/05/20241", "2024-05-10"),
    (lambda c: F.array_join(word_ngrams(words(c), 5), "|"), "a b c d e f", "a b c d e|b c d e f"),
    (lambda c: F.array_join(word_ngrams(words(c), 5), "|"), "a b", "a b"),
    (lambda c: F.size(word_ngrams(words(c), 5)).cast("string"), "", "0"),
    (lambda c: F.array_join(words(c), "|"), "Éfe_ção, 12-ab", "efe|cao|12|ab"),
    (lambda c: F.length(summary(c)).cast("string"), "palavra " * 90, "248"),
    (summary, "curto  texto", "curto texto"),
    (lambda c: first_rule(c, [("a", "^x"), ("b", "y")]), "xy", "a"),
    (lambda c: first_rule(c, [("a", "^x"), ("b", "y")]), "zy", "b"),
    (lambda c: first_rule(c, [("a", "^x")]), None, None),
]


@pytest.mark.parametrize("n", range(len(CASES)))
def test_literals(spark, n):
    function, given, wanted = CASES[n]
    assert spark.createDataFrame([(given,)], "x string").select(function(F.col("x")).alias("y")).first().y == wanted


def test_versions_share_a_stem(spark):
    titles = ["Termo_consórcio (2)", "TERMO CONSÓRCIO rev final", "Termo_consórcio"]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    assert {r.s for r in df.select(family_stem(F.col("t")).alias("s")).collect()} == {"termo consorcio"}


def test_roman_numerals(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 4, 9, 14, 40, 90, 400, 1994, 3999, 4000)], "n int")
    assert [r.r for r in df.select(roman(F.col("n")).alias("r")).collect()] == [None, "I", "IV", "IX", "XIV", "XL", "XC", "CD", "MCMXCIV", "MMMCMXCIX", None]


def test_hash_vectors():
    v = hash_vector("Um texto de teste", 48)
    assert sum(x * x for x in v) == pytest.approx(1) and v == hash_vector("um TEXTO de  teste", 48)
    assert hash_vector(None, 8) == hash_vector(" ", 8) == [0.0] * 8

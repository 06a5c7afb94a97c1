import pytest

from acervo.functions.grammar import number_of, references_in, with_references

CASES = [
    ("CLÁUSULA SEGUNDA", ["clause:2"]),
    ("Clausula décima primeira", ["clause:11"]),
    ("§ 2º", ["paragraph:2"]),
    ("Anexo II", ["annex:2"]),
    ("item 3.2", ["item:3.2"]),
    ("art. IV", ["article:4"]),
    ("as cláusulas 2, 3 e quarta", ["clause:2", "clause:3", "clause:4"]),
    ("§§ 1 a 3", ["paragraph:range:1:3"]),
    ("cláusulas 1, 2 até 4 e 5", ["clause:1", "clause:range:2:4", "clause:5"]),
    ("cláusula anterior", ["clause:relative:anterior"]),
    ("conforme o anexo", ["annex:unidentified"]),
    ("parágrafo único da cláusula 7ª", ["paragraph:relative:unico", "clause:7"]),
    ("nada disso", []),
]


@pytest.mark.parametrize("text, labels", CASES)
def test_labels(text, labels):
    found = references_in(text)
    assert [r.label for r in found] == labels
    assert all(text[r.start : r.end] == r.literal for r in found)


def test_numbers():
    assert [number_of(x) for x in ("vigesima quinta", "xiv", "007", "iiii", "b")] == ["25", "14", "7", "iiii", "b"]


def test_table(spark):
    df = spark.createDataFrame([(1, "ver cláusula 3"), (2, None), (3, "x" * 100_000)], "k int, t string")
    assert [(r.id, r.label) for r in with_references(df, "k", "t").collect()] == [("1", "clause:3")]

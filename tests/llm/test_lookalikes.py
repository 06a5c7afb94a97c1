import pytest

from acervo.llm.lookalikes import Readings, looks, same_looking, with_reading

PLAIN = "Cláusula 3ª – Do Preço. A parte contratante deverá pagar no prazo de 30 dias o valor do caso."
SAME = [
    PLAIN.replace("a", "а").replace("o", "о"),
    PLAIN.replace("á", "á").replace("ç", "ç"),
    PLAIN.replace(" ", " "),
    PLAIN.replace("30 dias", "３０ ｄｉａｓ"),
    PLAIN.replace("contratante", "contra​tan­te"),
    PLAIN.replace("P", "Ρ").replace("v", "ν"),
    PLAIN + "‍ ",
]
OTHER = [PLAIN.upper(), PLAIN.replace("á", "a"), PLAIN.replace("30", "31"), PLAIN.replace("3ª", "3a"), PLAIN.replace("–", "-"), PLAIN.replace("prazo ", "prazo, ")]
SCHEMA = "id string, text string, seen string, written string"


def test_pairs(spark):
    texts = [PLAIN, PLAIN, *SAME, *OTHER, None, "", "  "]
    rows = [(f"{i:03d}", t, "x", "y") for i, t in enumerate(texts)] + [("000", PLAIN, "x", "y"), (None, PLAIN, "x", "y")]
    got = {(r.id_a, r.id_b) for r in same_looking(spark.createDataFrame(rows, SCHEMA), "id", "text").collect()}
    alike = [f"{i:03d}" for i in range(2 + len(SAME))]
    assert got == {(a, b) for a in alike for b in alike if a < b and (a, b) != ("000", "001")} | {(f"{len(texts) - 2:03d}", f"{len(texts) - 1:03d}")}


def test_reading_is_plain(spark):
    rows = [(str(i), t, "", "") for i, t in enumerate([PLAIN, *SAME])]
    got = with_reading(spark.createDataFrame(rows, SCHEMA), "text", "text_seen", ["id"]).collect()
    assert {r.text_seen for r in got} == {PLAIN}
    assert with_reading(spark.createDataFrame([], SCHEMA), "text", "t", ["id"]).count() == 0


def test_script_follows_the_collection():
    latin = Readings([{"^c": 9000, "ca": 9000, "as": 9000, "so": 9000}, {}, {}])
    assert latin.text("саѕо") == latin.text("caso") == "caso" and latin.text("XXXVIII") == "XXXVIII"
    russian = Readings([{}, {"^с": 9000, "со": 9000, "ок": 9000}, {}])
    assert russian.text("coк") == "сок"


@pytest.mark.parametrize("text", ["", "a" * 100_000, "дом Москва", "نص عربي", "漢字 かな", "😀 emoji", "é" * 3000])
def test_any_text_is_read_the_same_twice(text):
    r = Readings([{"^d": 100, "de": 100}, {"^д": 10}, {}])
    once = r.text(text)
    assert r.text(once) == once


def test_one_look_of_a_third_of_all_rows(spark):
    rows = [(f"{i:05d}", PLAIN if i % 3 == 0 else SAME[0] if i % 300 == 1 else f"text {i}", "", "") for i in range(1500)]
    df = spark.createDataFrame([*rows, (None, PLAIN, "", ""), ("09999", None, "", "")], SCHEMA)
    plain, odd = [r[0] for r in rows if r[1] == PLAIN], [r[0] for r in rows if r[1] == SAME[0]]
    want = {(min(a, b), max(a, b)) for a in plain for b in odd}
    assert {(r.id_a, r.id_b) for r in same_looking(df, "id", "text", part_rows=40).collect()} == want
    told = {r.id: (r.class_id, r.writings, r.links) for r in looks(df, "id", "text").collect()}
    assert len(told) == 1500 and told[plain[3]] == ("00000", 2, len(odd)) and told[odd[0]] == ("00000", 2, len(plain)) and told["00002"] == ("00002", 1, 0)
    assert looks(spark.createDataFrame([], SCHEMA), "id", "text").count() == 0

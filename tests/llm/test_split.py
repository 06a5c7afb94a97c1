import random
import re

import pytest
from pyspark.sql import functions as F

from acervo.llm.split import boundary_rank, file_ranges, split_items, split_ranges

SCHEMA = "id string, text string, limit_tokens int, overlap int, item_key string, piece_no string"


def sample(rng, n):
    out = []
    for _ in range(n):
        out.append("".join(rng.choice("abçdé") for _ in range(rng.randint(1, 9))) + rng.choice(["", "", "", ",", "."]))
        out.append(rng.choice([" ", " ", "  ", "\n", "\n\n", "\t", " "]))
    return "".join(out)


def pieces_of(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in split_items(df, ["id"], "text", "limit_tokens", "overlap", **how).collect():
        got.setdefault(r.id, []).append(r)
    return {k: sorted(v, key=lambda r: r.piece_no) for k, v in got.items()}


@pytest.mark.parametrize("range_chars", [37, 500, 1 << 16])
def test_pieces_cover_the_text_within_the_limit(spark, range_chars):
    rng = random.Random(range_chars)
    rows = [(f"i{n}", sample(rng, rng.choice([1, 20, 300])), rng.choice([5, 12, 40]), rng.choice([0, 1, 3, 4]), "x", "y") for n in range(25)]
    rows += [(f"wide{n}", sample(rng, 300), 40, n, "x", "y") for n in (20, 33, 39)]
    got = pieces_of(spark, rows, range_chars=range_chars)
    for item, text, limit, overlap, *_ in rows:
        tokens = re.findall(r"[^ \t\r\n]+", text)
        found = got[item]
        assert found[0].start_token == 0 and found[-1].end_token == len(tokens)
        assert (len(found) > 1) == (len(tokens) > limit)
        for i, p in enumerate(found):
            assert p.token_count <= limit
            assert re.findall(r"[^ \t\r\n]+", p.text) == tokens[p.start_token : p.end_token]
            assert text[p.start_offset :].startswith(p.text)
            if i:
                assert p.start_token == found[i - 1].end_token - overlap


def test_ranges_cut_as_whole_items_do(spark):
    rng = random.Random(12)
    rows = [(f"i{n}", sample(rng, 250), rng.choice([9, 30]), rng.choice([0, 2, 8]), "x", "y") for n in range(12)]
    cuts = lambda got: {k: [(p.piece_no, p.start_token, p.end_token, p.text) for p in v] for k, v in got.items()}
    assert cuts(pieces_of(spark, rows, range_chars=333)) == cuts(pieces_of(spark, rows))


def test_cuts_prefer_natural_boundaries():
    assert [boundary_rank("end.", "\n\n"), boundary_rank("x", "\n"), boundary_rank("end.”", " "), boundary_rank("so,", " "), boundary_rank("so", " ")] == [4, 3, 2, 1, 0]


def test_sentence_end_is_chosen(spark):
    words = ["w"] * 40
    words[18] = "w."
    got = pieces_of(spark, [("a", " ".join(words), 25, 0, "", "")])
    assert got["a"][0].end_token == 19


def test_defined_results(spark):
    rows = [("null", None, 5, 1, "", ""), ("blank", " \n ", 5, 1, "", ""), ("nolimit", "a b c", None, 1, "", ""), ("zero", "a b c", 0, 1, "", ""), ("allshared", "a b c d", 3, 3, "", ""), ("nooverlap", "a b c d e f g", 3, None, "", ""), ("twice", "a b", 5, 1, "", ""), ("twice", "a b", 5, 1, "", ""), ("giant", "y" * 300_000, 5, 1, "", "")]
    got = pieces_of(spark, rows)
    assert set(got) == {"nooverlap", "twice", "giant"} and len(got["twice"]) == 1 and len(got["giant"][0].text) == 300_000
    assert split_items(spark.createDataFrame([], SCHEMA), ["id"], "text", "limit_tokens", "overlap").count() == 0


def test_files_are_read_by_byte_ranges(spark, tmp_path):
    text = sample(random.Random(9), 2000)
    path = tmp_path / "a.txt"
    path.write_text(text, encoding="utf-8", newline="")
    files = spark.createDataFrame([(str(path), path.stat().st_size)], "path string, n_bytes long")
    limits = files.select(F.col("path").alias("item_key"), F.lit(50).alias("limit"), F.lit(5).alias("overlap"))
    got = sorted(split_ranges(file_ranges(spark, files, 777), limits, "item_key").collect(), key=lambda r: r.piece_no)
    tokens = re.findall(r"[^ \t\r\n]+", text)
    assert got[-1].end_token == len(tokens)
    for p in got:
        assert re.findall(r"[^ \t\r\n]+", p.text) == tokens[p.start_token : p.end_token] and p.token_count <= 50

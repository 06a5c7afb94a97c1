import random
import re

import numpy as np
import pytest

from acervo.llm.near_copies import copy_groups, expand_pairs, near_copies, pack, sequence_hashes, unpack

SCHEMA = "doc long, part_no int, part_id string, text string, node string"


def brute(rows, threshold):
    texts = {}
    for d, no, part, text, *_ in rows:
        if d is not None and text:
            texts.setdefault(d, {})[no, part] = text
    sets = {}
    for d, parts in texts.items():
        w = re.findall(r"\w+", "\n".join(parts[k] for k in sorted(parts)).lower())
        if len(w) >= 5:
            sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for family in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 30, 200]))]
        for _ in range(4):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 3])):
                i = rng.randrange(len(words))
                words[i : i + rng.choice([0, 1])] = [rng.choice(vocabulary)]
            doc, at, no = len(rows) + 1000 * family, 0, 0
            while at < len(words):
                size = rng.choice([1, 2, 9, 40])
                rows.append((doc, no, f"{doc}-{no}", " ".join(words[at : at + size]).upper(), "n"))
                at, no = at + size, no + 1
    return rows


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.85])
def test_exact_against_brute_force(spark, threshold):
    rows = corpus(int(threshold * 100))
    rows += [rows[0], rows[5], (None, 0, "z", "a b c d e f", ""), (9001, 0, "a", None, ""), (9002, 0, "a", "", ""), (9003, 0, "a", "one two three four", ""), (9004, 0, None, "a b c d e f", "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for crowd in (1000, 3, 1):  # regions divided from so many sets on
        got = [(r.doc_id_a, r.doc_id_b) for r in expand_pairs(*near_copies(df, threshold, crowd=crowd)).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, threshold)


def test_a_document_over_many_tasks_is_whole(spark):
    """One document of thousands of parts is spread over range partitions; its sequences across their borders are kept."""
    words = [f"x{i}" for i in range(6000)]
    rows = [(1, i, f"p{i}", w, "") for i, w in enumerate(words)] + [(2, 0, "q", " ".join(words), ""), (3, 0, "r", " ".join(words[:5000]), "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id_a, r.doc_id_b) for r in expand_pairs(*near_copies(df, 0.9)).collect()}
    assert got == {(1, 2)}


def test_groups_give_one_row_a_document(spark):
    t = " ".join(f"k{i}" for i in range(40))
    rows = [(1, 0, "a", t, ""), (2, 0, "a", t, ""), (3, 0, "a", t + " more", ""), (4, 0, "a", "quite another text of its own", "")]
    got = {r.doc_id: (r.class_id, r.group_id, r.links) for r in copy_groups(*near_copies(spark.createDataFrame(rows, SCHEMA), 0.8)).collect()}
    assert got == {1: (1, 1, 2), 2: (1, 1, 2), 3: (3, 1, 2), 4: (4, 4, 0)}


def test_empty_table(spark):
    members, links = near_copies(spark.createDataFrame([], SCHEMA))
    assert members.count() == 0 and links.count() == 0


def test_packing():
    h = np.unique(sequence_hashes(np.arange(1, 500, dtype=np.uint64), 5))
    assert (unpack(pack(h)) == h).all() and h.max() < 1 << 48

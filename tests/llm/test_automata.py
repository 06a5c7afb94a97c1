import random

import numpy as np
import pytest

from acervo.llm.automata import LONGEST, Forest, letters
from acervo.llm.parties import _alike_entries, distance


@pytest.mark.parametrize(("alphabet", "longest"), [("ab", 7), ("abcd", 9)])
def test_forest_finds_what_the_distance_says(alphabet, longest):
    rng = random.Random(3)
    words = sorted({(rng.randrange(5), "".join(rng.choice(alphabet) for _ in range(rng.randint(1, longest)))) for _ in range(400)})
    shards, texts = np.array([s for s, _ in words]), [w for _, w in words]
    codes, lengths = letters(texts)
    forest = Forest(shards, codes, lengths)
    for most in range(4):
        found = [x for q, w, d in forest.near(shards, codes, lengths, most, block=100) for x in zip(q.tolist(), w.tolist(), d.tolist(), strict=True)]
        want = {(i, j, distance(texts[i], texts[j], most)) for i in range(len(texts)) for j in range(len(texts)) if shards[i] == shards[j] and distance(texts[i], texts[j], most) <= most}
        assert len(found) == len(set(found)) and set(found) == want


def test_unknown_shards_and_no_words():
    codes, lengths = letters(["abc"])
    assert list(Forest(np.array([4]), codes, lengths).near(np.array([3]), codes, lengths, 1)) == []
    none, sizes = letters([])
    assert list(Forest(np.array([], dtype=np.int64), none, sizes).near(np.array([4]), codes, lengths, 1)) == []


def test_words_longer_than_an_automaton_meet_too():
    long = "abcde" * 14
    texts = [long, long[:-1], long[:-1] + "x", "z" * (LONGEST + 1), "z" * LONGEST, "z" * (LONGEST - 1)]
    x, y = _alike_entries(np.zeros(len(texts), dtype=np.int64), texts, np.full(len(texts), 2))
    assert set(zip(x.tolist(), y.tolist(), strict=True)) == {(i, j) for i in range(6) for j in range(6) if (i < 3) == (j < 3)}

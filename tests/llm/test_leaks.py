import random

import numpy as np

from acervo.llm.leaks import Index, leaks, plain_words

DOCS, ITEMS = "doc_id long, text string, item_id string, runs string", "item_id long, text string, doc_id string"


def brute(docs, items, n):
    out = {}
    for d, text, *_ in docs:
        w = plain_words(text or "")
        runs = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i, other, *_ in items:
            v = plain_words(other or "")
            shared = runs & {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
            if shared and d is not None and i is not None:
                out[d, i] = max(out.get((d, i), 0), len(shared))
    return out


def test_agrees_with_brute_force(spark):
    rng = random.Random(2)
    words = [f"v{i}" for i in range(25)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 12, 40]))), "x") for i in range(60)]
    docs = []
    for d in range(80):
        text = [rng.choice(words) for _ in range(rng.choice([0, 10, 400]))]
        if rng.random() < 0.6:
            own = rng.choice(items)[1].split()
            start = rng.randrange(len(own))
            at = rng.randrange(len(text) + 1)
            text[at:at] = own[start : start + rng.choice([5, 6, 20])]
        docs.append((d, " ".join(text).upper(), "", ""))
    docs += [(500, None, "", ""), (501, "", "", ""), (None, items[5][1], "", ""), docs[0], (502, "Não " * 30_000 + items[2][1], "", "")]
    items += [(900, None, ""), (901, "", ""), (None, "a b c", ""), items[3]]
    for shard_words in (300, 10**6):
        got = leaks(spark.createDataFrame(docs, DOCS), "doc_id", "text", spark.createDataFrame(items, ITEMS), "item_id", "text", n=6, passage=32, shard_words=shard_words)
        assert {(r.doc_id, r.item_id): r.runs for r in got.collect()} == brute(docs, items, 6)


def test_retrieval_equals_full_scoring():
    rng = random.Random(8)
    words = [f"v{i}" for i in range(40)]
    index = Index([(i, [rng.choice(words) for _ in range(20)]) for i in range(90)], 4, term=1)
    for _ in range(200):
        terms = sorted({rng.randrange(len(index.known)) for _ in range(rng.randint(1, 9))})
        scores = {}
        for t in terms:
            for at in range(index.first[t], index.first[t] + index.count[t]):
                scores[index.places[at]] = scores.get(index.places[at], 0) + index.weights[at]
        assert index.retrieve(np.array(terms)) == sorted(p for p, s in scores.items() if s >= 1)


def test_empty_tables(spark):
    none_d, none_i = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some_d, some_i = spark.createDataFrame([(1, "a b c d", "", "")], DOCS), spark.createDataFrame([(1, "a b c d", "")], ITEMS)
    for d, i in ((none_d, some_i), (some_d, none_i), (none_d, none_i)):
        assert leaks(d, "doc_id", "text", i, "item_id", "text", n=2).count() == 0

import math
import random

import pytest
from pyspark.sql import functions as F

from acervo.operators.blocks import block_groups, bound_references, coverage, runs
from acervo.operators.curation import change_capture, index_plan, latest, round_robin, with_override
from acervo.operators.governance import broken_links, chain_digest, fold_policy, heads, orphans, parity
from acervo.operators.graph import ancestors, connected_components, on_cycles
from acervo.operators.measures import percentiles
from acervo.operators.retrieval import bm25, divides, exact_nearest, reciprocal_rank_fusion, top_k


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: root(x) for x in parent}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_closure_ends_on_cycles(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, None)], "child int, parent int")
    got = {(r.child, r.parent): r.depth for r in ancestors(df).collect()}
    assert got[4, 3] == 3 and got[1, 1] == 3 and len(got) == 12
    assert {r.node for r in on_cycles(df.toDF("a", "b")).collect()} == {1, 2, 3}


def test_closure_at_any_depth(spark):
    chain = spark.range(1000).selectExpr("id AS child", "id + 1 AS parent").unionByName(spark.range(5000, 5010).selectExpr("id AS child", "id + 1 AS parent"))
    whole = ancestors(chain)
    assert whole.count() == 1000 * 1001 // 2 + 55 and whole.where("depth <> parent - child").isEmpty()
    seeded = ancestors(chain, spark.createDataFrame([(0,), (990,), (None,)], "child long"))
    assert seeded.count() == 1010 and seeded.agg(F.max("depth")).first()[0] == 1000
    ring = spark.range(200).selectExpr("id AS a", "(id + 1) % 200 AS b").unionByName(spark.createDataFrame([(777, 3)], "a long, b long"))
    assert on_cycles(ring).count() == 200
    assert ancestors(chain.where("false")).count() == 0


def test_components_that_do_not_settle_are_an_error(spark):
    line = spark.range(200).selectExpr("id AS a", "id + 1 AS b")
    assert connected_components(line).select("component").distinct().count() == 1
    with pytest.raises(RuntimeError):
        connected_components(line, most_rounds=1)


def test_change_capture_and_plan(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d")], "id int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (3, None), (5, "e")], "id int, v string")
    assert {r.id: r.change for r in change_capture(old, new, "id", "v").collect()} == {1: "unchanged", 2: "changed", 3: "unchanged", 4: "removed", 5: "added"}
    assert {r.id: r.action for r in index_plan(old, new, "id", "v").collect()} == {1: "unchanged", 2: "upsert", 3: "unchanged", 4: "delete", 5: "upsert"}


def test_overrides(spark):
    rows = spark.createDataFrame([(1, 2, "include"), (2, 2, "include"), (3, None, "exclude")], "id int, version int, decision string")
    reviews = spark.createDataFrame([(1, 2, "exclude"), (2, 1, "exclude"), (9, 1, "include")], "id int, version int, decision string")
    got = {r.id: (r.decision, r.decided_by) for r in with_override(rows, reviews, "id", "version").collect()}
    assert got == {1: ("exclude", "override"), 2: ("review", "stale_override"), 3: ("exclude", "rule")}


def test_heads_hide_older_records(spark):
    log = spark.createDataFrame([("k", 1, "approved"), ("k", 2, "rejected"), ("m", 3, "approved"), (None, 9, "approved")], "key string, seq int, state string")
    assert {(r.key, r.state) for r in heads(log, ["key"], "seq").collect()} == {("k", "rejected"), ("m", "approved")}
    assert latest(log, ["key"], [F.col("seq")]).where("key = 'k'").first().seq == 1


def test_policy_fold(spark):
    log = spark.createDataFrame([("a", 1, "block"), ("a", 2, "clear"), ("b", 3, "clear"), ("b", 4, "block"), ("c", 5, "other")], "s string, epoch int, kind string")
    got = {r.s: r.blocked for r in fold_policy(log, "s", "epoch", F.col("kind") == "block", F.col("kind") == "clear").collect()}
    assert got == {"a": False, "b": True}


def test_chain(spark):
    import hashlib

    rows, previous = [], None
    for epoch in range(1, 6):
        digest = hashlib.sha256(f"{previous or ''}|{epoch}|x{epoch}".encode()).hexdigest()
        rows.append(("j", epoch, previous, digest, f"x{epoch}"))
        previous = digest
    schema = "j string, epoch int, previous string, digest string, what string"
    assert broken_links(spark.createDataFrame(rows, schema), "j", "epoch", "previous", "digest", "epoch", "what").count() == 0
    for at, field, value in ((2, 4, "forged"), (1, 2, "other"), (3, 1, 9)):
        forged = [list(r) for r in rows]
        forged[at][field] = value
        assert broken_links(spark.createDataFrame([tuple(r) for r in forged], schema), "j", "epoch", "previous", "digest", "epoch", "what").count() >= 1
    assert chain_digest is not None


def test_integrity(spark):
    children = spark.createDataFrame([(1, 10), (2, 11), (3, None), (4, 11)], "id int, parent int")
    parents = spark.createDataFrame([(10,)], "id int")
    assert [(r.key, r.n) for r in orphans(children, "c", "parent", parents, "id").collect()] == [("11", 2)]
    assert parity(parents, parents).count() == 0 and parity(parents, parents.union(parents)).count() == 1


def test_bm25_by_hand(spark):
    docs = ["a b c", "a a d", "b e f g", "h", None, ""]
    d = spark.createDataFrame(list(enumerate(docs)), "id int, text string")
    q = spark.createDataFrame([(1, "a d d"), (2, None), (3, "nowhere")], "q int, text string")
    got = {r.id: r.score for r in bm25(d, "id", "text", q, "q", "text").collect()}
    tokens = [x.split() for x in docs if x is not None]
    n, mean = len(tokens), sum(map(len, tokens)) / len(tokens)
    df = {t: sum(t in x for x in tokens) for x in tokens for t in x}
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    want = {}
    for i, x in enumerate(tokens):
        s = sum((idf[t] if idf[t] >= 0 else floor) * x.count(t) * 2.5 / (x.count(t) + 1.5 * (0.25 + 0.75 * len(x) / mean)) for t in ["a", "d", "d"] if t in x)
        if any(t in x for t in "ad"):
            want[i] = round(s, 6)
    assert got == pytest.approx(want)


def test_fusion_and_ties(spark):
    a = spark.createDataFrame([(1, 5, 2.0), (1, 3, 2.0), (1, 9, 1.0)], "query_id int, id int, score double")
    ranked = top_k(a, 2)
    assert [(r.id, r.rank) for r in ranked.orderBy("rank").collect()] == [(3, 1), (5, 2)]
    b = spark.createDataFrame([(1, 5, 1), (1, 7, 2)], "query_id int, id int, rank int")
    assert [r.id for r in reciprocal_rank_fusion([ranked, b], 3).orderBy("rank").collect()] == [5, 3, 7]


def test_nearest_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.standard_normal((230, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [float("nan")] * 8), (902, [1.0, 2.0]), (None, [0.0] * 8)], "id long, v array<double>").repartition(3)
    got = exact_nearest(df, df.where("id % 40 = 0"), "id", "v", 4, query_rows=3, data_rows=50).collect()
    for q in range(0, 230, 40):
        cost = ((x - x[q]) ** 2).sum(axis=1)
        cost[q] = np.inf
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == np.argsort(cost)[:4].tolist()


def test_division(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, None), (None, "a"), (1, "a")], "g int, m string")
    assert [r.g for r in divides(df, "g", "m", ["a", "b"]).collect()] == [1]
    assert sorted(r.g for r in divides(df, "g", "m", ["a", "b"], every=False).collect()) == [1, 2]


def test_blocks(spark):
    rows = [("d", 0, "b0", "preamble", None, "x"), ("d", 1, "b1", "clause", "Cláusula 1ª", "ver cláusula 2ª e cláusula 9ª"), ("d", 2, "b2", "item", None, "y"), ("d", 3, "b3", "clause", "Cláusula 2ª", "ver Clausula 3"), ("d", 4, "b4", "clause", "Cláusula 3ª", "z"), ("d", 5, "b5", "clause", "CLÁUSULA 3ª", None)]
    df = spark.createDataFrame(rows, "doc_id string, order_index int, block_id string, block_type string, hierarchy_label string, text_raw string")
    assert [(r.group_no, r.first_block, r.blocks) for r in block_groups(df, F.col("block_type") == "clause").orderBy("group_no").collect()] == [(0, "b0", 1), (1, "b1", 2), (2, "b3", 1), (3, "b4", 1), (4, "b5", 1)]
    got = {(r.block_id, r.label): (r.target_block, r.state) for r in bound_references(df).collect()}
    assert got == {("b1", "clause:2"): ("b3", "bound"), ("b1", "clause:9"): (None, "missing"), ("b3", "clause:3"): (None, "ambiguous")}
    assert [(r.value, r.blocks) for r in runs(df, F.col("block_type")).orderBy("run_no").collect()] == [("preamble", 1), ("clause", 1), ("item", 1), ("clause", 3)]


def test_coverage(spark):
    df = spark.createDataFrame([("u", 0, 10), ("u", 10, 20), ("u", 25, 30), ("u", 28, 40), (None, 0, 1)], "u string, s int, e int")
    assert [(r.s, r.fault) for r in coverage(df, "u", "s", "e").orderBy("s").collect()] == [(25, "gap"), (28, "overlap")]


def test_percentiles(spark):
    df = spark.createDataFrame([("g", float(v)) for v in (10, 20, 30, 40, 50)] + [("h", 7.0), ("g", None)], "g string, v double")
    got = {r.g: (r.n, r.rounded_index, r.ceiling_index, r.nearest_rank, r.upper_middle) for r in percentiles(df, "g", "v", 0.5).collect()}
    assert got == {"g": (5, 30.0, 30.0, 30.0, 30.0), "h": (1, 7.0, 7.0, 7.0, 7.0)}


def test_round_robin(spark):
    df = spark.createDataFrame([(i, "a" if i < 9 else "b") for i in range(11)], "id int, s string")
    got = round_robin(df, "s", "id", 5, "x").orderBy("turn").collect()
    assert [r.s for r in got] == ["a", "b", "a", "b", "a"]

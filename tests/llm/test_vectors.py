import numpy as np
import pandas as pd
import pytest

from acervo.llm.vectors import Plan, decode, encode, hashes_for, most_similar

SCHEMA = "vec_id long, vector array<float>, dimension int, cosine string, node string"


def brute(rows, k, least):
    ok = [(i, np.array(v, dtype=float)) for i, v, d, *_ in rows if i is not None and v is not None and d == len(v) and None not in v and np.isfinite(np.array(v, dtype=float)).all() and np.any(np.array(v))]
    out = set()
    for i, x in ok:
        near = sorted((-round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 9), j) for j, y in ok if j != i and len(y) == len(x))
        out |= {(i, j) for c, j in near[:k] if -c >= least}
    return out


def clustered(n, dim, seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((max(1, n // 6), dim))
    x = centres[rng.integers(0, len(centres), n)] + spread * rng.standard_normal((n, dim))
    return np.round(x, 4)


def test_agrees_with_brute_force_with_copies_and_bad_rows(spark):
    x = clustered(600, 32, 5, 0.2)
    rows = [(i, v.tolist(), 32, "own", "own") for i, v in enumerate(x)]
    rows += [(1000 + i, x[0].tolist(), 32, None, None) for i in range(40)]  # more copies than k
    rows += [(2000, None, 32, "", ""), (2001, [1.0] * 31, 32, "", ""), (2002, [float("nan")] * 32, 32, "", ""), (2003, [0.0] * 32, 32, "", ""), (2004, [float("inf")] + [1.0] * 31, 32, "", ""), (2005, [], 0, "", ""), (2006, [1.0, None], 2, "", ""), (None, [1.0] * 32, 32, "", "")]
    rows += [(3000, (x[3] * 2).tolist(), 32, "", ""), (3001, x[3].tolist() + [0.0] * 16, 48, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = most_similar(df, "vec_id", "vector", "dimension", k=5, min_cosine=0.9).collect()
    want = brute([(i, None if v is None else np.array([np.nan if e is None else e for e in v], dtype=np.float32).tolist(), d) for i, v, d, *_ in rows], 5, 0.9)
    pairs = {(r.id, r.neighbour_id) for r in got}
    assert len(pairs & want) >= 0.99 * len(want) and len(pairs - want) <= 0.01 * len(want)
    assert max(r.place for r in got) <= 5


def test_recall_on_hard_vectors_and_crowded_buckets(spark):
    """All vectors in one tight cone: buckets must be divided; recall against brute force stays above 0.9."""
    rng = np.random.default_rng(3)
    x = np.ones(24) + 0.5 * rng.standard_normal((3000, 24))
    df = spark.createDataFrame([(i, v.tolist(), 24, "", "") for i, v in enumerate(x)], SCHEMA)
    got = most_similar(df, "vec_id", "vector", "dimension", k=5, min_cosine=0.9, plan=Plan(hashes=3, cap=700, tables=6, probes=8)).collect()
    f = x.astype(np.float32).astype(float)
    f /= np.linalg.norm(f, axis=1, keepdims=True)
    s = f @ f.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.9}
    assert len({(r.id, r.neighbour_id) for r in got} & want) >= 0.9 * len(want)


@pytest.mark.parametrize("dim, spread", [(48, 0.25), (48, 0.1), (96, 0.25), (96, 0.1)])
def test_recall_where_more_than_keep_are_close(spark, dim, spread):
    """The ten best among hundreds of close vectors of one bucket, with the default plan."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal(dim) + spread * rng.standard_normal((1500, dim))
    df = spark.createDataFrame([(i, v.tolist(), dim, "", "") for i, v in enumerate(x)], SCHEMA)
    got = most_similar(df, "vec_id", "vector", "dimension", k=10, min_cosine=0.9).collect()
    f = x.astype(np.float32).astype(float)
    f /= np.linalg.norm(f, axis=1, keepdims=True)
    s = f @ f.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i])[:10] if s[i, j] >= 0.9}
    assert len({(r.id, r.neighbour_id) for r in got} & want) >= 0.9 * len(want) > 0


@pytest.mark.parametrize("n, k", [(3000, 60), (12_000, 10)])
def test_recall_of_the_default_plan_in_one_cone(spark, n, k):
    rng = np.random.default_rng(3)
    x = (np.ones(32) + 0.4 * rng.standard_normal((n, 32))).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "vector": list(x), "dimension": np.full(n, 32, dtype=np.int32)}), "vec_id long, vector array<float>, dimension int")
    got = most_similar(df, "vec_id", "vector", "dimension", k=k, min_cosine=0.9).toPandas()
    f = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    found = set(zip(got.id.tolist(), got.neighbour_id.tolist(), strict=True))
    for i in range(0, n, 3):
        s = f @ f[i]
        s[i] = -2
        want = [j for j in np.argsort(-s)[:k].tolist() if s[j] >= 0.9]
        total += len(want)
        hits += sum((i, j) in found for j in want)
    assert hits >= 0.9 * total > 0


def test_blocks_of_a_divided_bucket_meet(spark):
    """One tight cluster of many times `cap`: all of its pairs meet, whatever the cap."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal(96) + 0.02 * rng.standard_normal((1000, 96))
    df = spark.createDataFrame([(i, v.tolist(), 96, "", "") for i, v in enumerate(x)], SCHEMA)
    got = most_similar(df, "vec_id", "vector", "dimension", k=10, min_cosine=0.9, plan=Plan(cap=150)).collect()
    f = x.astype(np.float32).astype(float)
    f /= np.linalg.norm(f, axis=1, keepdims=True)
    s = f @ f.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i])[:10]}
    assert len({(r.id, r.neighbour_id) for r in got} & want) >= 0.9 * len(want)


def test_empty_table(spark):
    assert most_similar(spark.createDataFrame([], SCHEMA), "vec_id", "vector", "dimension").count() == 0


@pytest.mark.parametrize("dim", [7, 48, 96])
def test_codes_keep_the_cosine(dim):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, dim)).astype(np.float32)
    y = x + 0.3 * rng.standard_normal((300, dim)).astype(np.float32)
    for v in (x, y):
        v /= np.linalg.norm(v, axis=1, keepdims=True)
    plan = Plan()
    near = (decode(encode(plan, dim, x)) * decode(encode(plan, dim, y))).sum(axis=1)
    assert np.quantile(np.abs(near - (x * y).sum(axis=1)), 0.98) < 0.15


def test_hashes_grow_with_the_data():
    assert hashes_for(10) == 3 and hashes_for(10**6) < hashes_for(10**9) <= 24

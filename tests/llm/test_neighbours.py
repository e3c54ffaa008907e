from __future__ import annotations

import numpy as np
import pytest

from tests.llm.helpers import SMALL
from tidemark.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k):
    own = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows]
    out = {}
    for q, v in queries:
        v = np.array(v, np.float32).astype(np.float64)
        scored = sorted((-(v * x).sum(), i) for i, x in own if i != q)[:k]
        out[q] = [(i, -s) for s, i in scored]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], SCHEMA)


def got(df, queries, **more):
    out = {}
    for r in N.search(df, queries, **more).orderBy("query", "rank").collect():
        out.setdefault(r["query"], []).append((r.id, r.score))
        assert r["rank"] == len(out[r["query"]])
    return out


def recall(found, want):
    hits = sum(len({i for i, _ in found.get(q, [])} & {i for i, _ in w}) for q, w in want.items())
    return hits / sum(map(len, want.values()))


def drawn(seed, n, d=16, clusters=12, unit=True):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(clusters, d))[rng.integers(0, clusters, n)] + rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x * rng.uniform(0.2, 3, (n, 1))


@pytest.mark.parametrize("unit", [True, False])
def test_recall_and_exact_scores(spark, monkeypatch, unit):
    monkeypatch.setattr(N, "GROUP_ROWS", 200)
    monkeypatch.setattr(N, "QUERY_ROWS", 30)
    rows = list(enumerate(drawn(1, 1500, unit=unit)))
    queries = [x for x in rows if x[0] % 20 == 0]
    want = brute(rows, queries, 20)
    found = got(table(spark, rows), table(spark, queries))
    assert recall(found, want) >= 0.9
    vectors = {i: np.array(v, np.float32).astype(np.float64) for i, v in rows}
    for q, pairs in found.items():
        assert len(pairs) == 20 and q not in {i for i, _ in pairs}
        assert [(-s, i) for i, s in pairs] == sorted((-s, i) for i, s in pairs)
        assert all(abs(s - (vectors[q] * vectors[i]).sum()) < 1e-12 for i, s in pairs)


def test_copies_and_ties(spark):
    rows = [(i, [1, 0, 0]) for i in range(60)] + [(i, [0.5, 0.5, 0]) for i in range(60, 90)] + [(90, [0, 0, 1])]
    found = got(table(spark, rows), table(spark, [r for r in rows if r[0] % 20 == 0]), recall=1.0)
    for q in (0, 20, 40):
        assert [i for i, _ in found[q]] == [i for i in range(22) if i != q][:20]
    assert [i for i, _ in found[60]] == list(range(20))
    # of equal products the smaller ids: 0.5 with all of 0..59 and with its own class
    assert [i for i, _ in found[80]] == list(range(20))


def test_odd_tables(spark):
    rows = [(0, [1, 0]), (1, None), (2, [0, 0]), (3, [float("nan"), 1]), (4, [float("inf"), 1]), (5, [None, 1]), (6, [0.5, 0.5]), (None, [1, 1]), (6, [0.5, 0.5]), (20, [-1, 0])]
    df = table(spark, rows).selectExpr("*", "1 AS id", "2 AS v", "3 AS query")
    found = got(df, df.filter("vec_id % 20 = 0"))
    assert {q: [i for i, _ in p] for q, p in found.items()} == {0: [6, 20], 20: [6, 0]}
    assert got(table(spark, []), table(spark, [])) == {}
    assert got(table(spark, [(1, None)]), table(spark, [])) == {}
    assert got(table(spark, [(0, [1, 2])]), table(spark, [(0, [1, 2])])) == {}
    with pytest.raises(ValueError):
        N.search(table(spark, [(0, [1, 2]), (1, [1])]), table(spark, []))


def test_query(spark):
    from tidemark.llm.queries import op2_nearest_neighbours

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    found = {}
    for r in op2_nearest_neighbours(spark, SMALL).collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert recall(found, want) >= 0.9 and all(len(v) == 20 for v in found.values()) and set(found) == set(want)


def share_and_recall(x, queries, k=20):
    """The mean share of rows in the buckets that queries visit, and how many of the true nearest are there."""
    norm = float(np.linalg.norm(x, axis=1).max())
    rng = np.random.default_rng(0)
    nearness, mass = N.calibrate(x[rng.permutation(len(x))[: N.SAMPLE]], norm, 20, k, N.RECALL)
    axes, shifts, bounds = N._tables(x.shape[1], 20)
    units, n = N.unit(x, norm), N.CELLS**N.PROJECTIONS
    own = np.stack([N.buckets_of(units, axes[t], shifts[t], bounds) for t in range(N.TABLES)])
    sizes = np.stack([np.bincount(o, minlength=n) for o in own])
    first, split = N.directory(sizes.ravel())
    index = N.Index(norm, axes, shifts, bounds, split, first, nearness, mass, sizes, np.empty(0))
    share = hits = 0
    for q in queries:
        visits = N.visited(N.unit_query(x[q : q + 1]), index)[:, 0]
        met = np.logical_or.reduce([visits[t][own[t]] for t in range(N.TABLES)])
        near = [i for i in np.argsort(-(x @ x[q]), kind="stable")[: k + 1] if i != q][:k]
        share, hits = share + met.mean(), hits + met[near].mean()
    return share / len(queries), hits / len(queries)


def test_queries_visit_few_rows_of_clustered_vectors():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 32))[rng.integers(0, 200, 20_000)] + 0.35 * rng.normal(size=(20_000, 32))
    share, found = share_and_recall(x / np.linalg.norm(x, axis=1, keepdims=True), range(0, 20_000, 400))
    assert found >= 0.9 and share <= 0.2, (found, share)


def test_neighbouring_buckets_share_a_part(monkeypatch):
    monkeypatch.setattr(N, "GROUP_ROWS", 10)
    size = np.array([3, 4, 0, 9, 25, 2, 10, 0])
    first, split = N.directory(size)
    assert split.tolist() == [1, 1, 0, 1, 3, 1, 1, 0]
    held = {}
    for b, (f, k) in enumerate(zip(first.tolist(), split.tolist())):
        for part in range(f, f + k):
            held.setdefault(part, []).append(b)
    assert all(sum(-(-size[b] // split[b]) for b in bs) <= 19 for bs in held.values())
    assert all(len(bs) == 1 for bs in held.values() if 4 in bs)

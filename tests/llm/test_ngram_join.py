from __future__ import annotations

import random
from collections import Counter

import numpy as np

from tests.llm.helpers import DOCS, SMALL, corpus, frame, words
from tidemark.llm import ngram_join as J
from tidemark.llm.components import components

LOWER = {c: c + 32 for c in range(65, 91)}


def sets(rows, n=5):
    out = {}
    for i, t in rows:
        w = words((t or "").translate(LOWER))
        out[i] = frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    return out


def brute(rows, n=5, threshold=75):
    own, parent = sets(rows, n), {}
    parent = {i: i for i in own}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = {}
    for i, s in own.items():
        for g in s:
            held.setdefault(g, []).append(i)
    for i, s in own.items():
        for j, k in Counter(j for g in s for j in held[g] if j < i).items():
            if 100 * k >= threshold * (len(s) + len(own[j]) - k):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in own.items()}


def got(df):
    return {r.id: (r.n_grams, r.component) for r in J.join(df).collect()}


def test_agrees_with_brute_force(spark, monkeypatch):
    for seed, frequent in ((1, 64), (2, 2)):
        monkeypatch.setattr(J, "FREQUENT", frequent)
        texts = corpus(seed, 120)
        assert got(frame(spark, texts).repartition(5)) == brute(list(enumerate(texts)))


def test_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(J, "TREE", 8)
    monkeypatch.setattr(J, "GROUP", 32)
    monkeypatch.setattr(J, "PIVOTS", 2)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    assert got(frame(spark, texts)) == brute(list(enumerate(texts)))


def test_the_threshold_is_met_exactly(spark):
    # 75 common n-grams of 100 either way, and one less
    base = [f"a{i}" for i in range(91)]
    other = base[:79] + [f"b{i}" for i in range(12)]
    own = sets([(0, " ".join(base)), (1, " ".join(other))])
    k = len(own[0] & own[1])
    assert (100 * k >= 75 * (len(own[0]) + len(own[1]) - k)) is True
    assert got(frame(spark, [" ".join(base), " ".join(other)]))[1][1] == 0
    less = base[:78] + [f"b{i}" for i in range(13)]
    rows = [(0, " ".join(base)), (1, " ".join(less))]
    assert got(frame(spark, [t for _, t in rows])) == brute(rows)


def test_odd_tables(spark):
    assert J.join(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(None, "a b c d e f", None, None, None), (1, "a b", None, None, None), (2, "A  B", None, None, None), (3, None, None, None, None), (4, "", None, None, None), (4, "", None, None, None), (5, "a b c", None, None, None), (1, "a b", None, None, None)]
    out = sorted(((r.id, r.n_grams, r.component) for r in J.join(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert out == sorted([(None, None, None), (1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4), (5, 1, 5)], key=str)


def test_prefix_tree_finds_what_pairs_find():
    rng = np.random.default_rng(0)
    for _ in range(60):
        pool = rng.choice(10**6, 40, replace=False).astype(np.uint64)
        own = [np.sort(rng.choice(pool, int(rng.integers(1, 40)), replace=False)) for _ in range(25)]
        own += [own[0].copy(), own[1][:1].copy()]
        tree = J.PrefixTree(own)
        for probe in own:
            for threshold in (30, 75, 100):
                want = [i for i, s in enumerate(own) if 100 * len(np.intersect1d(s, probe)) >= threshold * len(np.union1d(s, probe))]
                assert sorted(tree.search(probe, threshold)) == want


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    out = components(spark.createDataFrame(edges, "a long, b long")).collect()
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {r.id: r.component for r in out} == {x: root(x) for x in linked} and len(out) == len(linked)


def test_query(spark):
    from tidemark.llm.queries import op3_ngram_join

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op3_ngram_join(spark, SMALL).collect()} == brute(rows)


def near_copies(size, seed=5, length=60):
    """Copies of one text, each with a few words changed: many link only through the text itself."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(length)]
    out = [" ".join(base)]
    for _ in range(size - 1):
        w = list(base)
        w[rng.randrange(length)] = f"z{rng.randrange(10**9)}"
        out.append(" ".join(w))
    return out


def unlinked(size, seed=6):
    """Texts of which half is one passage: they share n-grams, and none links."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    return [" ".join(passage + [f"q{rng.randrange(10**9)}" for _ in range(40)]) for _ in range(size)]


def made(spark, texts, lead):
    """Rows that meet in groups, and links that groups give."""
    sets = J._classes(frame(spark, texts), "doc_id", "text", 5, 75)[3].withColumn("label", J.F.col("id")).cache()
    met = sets.select("id", "n", "grams", "label").mapInArrow(J._posted(4, 75, lead), J._POSTED).groupBy("bucket").applyInArrow(J._lists, J._MET).distinct().count()
    return met, J._round(sets, 75, 4, lead).count()


def test_rows_follow_the_size_of_a_group(spark, monkeypatch):
    for texts in (near_copies, unlinked):
        for lead in (4, None):
            small, large = made(spark, texts(150), lead), made(spark, texts(300), lead)
            assert all(y <= 2.6 * x + 20 for x, y in zip(small, large, strict=True)), (texts.__name__, lead, small, large)
    assert got(frame(spark, near_copies(300) + unlinked(100))) == brute(list(enumerate(near_copies(300) + unlinked(100))))


def test_all_links_between_classes(spark, monkeypatch):
    texts = corpus(7, 100) + near_copies(40)
    own = sets(list(enumerate(texts)))
    least = {}
    for i in sorted(own):
        least.setdefault(own[i], i)
    classes = sorted({least[s] for s in own.values() if s})
    want = {(a, b) for a in classes for b in classes if a < b and 100 * len(own[a] & own[b]) >= 75 * len(own[a] | own[b])}
    for tree in (2048, 8):
        monkeypatch.setattr(J, "TREE", tree)
        members, found = J.links(frame(spark, texts))
        rows = [(r.a, r.b) for r in found.collect()]
        assert set(rows) == want and len(rows) == len(want)
        assert all(least[own[r.id]] == r["class"] for r in members.collect())

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, SMALL, corpus, words
from tidemark.llm import arrays as A
from tidemark.llm import pitman_yor as Y

LOWER = {c: c + 32 for c in range(65, 91)}
END = None


def tokens(text):
    return [*words((text or "").translate(LOWER)), END]


def base(rows):
    """n_tokens, n_known, train_tokens and the base score of each row, by definition."""
    c = Counter(t for _, train, text in rows if train for t in tokens(text))
    n, v = sum(c.values()), len(c)
    return {i: (len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n, sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(x))) for i, _, x in rows}


def rows_of(seed, n=40):
    return [(i, i % 4 != 0, t) for i, t in enumerate(corpus(seed, n))]


def scored(spark, rows, parts=3, **sweeps):
    df = spark.createDataFrame([(i, t, "en" if train else "de", "s", 0) for i, train, t in rows], DOCS).repartition(parts)
    return {r.id: r for r in Y.score(df, F.col("lang") == "en", **sweeps).collect()}


def test_base_scores_are_exact(spark, monkeypatch):
    for seed, size in ((1, 6 << 20), (2, 400)):
        monkeypatch.setattr(Y, "CHUNK_BYTES", size)
        rows = rows_of(seed)
        want, got = base(rows), scored(spark, rows)
        for i, train, _ in rows:
            r = got[i]
            assert (r.train, r.n_tokens, r.n_known, r.train_tokens) == (train, *want[i][:3])
            assert math.isclose(r.base, want[i][3], rel_tol=1e-9)
            assert r.score < 0


def test_seating_is_consistent():
    rng = np.random.default_rng(0)
    c = np.concatenate([rng.integers(1, 6, 300), [500, 90, 65, 64]])
    keys = A.mix(np.arange(len(c), dtype=np.uint64))
    s = Y.Seating(c, keys)
    for number, new in enumerate((0.01, 3.0, 500.0)):
        s = Y.Seating(c, keys, s.t, s.sizes(), number)
        s.sweep(np.full(len(c), new), 0.6)
        assert (s.t >= 1).all() and (s.t <= c).all() and (s.t[c == 1] == 1).all()
        owner = np.searchsorted(s.place_of, np.flatnonzero(s.size), side="right") - 1
        assert (np.bincount(owner, minlength=len(s.many)) == s.t[s.many]).all()
        assert (np.bincount(s.table, minlength=len(s.size)) == s.size).all()
        assert np.add.reduceat(s.sizes(), s.t.cumsum() - s.t).tolist() == c.tolist()
    assert s.t[300] > 100


def test_customers_come_and_go():
    rng = np.random.default_rng(1)
    c = rng.integers(1, 30, 400)
    keys = A.mix(np.arange(len(c), dtype=np.uint64))
    s = Y.Seating(c, keys)
    s.sweep(np.full(len(c), 2.0), 0.5)
    for number in range(1, 6):
        c = np.maximum(1, c + rng.integers(-9, 10, 400))
        s = Y.Seating(c, keys, s.t, s.sizes(), number)
        assert np.add.reduceat(s.sizes(), s.t.cumsum() - s.t).tolist() == c.tolist()
        s.sweep(np.full(len(c), 2.0), 0.5)


def test_seating_follows_the_restaurant():
    """Many copies of one dish: the tables' number follows the exact distribution of its partitions."""
    c, discount, new = 4, 0.5, 2.0

    def weight(sizes):
        return new ** len(sizes) * np.prod([np.prod([1 - discount + k for k in range(n - 1)]) for n in sizes])

    exact, ways = np.zeros(c + 1), {(4,): 1, (3, 1): 4, (2, 2): 3, (2, 1, 1): 6, (1, 1, 1, 1): 1}
    for sizes, n in ways.items():
        exact[len(sizes)] += n * weight(sizes)
    every, keys = np.full(20_000, c), A.mix(np.arange(20_000, dtype=np.uint64))
    s = Y.Seating(every, keys)
    for number in range(12):
        s = Y.Seating(every, keys, s.t, s.sizes(), number)
        s.sweep(np.full(20_000, new), discount)
    assert np.allclose(np.bincount(s.t, minlength=c + 1) / 20_000, exact / exact.sum(), atol=0.02)


def test_seating_of_larger_dishes():
    """As above for more customers, by generalised Stirling numbers."""
    c, discount, new, dishes = 30, 0.7, 1.5, 4000
    ways = np.zeros(c + 2)
    ways[1] = 1
    for n in range(1, c):
        t = np.arange(1, c + 2)
        ways[1:] = ways[:-1] + np.maximum(n - discount * t, 0) * ways[1:] * (t <= n)
    exact = ways[: c + 1] * new ** np.arange(c + 1)
    exact /= exact.sum()
    every, keys = np.full(dishes, c), A.mix(np.arange(dishes, dtype=np.uint64))
    s, met = Y.Seating(every, keys), np.zeros(c + 1)
    for number in range(24):
        s = Y.Seating(every, keys, s.t, s.sizes(), number)
        s.sweep(np.full(dishes, new), discount)
        if number >= 12:
            met += np.bincount(s.t, minlength=c + 1)
    assert np.allclose(met / met.sum(), exact, atol=0.01)


def test_a_sweep_draws_little(monkeypatch):
    """Rare dishes, most of a corpus, need hardly more than a draw for each customer: who can join one table only needs no other."""
    drawn, bits = [], Y.Seating._bits
    monkeypatch.setattr(Y.Seating, "_bits", lambda self, keys: drawn.append(len(keys)) or bits(self, keys))
    c = np.repeat([2, 3, 4, 10], [8000, 2000, 1000, 200])
    keys = A.mix(np.arange(len(c), dtype=np.uint64))
    s = Y.Seating(c, keys)
    for number in range(1, 5):
        s = Y.Seating(c, keys, s.t, s.sizes(), number)
        drawn.clear()
        s.sweep(np.full(len(c), 0.5), 0.8)
        assert sum(drawn) < 3 * c.sum()


def test_who_leaves_has_the_least_draws(monkeypatch):
    """The customers of each dish that shrinks are put in order only as far as they may leave, with the same result."""
    rng = np.random.default_rng(6)
    before = rng.integers(1, 400, 300)
    c = np.maximum(1, before - rng.integers(-5, 9, 300))
    c[:20] = 1
    keys = A.mix(np.arange(len(c), dtype=np.uint64))
    first = before.cumsum() - before
    ordered, lexsort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda by: ordered.append(len(by[0])) or lexsort(by))
    s = Y.Seating(c, keys)
    left, want = s._leaving(keys, before, c, first), set()
    for i in np.flatnonzero(before > c):
        s.salt = 0
        draws = s._draw(A.mix(keys[i] + np.arange(before[i], dtype=np.uint64) * Y._CUSTOMER))
        want |= {int(first[i] + j) for j in np.argsort(draws, kind="stable")[: before[i] - c[i]]}
    assert set(left.tolist()) == want and len(left) == len(want)
    assert sum(ordered) < before.sum() / 2


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    word, context = np.repeat(np.arange(30), 5), np.tile(np.arange(5), 30)
    c = rng.integers(0, 4, 150)
    c[word == 29] = 0
    total, kinds = np.bincount(word, c, 30).astype(int), np.bincount(word, c > 0, 30)
    customers, tables = kinds, (kinds > 0).astype(int)
    head = Y.Head(int((total > 0).sum()), int(total.sum()), (3, 2), (4, 1), int(kinds.sum()), int(tables.sum()))
    some, of = np.flatnonzero(c), np.bincount(context, c > 0, 5)
    keys = A.mix(np.arange(150, dtype=np.uint64))
    s = head.seated(c[some], keys[some], head.parent(customers, tables)[word[some]], of[context[some]], None, 1)
    t = np.zeros(150, np.int64)
    t[some] = s.t
    customers = np.bincount(word, t, 30).astype(int)
    met = np.flatnonzero(customers)
    tables = np.zeros(30, np.int64)
    tables[met] = head.seated_parent(customers[met], keys[:30][met], None, 1).t
    head = head.then(int(customers.sum()), int(tables.sum()))
    p = head.probability(c, t, np.bincount(context, c, 5)[context], np.bincount(context, t, 5)[context], head.parent(customers, tables)[word])
    # all words of training, and the unknown one: word 29 stands for it
    known = total > 0
    assert known[29] == False  # noqa: E712
    for k in range(5):
        assert math.isclose(p[(context == k) & (known[word] | (word == 29))].sum(), 1.0, rel_tol=1e-9)


def test_contexts_help(spark):
    rng = np.random.default_rng(3)
    follow = {i: (i * 7 + 3) % 50 for i in range(50)}

    def draw():
        w = [int(rng.integers(50))]
        for _ in range(60):
            w.append(follow[w[-1]] if rng.random() < 0.8 else int(rng.integers(50)))
        return " ".join(f"w{x}" for x in w)

    got = scored(spark, [(i, i % 4 != 0, draw()) for i in range(80)])
    held = [r for r in got.values() if not r.train]
    assert sum(r.score for r in held) > 0.7 * sum(r.base for r in held)


def test_the_same_in_every_layout(spark, monkeypatch):
    rows = rows_of(4)
    first = scored(spark, rows, 1)
    for parts, size in ((1, 4 << 20), (3, 4 << 20), (6, 500)):
        monkeypatch.setattr(Y, "CHUNK_BYTES", size)
        assert scored(spark, rows, parts) == first


def plainly_seated(rows, sweeps, burn_in, seed):
    """Mean log10 probabilities of the texts by a sampler that moves one customer at a time, through both levels."""
    rng = random.Random(seed)
    pairs = Counter((u, w) for _, train, text in rows if train for u, w in zip(["<s>", *tokens(text)], tokens(text)))
    kinds, v, n = Counter(w for _, w in pairs), len({w for _, w in pairs}), Counter()
    for (u, _), k in pairs.items():
        n[u] += k
    once = lambda xs: Y.discount(sum(x == 1 for x in xs), sum(x == 2 for x in xs))
    d1, d0, s0 = once(pairs.values()), once(kinds.values()), Y.STRENGTH
    at = {p: [k] for p, k in pairs.items()}  # sizes of tables
    root = {w: [k] for w, k in kinds.items()}
    in_context, m, r = Counter(u for u, _ in pairs), len(pairs), len(root)

    def parent(w):
        return (sum(root.get(w, [])) - d0 * len(root.get(w, [])) + (s0 + d0 * r) / (v + 1)) / (s0 + m)

    def leave(sizes):
        i = rng.choices(range(len(sizes)), sizes)[0]
        sizes[i] -= 1
        if not sizes[i]:
            del sizes[i]
            return True
        return False

    def sit(sizes, d, new):
        i = rng.choices(range(len(sizes) + 1), [*(x - d for x in sizes), new])[0]
        if i == len(sizes):
            sizes.append(1)
            return True
        sizes[i] += 1
        return False

    total = defaultdict(float)
    texts = [(i, list(zip(["<s>", *tokens(x)], tokens(x)))) for i, _, x in rows]
    for sweep in range(sweeps):
        for (u, w), k in pairs.items():
            for _ in range(k):
                if leave(at[u, w]):
                    in_context[u] -= 1
                    m -= 1
                    r -= leave(root[w])
                if sit(at[u, w], d1, (s0 + d1 * in_context[u]) * parent(w)):
                    in_context[u] += 1
                    r += sit(root[w], d0, (s0 + d0 * r) / (v + 1))
                    m += 1
        if sweep >= burn_in:
            for i, x in texts:
                total[i] += sum(math.log10((pairs.get(p, 0) - d1 * len(at.get(p, [])) + (s0 + d1 * in_context[p[0]]) * parent(p[1])) / (s0 + n[p[0]])) for p in x)
    return {i: x / (sweeps - burn_in) for i, x in total.items()}


def test_scores_are_near_those_of_a_plain_sampler(spark):
    rng = random.Random(3)
    draw = lambda: " ".join(f"w{min(int(rng.expovariate(0.15)), 40)}" for _ in range(rng.randint(5, 60)))
    rows = [(i, i % 5 != 0, draw()) for i in range(50)]
    got, want = scored(spark, rows, burn_in=4, samples=8), plainly_seated(rows, 60, 15, 1)
    for i, _, text in rows:
        assert abs(got[i].score - want[i]) < 0.02 * len(tokens(text)), (i, got[i].score, want[i])
    assert abs(sum(r.score for r in got.values()) / sum(want.values()) - 1) < 0.01


def test_odd_tables(spark):
    nothing = spark.createDataFrame([], DOCS)
    assert Y.score(nothing, F.lit(True)).collect() == []
    rows = [(None, "a b", None, None, None), (1, None, None, None, None), (2, "a", None, None, None), (2, "a", None, None, None), (3, "x y " * 100_000, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted(((str(r.id), r.train, r.n_tokens) for r in Y.score(df, F.lit(None).cast("boolean")).collect()))
    assert got == [("1", False, 1), ("2", False, 2), ("2", False, 2), ("3", False, 200_001), ("None", False, 3)]
    assert {r.score for r in Y.score(df, F.lit(False)).collect()} == {0.0}
    got = Y.score(df, F.col("doc_id") == 2).collect()
    assert {r.train_tokens for r in got} == {4} and sum(r.train for r in got) == 2


def test_query(spark):
    from tidemark.llm.queries import op10_lm_scoring

    docs = [(r.doc_id, zlib.crc32(str(r.doc_id).encode()) % 10 != 0, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = base(docs)
    sums = defaultdict(float)
    for r in op10_lm_scoring(spark, SMALL).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and math.isclose(r.base_score, want[r.doc_id][3], rel_tol=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        if r.held_out:
            sums["base"] += r.base_score
            sums["score"] += r.score
    assert sums["score"] > sums["base"]


def test_hashes_of_ends_and_words_differ():
    import pyarrow as pa

    data, rows = A.text_bytes(pa.array(["A b", None]))
    row, token, before = Y.tokens(data, rows)
    assert row.tolist() == [0, 0, 0, 1] and token[2] == token[3] == Y._END and before[0] == before[3] == Y._START and before[1] == token[0]


def test_each_word_before_has_its_restaurant(spark):
    """What follows a rare word is learnt from that word alone, however many other words there are."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"a{i} b{i}" for i in rng.permutation(6000)[:600]) for _ in range(50)]
    got = scored(spark, [(i, i % 4 != 0, t) for i, t in enumerate(texts)], parts=4)
    held = [r for r in got.values() if not r.train]
    # of each two words the second follows from the first, so the score is near half of the base
    assert sum(r.score for r in held) > 0.63 * sum(r.base for r in held)

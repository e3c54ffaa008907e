from __future__ import annotations

import hashlib

from tests.llm.helpers import DOCS, corpus, frame, words
from tidemark.llm import substrings as S


def brute(rows, window):
    own = {i: words(t) for i, t in rows}
    first = {}
    for i in sorted(own):
        for p in range(len(own[i]) - window + 1):
            first.setdefault(tuple(own[i][p : p + window]), i)
    out = {}
    for i, w in own.items():
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def got(df, **more):
    return {r.id: (r.n_words, r.n_removed, r.kept) for r in S.remove_repeated(df, **more).collect()}


def test_agrees_with_brute_force(spark, monkeypatch):
    for seed, chunk in ((1, 1 << 20), (2, 300)):
        monkeypatch.setattr(S, "CHUNK_WORDS", chunk)
        texts = corpus(seed, 90)
        for window in (50, 7):
            assert got(frame(spark, texts).repartition(5), window=window) == brute(list(enumerate(texts)), window)


def test_windows_are_judged_on_the_input(spark):
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    texts = [" ".join(a), " ".join(a + b), " ".join(b), " ".join(a[:49])]
    assert {k: v[1] for k, v in got(frame(spark, texts)).items()} == {0: 0, 1: 60, 2: 60, 3: 0}


def test_odd_tables(spark):
    assert S.remove_repeated(spark.createDataFrame([], DOCS)).collect() == []
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long, None, None, None), (1, long, None, None, None), (1, long, None, None, None), (2, None, None, None, None), (3, long, None, None, None), (4, "x " * 300_000, None, None, None)]
    out = sorted(((r.id, r.n_words, r.n_removed) for r in S.remove_repeated(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert out == sorted([(None, 60, 0), (1, 60, 0), (2, 0, 0), (3, 60, 60), (4, 300_000, 0)], key=str)


def test_clean_texts_keeps_columns(spark):
    texts = corpus(3, 60)
    df = frame(spark, texts)
    want = brute(list(enumerate(texts)), 50)
    out = {r.doc_id: r for r in S.clean_texts(df).collect()}
    assert set(out) == {i for i, (n, gone, _) in want.items() if not gone or gone < n}
    for i, r in out.items():
        assert r.text == (want[i][2] if want[i][1] else texts[i])
        assert (r.id, r.n, r.bucket, r.score) == ("x", 1, "y", 2.5)


def test_query_digests(spark):
    from tests.llm.helpers import SMALL
    from tidemark.llm.queries import op4_substring_dedup

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = {i: (n, g, hashlib.sha256(k.encode()).hexdigest()) for i, (n, g, k) in brute(rows, 50).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op4_substring_dedup(spark, SMALL).collect()} == want


def runs(df, window=50):
    return sorted(tuple(r) for r in S.repeated_runs(df, window=window).collect())


def test_runs_name_their_source(spark, monkeypatch):
    a, b, c = ([f"{x}{i}" for i in range(60)] for x in "abc")
    texts = [" ".join(x) for x in (a + b, c + a, ["z"] + a + b, a[:55] + c[5:])]
    # document 2 goes on from a to b as document 0 does; document 3 leaves a for c before either ends
    want = [(1, 60, 60, 0, 0), (2, 1, 120, 0, 0), (3, 0, 55, 0, 0), (3, 55, 55, 1, 5)]
    for chunk in (1 << 20, 100):
        monkeypatch.setattr(S, "CHUNK_WORDS", chunk)
        assert runs(frame(spark, texts)) == want


def test_runs_hold_equal_words(spark, monkeypatch):
    texts = corpus(4, 90)
    own = [words(t) for t in texts]
    for chunk in (1 << 20, 300):
        monkeypatch.setattr(S, "CHUNK_WORDS", chunk)
        found = runs(frame(spark, texts).repartition(4), 7)
        assert found
        for i, first, n, source, at in found:
            assert source < i and own[i][first : first + n] == own[source][at : at + n]


def test_many_runs_of_one_source(spark, monkeypatch):
    monkeypatch.setattr(S, "PATHS_A_ROW", 2)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base)] + [" ".join(base[i : 2 * i + 60]) for i in range(30)]
    assert got(frame(spark, texts).repartition(6)) == brute(list(enumerate(texts)), 50)


def test_equal_hashes_remove_nothing_unseen(spark):
    import numpy as np
    import pyarrow as pa
    import pytest

    data = np.frombuffer(b"a b c\td", np.uint8)
    proof = S.blake2b(b"b c", digest_size=16).digest()
    ids, rows = pa.array([7]), np.array([0, len(data)])
    paths = lambda first, words: pa.array([[{"first": first, "words": words, "proof": proof}]], S._PATHS)
    assert S._cleaned(ids, data, rows, paths(1, 2)).column("kept").to_pylist() == ["a d"]
    for first, words in ((0, 2), (2, 2), (3, 2)):
        with pytest.raises(ValueError):
            S._cleaned(ids, data, rows, paths(first, words))

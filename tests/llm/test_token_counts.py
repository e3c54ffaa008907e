from __future__ import annotations

import math

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import DOCS, SMALL, corpus, frame, words
from tidemark.llm import token_counts as C

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = C.vocabulary(PATH)
TINY = ({"▁": -1.0, "a": -2.0, "b": -2.0, "ab": -2.5, "aba": -3.0, "▁a": -2.0, "ba": -2.4}, 3, -9.0)


def brute(text, model):
    """Best score and pieces of every segmentation of a pre-token, by recursion on its end."""
    scores, longest, byte = model
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        options = [(best[b][0] + scores[text[b:end]], end - b, best[b][1] + 1) for b in range(max(0, end - longest), end) if text[b:end] in scores]
        if text[end - 1] not in scores:
            n = len(text[end - 1].encode())
            options.append((best[end - 1][0] + n * byte, 0, best[end - 1][1] + n))
        top = max(o[0] for o in options)
        best.append(next((s, k) for s, _, k in options if s == top))
    return best[-1][1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abé", min_size=1, max_size=12), min_size=1, max_size=20))
def test_shared_prefixes_give_the_counts_of_single_ones(texts):
    trie = C.Trie(*TINY)
    for text in texts:
        assert trie.insert("▁" + text) == brute("▁" + text, TINY)
    prefixes = {("▁" + t)[:i] for t in texts for i in range(len(t) + 2)}
    assert len(trie.best) == len(prefixes)


def test_one_trie_serves_many_batches(monkeypatch):
    counts = C.Counts(*TINY)
    for some in ({"aba", "ab"}, {"abab", "abaa"}, {"aba", "b"}):
        counts.add(some)
    assert len(counts.trie.best) == len({("▁" + w)[:i] for w in counts for i in range(len(w) + 2)})
    monkeypatch.setattr(C, "NODES", 6)
    for some in ({"baba", "bb"}, {"abbbbbbbbb", "aé"}):
        counts.add(some)
        assert all(counts[w] == brute("▁" + w, TINY) for w in some) and len(counts.trie.best) <= 32


def test_the_store_is_bounded(monkeypatch):
    monkeypatch.setattr(C, "STORED", 4)
    counts = C.Counts(*TINY)
    for some in ({"a", "b", "ab"}, {"aba", "ba"}, {"a", "é"}):
        counts.add(some)
        assert all(counts[w] == brute("▁" + w, TINY) for w in some)


def test_columns(spark):
    texts = [*corpus(8, 30), "x" * 3000, "😀 é"]
    got = {r.id: (r.n_words, r.n_tokens) for r in C.count_tokens(frame(spark, texts), PATH).collect()}
    assert got == {i: (len(words(t)), sum(brute("▁" + w, MODEL) for w in words(t))) for i, t in enumerate(texts)}
    assert C.count_tokens(spark.createDataFrame([], DOCS), PATH).collect() == []
    rows = [(None, None, None, None, None), (1, "a a", None, None, None), (1, "a a", None, None, None)]
    assert sorted((str(r.id), r.n_words) for r in C.count_tokens(spark.createDataFrame(rows, DOCS), PATH).collect()) == [("1", 2), ("1", 2), ("None", 0)]


def test_scores_are_log_probabilities():
    scores, _, byte = MODEL
    assert math.isclose(sum(map(math.exp, scores.values())) + math.exp(byte), 1.0, rel_tol=1e-9)


def test_query(spark):
    from tidemark.llm.queries import op6_token_counts

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    known = {}
    for r in op6_token_counts(spark, SMALL).collect():
        for w in words(docs[r.doc_id]):
            if w not in known:
                known[w] = brute("▁" + w, MODEL)
        assert r.n_tokens == sum(known[w] for w in words(docs[r.doc_id]))

from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import words
from tidemark.llm import arrays as A

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aBé \t\n\x0b\x1c", max_size=40)), max_size=12)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_are_found_and_named_alike(texts):
    data, rows = A.text_bytes(pa.array(texts, pa.string()))
    starts, ends, first = A.split_words(data, rows)
    want = [words(t) for t in texts]
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends)] == sum(want, [])
    assert np.diff(first).tolist() == [len(w) for w in want]
    names = {}
    for h, w in zip(A.hash_words(data, starts, ends).tolist(), sum(want, [])):
        assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)
    folded = dict(zip(A.hash_words(data, starts, ends, fold=True).tolist(), sum(want, [])))
    assert len(folded) == len({w.translate({ord("B"): "b"}) for w in sum(want, [])})


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 9))
def test_runs_of_words_are_named_by_their_words(codes, k):
    words_ = A.mix(np.array(codes, np.uint64))
    got = A.hash_runs(words_, k, 1)
    runs = [tuple(codes[i : i + k]) for i in range(len(codes) - k + 1)]
    assert len(got) == len(runs)
    assert len({(r, int(h)) for r, h in zip(runs, got)}) == len(set(runs)) == len(set(got.tolist()))


def test_long_words_and_segments(monkeypatch):
    monkeypatch.setattr(A, "_SEGMENT", 64)
    monkeypatch.setattr(A, "_powers", [])
    text = " ".join(["x" * 500, "ab", "cd" * 30, "ab"] * 20)
    data, rows = A.text_bytes(pa.array([text]))
    starts, ends, _ = A.split_words(data, rows)
    cut = A.hash_words(data, starts, ends)
    assert len(set(cut.tolist())) == 3
    monkeypatch.undo()
    assert (A.hash_words(data, starts, ends) == cut).all()


def test_positions_round_trip():
    for top in (0, 5, 70_000, 1 << 33):
        x = np.array([0, top])
        assert A.unpack_positions(A.pack_positions(x)).tolist() == [0, top]
    assert A.unpack_positions(A.pack_positions(np.empty(0, np.int64))).tolist() == []

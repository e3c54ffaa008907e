from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import DOCS, SMALL, corpus, frame
from tidemark.llm import packing as P

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATHS[0])


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aZé'stl 12\n\t.,#%&ſ–“<|>endoftxü½ª²٣  \x1c\x85", max_size=60))
def test_ids_are_those_of_the_tokenizer(text):
    want = Tokenizer.from_file(PATHS[0]).encode(text, add_special_tokens=False).ids if not hasattr(test_ids_are_those_of_the_tokenizer, "t") else test_ids_are_those_of_the_tokenizer.t.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(P.vocabulary(*PATHS).ids(text), "<u4").tolist() == want


test_ids_are_those_of_the_tokenizer.t = Tokenizer.from_file(PATHS[0])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=40))
def test_sequences_are_filled(lengths):
    room = P.layout(sum(lengths), 16)
    used, docs = defaultdict(list), defaultdict(list)
    for doc, start, length, at, offset in P.assign(lengths, 16):
        used[at].append((offset, length))
        docs[doc].append((start, length))
    for pieces, whole in [*((used[i], n) for i, n in enumerate(room)), *((docs[i], n) for i, n in enumerate(lengths))]:
        at = 0
        for start, length in sorted(pieces):
            assert start == at and length > 0
            at += length
        assert at == whole
    assert all(n == 16 or n & (n - 1) == 0 for n in room)


def test_costs_are_balanced():
    rng = random.Random(1)
    lengths = [rng.randint(1, 600) for _ in range(400)]
    cost = defaultdict(float)
    for _, _, length, at, _ in P.assign(lengths, 2048):
        cost[at] += length + length * length / 2048
    full = [cost[i] for i, n in enumerate(P.layout(sum(lengths), 2048)) if n == 2048]
    assert max(full) < 1.35 * min(full)


def check(rows, docs, tokenizer, capacity=P.CAPACITY):
    want = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, P.END_ID] for _, t in docs]
    sequences, found = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        found[r.id].append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)
    by_id = defaultdict(list)
    for (i, _), ids in zip(docs, want):
        by_id[i].append(ids)
    for i, several in by_id.items():
        assert sum(r.length for r in found[i]) == sum(map(len, several))
        if len(several) == 1:
            assert sum((np.frombuffer(r.ids, "<u4").tolist() for r in sorted(found[i], key=lambda r: r.start)), []) == several[0]
            assert {r.doc_tokens for r in found[i]} == {len(several[0])}


def test_pieces_cover_every_text(spark, tokenizer):
    texts = [*corpus(4, 60), "x" * 9000, "word " * 5000, "<|endoftext|>", "½ ª   \x1c"]
    for block in (300, P.BLOCK_TOKENS):
        check(P.pack(frame(spark, texts).repartition(3), *PATHS, block_tokens=block).collect(), list(enumerate(texts)), tokenizer)


def test_odd_tables(spark, tokenizer):
    assert P.pack(spark.createDataFrame([], DOCS), *PATHS).collect() == []
    rows = [(None, "a b", None, None, None), (1, None, None, None, None), (2, "c", None, None, None), (2, "c", None, None, None)]
    check(P.pack(spark.createDataFrame(rows, DOCS), *PATHS).collect(), [(i, t) for i, t, *_ in rows], tokenizer)


def test_query(spark, tokenizer):
    from tidemark.llm.queries import op5_packing

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    total = defaultdict(int)
    for r in op5_packing(spark, SMALL).collect():
        ids = [*tokenizer.encode(docs[r.doc_id], add_special_tokens=False).ids, 1]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        total[r.doc_id] += r.length
    assert set(total) == set(docs)

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import DOCS, SMALL, corpus, frame
from tidemark.llm import tiff as T


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=400) | st.binary(max_size=6).map(lambda b: b * 700) | st.lists(st.integers(0, 3), max_size=3000).map(bytes))
def test_compression_round_trips(raw):
    assert T.unpackbits(T.packbits(raw)) == raw
    assert T.unlzw(T.lzw(raw)) == raw


def test_lzw_fills_its_table():
    raw = np.random.default_rng(0).integers(0, 256, 40_000, dtype=np.uint8).tobytes()
    assert T.unlzw(T.lzw(raw)) == raw
    # the example of the format's description
    assert T.lzw(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]))[:4] == bytes([0x80, 0x01, 0xE0, 0x40])


@pytest.mark.parametrize("compression", [T.NONE, T.LZW, T.DEFLATE, T.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_pages_round_trip(compression, predictor, tile, order):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 256, (h, w), dtype=np.uint8) for h, w in ((1, 64), (70, 64), (33, 50))]
    raw = T.write(pages, compression, predictor, strip_rows=20, tile=tile, order=order)
    got = list(T.read(raw))
    assert [p.samples.tolist() for p in got] == [p.tolist() for p in pages]
    assert {(p.compression, p.predictor) for p in got} == {(compression, predictor)}


def test_faults_are_told():
    for raw in (b"", b"II*\0", b"GIF89a..", b"II+\0" + bytes(20)):
        with pytest.raises(ValueError):
            list(T.read(raw))
    loop = bytearray(T.write([np.zeros((1, 64), np.uint8)]))
    loop[-4:] = loop[4:8]
    with pytest.raises(ValueError):
        list(T.read(bytes(loop)))


def want(text):
    raw = (text or "").encode()
    payload = raw + bytes(-len(raw) % 64 if raw else 64)
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])


def test_texts_are_stored_and_read_back(spark, monkeypatch):
    texts = [*corpus(5, 20), "é" * 100_000, "a" * 64, "a" * 65]
    df = frame(spark, [*texts, texts[3]])
    rows = {r.id: r for r in T.described_texts(df).collect()}
    assert {i: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for i, r in rows.items()} == {i: want(t) for i, t in enumerate([*texts, texts[3]])}
    assert rows[3][1:] == rows[len(texts)][1:]
    files = T.text_files(df)
    media = {r.id: r.media for r in files.collect()}
    assert all((len(media[i]), hashlib.sha256(media[i]).hexdigest()) == (r.media_bytes, r.media_sha256) for i, r in rows.items())
    pages = T.pages(files, "id", "media").collect()
    assert {i: b"".join(p.samples for p in sorted((p for p in pages if p.id == i), key=lambda p: p.page))[: rows[i].n_bytes].decode() for i in rows} == {i: t or "" for i, t in enumerate([*texts, texts[3]])}


def test_several_pages(monkeypatch):
    monkeypatch.setattr(T, "PAGE_ROWS", 3)
    n, raw = T.text_file("x" * 1000)
    pages = list(T.read(raw))
    assert n == 1000 and len(pages) == 6 and b"".join(p.samples.tobytes() for p in pages).rstrip(b"\0") == b"x" * 1000


def test_odd_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert T.described_texts(empty).collect() == [] and T.pages(T.text_files(empty), "id", "media").collect() == []
    rows = T.described_texts(spark.createDataFrame([(None, None, None, None, None)], DOCS)).collect()
    assert [(r.id, r.n_bytes, r.payload_bytes) for r in rows] == [(None, 0, 64)]


def test_query(spark):
    from tidemark.llm.queries import op7_tiff_media

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in op7_tiff_media(spark, SMALL).collect()} == {i: want(t) for i, t in docs.items()}


def test_a_faulty_file_is_a_row_with_its_fault(spark):
    good = T.write([np.full((3, 64), i, np.uint8) for i in range(2)], T.DEFLATE)
    rng = np.random.default_rng(2)
    files = [good, b"", b"GIF89a..", None, *(good[:k] for k in range(4, len(good), 7))]
    for _ in range(60):
        broken = bytearray(good)
        for _ in range(3):
            broken[int(rng.integers(4, len(good)))] = int(rng.integers(256))
        files.append(bytes(broken))
    for raw in files:
        try:
            list(T.read(raw or b""))
        except ValueError:
            pass
    rows = T.pages(spark.createDataFrame([(i, None if f is None else bytearray(f)) for i, f in enumerate(files[:20])], "id long, media binary"), "id", "media").collect()
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append(r)
    assert [r.error for r in by[0]] == [None, None] and 3 not in by
    for i in (1, 2):
        assert [(r.page, r.samples, bool(r.error)) for r in by[i]] == [(0, None, True)]


@pytest.mark.parametrize("size", [0, 1, 64, 5000])
def test_the_feature_by_plain_counting(size):
    text = "".join(chr(32 + i * 7 % 90) for i in range(size))
    _, raw = T.text_file(text)
    found = list(T.read(raw))
    values = list(text.encode().ljust(max(1, -(-size // 64)) * 64, b"\0"))
    mean = sum(values) / len(values)
    spread = (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5
    shares = ",".join(f"{sum(v // 32 == k for v in values) / len(values):.4f}" for k in range(8))
    assert T.feature(found) == f"pages={len(found)};rows={len(values) // 64};mean={mean:.4f};sd={spread:.4f};shares={shares}"

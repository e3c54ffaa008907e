from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import DOCS, SMALL, corpus, frame
from tidemark.llm import pieces as P

PATH = public_tokenizers.path("piece_bpe_32k.model")
OWN = {rate: P.Encoder(PATH, rate, 3) for rate in (0.0, 0.3, 1.0)}
PIECES = OWN[0.0].pieces
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXTS = st.text(max_size=80) | st.text(alphabet="the anding éß\n\t  ▁x😀", max_size=120)


def ids(encoder, text, doc=0):
    return np.frombuffer(encoder.encode(np.array([doc]), [text])[0], "<u4").tolist()


def one(encoder, text, doc=0):
    return encoder.encode(np.array([doc]), [text])[0]


M = (1 << 64) - 1


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ x >> 31


def plain(text, rate, seed, doc):
    """Merge-dropout pair by pair: the best pair beside each other whose span isn't skipped, until there is none."""
    out = []
    for place, segment in enumerate(P._SEGMENT.findall(" " + text) if text else []):
        key = mix(mix((doc + seed * 0x9E3779B97F4A7C15) & M) + place * 0xD1B54A32D192ED03 & M)
        skip = lambda a, b: rate >= 1 or mix(key + (a << 32 | b) * 0x8CB92BA72F3D8DD7 & M) < int(rate * 2**64)  # noqa: B023, E731
        symbols, at = [("\ud800" if c == P.MARK else P.MARK if c == " " else c) for c in segment], list(range(len(segment)))
        while True:
            best = None
            for i in range(len(symbols) - 1):
                found = PIECES.merged.get(symbols[i] + symbols[i + 1])
                end = at[i + 2] if i + 2 < len(at) else len(segment)
                if found and (best is None or found[0] < best[0]) and not skip(at[i], end):
                    best = found[0], i
            if best is None:
                break
            i = best[1]
            symbols[i : i + 2], at[i : i + 2] = [symbols[i] + symbols[i + 1]], [at[i]]
        for x in symbols:
            found = PIECES.merged.get(x)
            out += [found[1]] if found else [PIECES.byte_ids[b] for b in x.replace("\ud800", P.MARK).encode()]
    return out


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(-(2**63), 2**63 - 1))
def test_decoding_gives_the_text_back(text, doc):
    for own in OWN.values():
        assert own.decode(one(own, text, doc)) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="the anding éß\n  xqz0,.", max_size=120))
def test_without_dropout_it_is_the_models_segmentation(text):
    assert ids(OWN[0.0], text) == MODEL.encode(text)


@settings(max_examples=200, deadline=None)
@given(TEXTS | st.text(alphabet="theandig ", min_size=60, max_size=300), st.integers(0, 50))
def test_it_equals_plain_merge_dropout(text, doc):
    for rate, own in OWN.items():
        assert ids(own, text, doc) == plain(text, rate, 3, doc)


def test_an_occurrence_draws_for_itself():
    text = " ".join(["understanding"] * 300)
    own = P.Encoder(PATH, 0.3, 1)
    cuts, at = set(), 0
    for n in [len(x) for x in P._SEGMENT.findall(" " + text)]:
        found, size = [], 0
        while size < n:
            found.append(i := ids(own, text)[at])
            size, at = size + len(MODEL.id_to_piece(i)), at + 1
        cuts.add(tuple(found))
    assert len(cuts) > 20 and ids(own, text, 1) != ids(own, text, 2)


def test_any_ids_decode():
    own, n = OWN[0.0], MODEL.get_piece_size()
    text = lambda x: own.decode(np.array(x, "<u4").tobytes())
    byte = MODEL.piece_to_id("<0xC3>")
    assert text([]) == "" and text([n + 7]) == "\ufffd" and text([byte]) == "\ufffd" and text([MODEL.unk_id()]) == "\ufffd"
    assert text([i for i in range(n) if MODEL.is_control(i)]) == ""
    assert text([byte, MODEL.piece_to_id("<0xA9>")]) == "é"


def test_seeds_vary_and_repeat():
    text = " ".join(t or "" for t in corpus(6, 20)) + " internationalisation of understanding"
    first, again, other = (ids(P.Encoder(PATH, 0.3, seed), text) for seed in (1, 1, 2))
    assert first == again != other
    assert len(ids(OWN[1.0], text)) > len(first) > len(ids(OWN[0.0], text))
    assert OWN[0.0].decode(one(P.Encoder(PATH, 0.3, 9), text)) == text


def test_the_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(P, "CACHED_SEGMENTS", 2)
    own = P.Encoder(PATH, 0.2, 0)
    for text in ("a b c d a b", "e f", "g h", "a"):
        assert own.decode(one(own, text)) == text
    assert len(own.names) <= 4


def test_what_is_met_often_is_not_learned_again(monkeypatch):
    monkeypatch.setattr(P, "CACHED_SEGMENTS", 40)
    own, learned = P.Encoder(PATH, 0.2, 0), []
    learn = own._learn
    monkeypatch.setattr(own, "_learn", lambda new: (learned.extend(new), learn(new)))
    for i in range(60):
        text = "common words stand here and common words stand there " + " ".join(f"rare{i}x{k}" for k in range(9))
        assert ids(own, text, i) == plain(text, 0.2, 0, i)
    assert learned.count(" common") == learned.count(" words") == learned.count(" stand") == 1
    assert len(own.names) <= 40 + 16 and own.names == list(own.number) and len(own.names) == len(own.own) == len(own.first)


def test_only_merged_spans_make_a_run_anew(monkeypatch):
    """Of each occurrence that is run with skips, a span is skipped that the model's own run merges."""
    text = " ".join(t or "" for t in corpus(9, 40))
    own, rows = P.Encoder(PATH, 0.1, 4), []
    run = own._run
    monkeypatch.setattr(own, "_run", lambda numbers, *skips: (rows.extend(numbers.tolist() if skips else []), run(numbers, *skips))[1])
    ids(own, text, 5)
    want = []
    for place, segment in enumerate(P._SEGMENT.findall(" " + text)):
        spans = P.spans_of(segment, PIECES)
        key = P.occurrence_keys(4, np.array([5]), np.array([place]))
        cuts, merged = list(range(len(segment) + 1)), []
        while fitting := [(a, b) for _, a, b, _ in spans if a in cuts and b in cuts and cuts.index(b) == cuts.index(a) + 2]:
            merged.append(fitting[0])
            del cuts[cuts.index(fitting[0][0]) + 1]
        if any(P.skipped(key, np.array([a]), np.array([b]), 0.1)[0] for a, b in merged):
            want.append(segment)
    assert sorted(own.names[i] for i in rows) == sorted(want)


def test_long_texts_come_in_slabs(monkeypatch):
    text = " ".join(t or "" for t in corpus(8, 60))
    whole = ids(P.Encoder(PATH, 0.2, 0), text, 9)
    monkeypatch.setattr(P, "TOGETHER", 16)
    assert ids(P.Encoder(PATH, 0.2, 0), text, 9) == whole == plain(text, 0.2, 0, 9)


def test_columns(spark):
    texts = [*corpus(7, 30), "▁▁ x", "a" * 20_000]
    df = frame(spark, texts)
    back = {r.id: r.text for r in P.decode(P.encode(df, PATH, 0.2, 5), PATH).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    rows = P.checked(df, PATH, 0.2, 5).collect()
    assert all(r.lossless for r in rows) and len(rows) == len(texts)
    assert P.checked(spark.createDataFrame([], DOCS), PATH).collect() == []
    row = P.checked(spark.createDataFrame([(None, None, None, None, None)], DOCS), PATH).first()
    assert (row.id, row.n_tokens, row.ids_crc32, row.lossless) == (None, 0, 0, True)


def test_query(spark):
    from tidemark.llm.queries import op8_piece_dropout

    rows = {r.doc_id: r for r in op8_piece_dropout(spark, SMALL).collect()}
    assert len(rows) == 200 and all(r.lossless for r in rows.values())
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(40).collect():
        want = np.array(plain(r.text or "", P.RATE, 0, r.doc_id), "<u4")
        assert (rows[r.doc_id].n_tokens, rows[r.doc_id].ids_crc32) == (len(want), zlib.crc32(want.tobytes()))

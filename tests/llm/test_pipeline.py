from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as C
from tests.llm.helpers import DOCS, SMALL, frame
from tests.llm.test_ngram_join import brute as groups
from tests.llm.test_substrings import brute as cuts
from tidemark.llm.store import keep


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_against_brute_force(spark):
    assert [name for name, _ in C.STAGES] == ["language_id", "ngram_join", "substring_dedup", "packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("*", "'x' AS id", "1 AS score")
    before = rows(docs)
    kept = keep(C.STAGES[0][1](spark, docs, SMALL))
    after = rows(kept)
    assert kept.columns == docs.columns and all(before[i] == r for i, r in after.items()) and len(after) >= 0.99 * len(before)

    one = keep(C.STAGES[1][1](spark, kept, SMALL))
    want = groups([(i, r.text) for i, r in after.items()])
    assert set(rows(one)) == {i for i, (_, c) in want.items() if c == i} and one.columns == docs.columns

    cut = keep(C.STAGES[2][1](spark, one, SMALL))
    own = rows(one)
    want = cuts([(i, r.text) for i, r in own.items()], 50)
    found = rows(cut)
    assert set(found) == {i for i, (n, gone, _) in want.items() if not gone or gone < n} and cut.columns == docs.columns
    for i, r in found.items():
        assert r.text == (want[i][2] if want[i][1] else own[i].text) and r.n_chars == len(r.text)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 1], "<u4") for i, r in found.items()}
    for pieces in (C.STAGES[3][1](spark, cut, SMALL).collect(), C.run(spark, SMALL).collect()):
        ends = dict.fromkeys(ids, 0)
        for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
            own = ids[p.doc_id]
            assert p.start == ends[p.doc_id] and p.length > 0 and p.doc_tokens == len(own)
            ends[p.doc_id] += p.length
            assert p.ids_crc32 == zlib.crc32(own[p.start : p.start + p.length].tobytes())
        assert ends == {i: len(x) for i, x in ids.items()}


def test_documents_without_language_go(spark):
    good = [("The cat sat on the mat with the other cat. " * 3), ("Der Hund und die Katze sind im Haus. " * 3)]
    df = spark.createDataFrame([(0, good[0], "en", "s", 1), (1, good[1], "de", "s", 1), (2, "12 345 !!", "en", "s", 1), (3, None, "en", "s", 1), (4, "", None, "s", 1), (None, good[0], "en", "s", 1)], DOCS)
    assert sorted(str(r.doc_id) for r in C.known_language(spark, df, "").collect()) == ["0", "1", "None"]


def test_odd_tables(spark):
    for nothing in (spark.createDataFrame([], DOCS), spark.createDataFrame([(1, None, None, None, None)], DOCS)):
        for _, stage in C.STAGES[:-1]:
            assert stage(spark, nothing, "").columns == nothing.columns
        assert [(r.doc_id, r.start, r.length, r.doc_tokens, r.offset) for r in C.packed(spark, nothing, "").collect()] == [(1, 0, 1, 1, 0)] * nothing.count()
        assert C.known_language(spark, nothing, "").collect() == []
    text = " ".join(f"w{i}" for i in range(80))
    df = frame(spark, [text, text + " end", "other words stand here now"]).unionByName(frame(spark, [text, text + " end"]))
    assert sorted(r.doc_id for r in C.one_of_each_group(spark, df, "").collect()) == [0, 2]
    assert [(r.doc_id, r.text, r.n_chars) for r in C.without_repeats(spark, df, "").orderBy("doc_id").collect()] == [(0, text, len(text)), (1, "end", 3), (2, "other words stand here now", 26)]
    null = df.withColumn("doc_id", df.doc_id.cast("long")).limit(1).selectExpr("CAST(NULL AS LONG) AS doc_id", "* EXCEPT (doc_id)")
    for _, stage in C.STAGES[1:3]:
        assert len([r for r in stage(spark, df.unionByName(null), "").collect() if r.doc_id is None]) == 1
    twice = C.packed(spark, df.unionByName(null), "").collect()
    starts = sorted(((r.doc_id, r.doc_tokens) for r in twice if r.start == 0), key=str)
    assert [i for i, _ in starts] == [0, 0, 1, 1, 2, None] and sum(r.length for r in twice) == sum(n for _, n in starts)

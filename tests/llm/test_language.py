from __future__ import annotations

import math
import random
import zlib
from collections import Counter

from tests.llm.helpers import DOCS, SMALL
from tidemark.llm import language as L


def brute_score(model, text):
    """By the definition, word by word."""
    sums, n = [0.0] * len(model.languages), 0
    for word in L.words_of(text):
        if word in model.words:
            said = model.words[word]
        else:
            for order in L.ORDERS:
                found = [model.grams[order][g] for g in L.grams_of(word, order) if g in model.grams[order]]
                if found:
                    said = [sum(x) / len(found) for x in zip(*found)]
                    break
            else:
                continue
        n += 1
        sums = [a + b for a, b in zip(sums, said)]
    best = max(range(len(sums)), key=lambda i: sums[i])
    weight = min(n, L.EVIDENCE) / n if n else 0
    return model.languages[best], 1 / sum(math.exp(weight * (x - sums[best])) for x in sums)


def small_model():
    counts = Counter((lang, w) for lang, text in (("en", "the cat and the dog"), ("de", "der hund und die katze"), ("fr", "le chat et le chien")) for w in text.split())
    totals = Counter()
    for (lang, _), n in counts.items():
        totals[lang] += n
    return L.model([(lang, w, n) for (lang, w), n in counts.items()], dict(totals))


def test_words_go_first_and_n_grams_step_in():
    scorer = L.Scorer(small_model())
    assert scorer.score("the") == (scorer.model.words["the"], True)
    assert scorer.score("hunde")[1] is False  # ^hund is known
    assert scorer.score("жж") == (None, False)
    for text in ("The DOG", "hunde katzen", "chats", "x the жж", "und und und le"):
        lang, score, _, _ = scorer.predict(text)
        want, p = brute_score(scorer.model, text)
        assert lang == want and abs(score - p) < 1e-12


def test_words_are_runs_of_letters():
    rng = random.Random(5)
    some = "aÉßжλ中 ²½①Ⅷ٣7_-\n\U0001f100\U00010107\U00020000"
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 30))) for _ in range(2000)] + ["".join(map(chr, range(0xD800))), "".join(map(chr, range(0xE000, 0x110000)))]
    for text in texts:
        assert L.words_of(text) == "".join(c if c.isalpha() else " " for c in text.lower()).split()


def test_texts_without_evidence():
    scorer = L.Scorer(small_model())
    assert [scorer.predict(t)[:2] for t in (None, "", "123 !! _", " \n", "²½ ①", "Ⅷ ٣")] == [("und", 0.0)] * 6
    lang, score, n, known = scorer.predict("жж")
    assert lang == "de" and abs(score - 1 / 3) < 1e-12 and (n, known) == (1, 0.0)
    assert L.Scorer(L.model([], {})).predict("the")[0] == "und"


def test_the_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(L, "CACHED_WORDS", 3)
    scorer = L.Scorer(small_model())
    for _ in range(3):
        assert scorer.predict("the cat")[0] == "en" and scorer.predict("hund katze")[0] == "de" and scorer.predict("hund und katze und die")[0] == "de"
    assert len(scorer) <= 5


def test_the_sample_is_bounded(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "'a b c' AS text", "'en' AS lang")
    assert L.fit(rows, most=500).words.keys() == {"a", "b", "c"}
    nothing = L.fit(spark.createDataFrame([(1, None, "en", None, None), (2, "a", None, None, None)], DOCS))
    assert nothing.languages == []


def test_odd_tables(spark):
    model = small_model()
    assert L.predict(spark.createDataFrame([], DOCS), model).collect() == []
    rows = [(None, "the cat", None, None, None), (1, None, None, None, None), (2, "katze", None, None, None), (2, "katze", None, None, None), (3, "the " * 200_000, None, None, None)]
    got = sorted(((r.id, r.lang_pred) for r in L.predict(spark.createDataFrame(rows, DOCS), model).collect()), key=str)
    assert got == sorted([(None, "en"), (1, "und"), (2, "de"), (2, "de"), (3, "en")], key=str)
    whole = L.predict(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS score", "2 AS id"), model, whole_rows=True).select("row.*")
    assert whole.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "id"] and whole.count() == 5


def test_held_out_accuracy(spark):
    from tidemark.llm.queries import op1_language_id

    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = op1_language_id(spark, SMALL).collect()
    assert {r.doc_id for r in got} == set(docs) and len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    train = [r for r in docs.values() if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5]
    assert len(train) < L.TRAIN_DOCUMENTS  # so all of them are learnt from
    met = Counter((r.lang, w) for r in train for w in L.words_of(r.text))
    totals = {r.lang: sum(n for (lang, _), n in met.items() if lang == r.lang) for r in train}
    model = L.model([(lang, w, n) for (lang, w), n in met.items() if n >= L.WORD_LEAST], totals, L.GRAM_LEAST)
    for r in got:
        text = docs[r.doc_id].text
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            lang, p = brute_score(model, text)
            assert r.lang_pred == lang and abs(r.score - p) < 1e-9
    held = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out]
    assert sum(held) >= 0.97 * len(held)

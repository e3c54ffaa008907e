"""Language identification: known words first, then ever shorter character n-grams.

A text's words (runs of letters, lower-cased) are scored one by one.  A word of the model scores its log
frequency in each language.  Any other word falls back to its character n-grams with marked ends: of the
longest order that the model knows any of, the mean log frequency of the known ones; if not even a letter
is known, it says nothing.  The language of the largest sum wins.

The model is fitted on a bounded sample of labelled documents (about `TRAIN_DOCUMENTS` of each language, whole
texts, chosen by a hash of their id).  It holds every word that the sample has at least `WORD_LEAST` times in a
language, and their n-grams met at least `GRAM_LEAST` times; so the sample bounds it, and it can be broadcast.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.arrays import trim
from tidemark.llm.store import small_batches

#: Documents of a language that a model learns from, about, and how often a word or n-gram must be met there to be known.
TRAIN_DOCUMENTS = 3_000
WORD_LEAST, GRAM_LEAST = 4, 8
ORDERS = (5, 4, 3, 2, 1)
SMOOTHING = 0.5
#: The confidence counts at most so many words' evidence, at the mean of all.
EVIDENCE = 12
UNKNOWN = "und"
CACHED_WORDS = 100_000

#: Runs of letters and of numbers that aren't digits, such as ² or Ⅷ; the others are the rare ones that have such numbers.
_RUN = re.compile(r"[^\W\d_]+")
_NUMBERS = re.compile(f"[{''.join(c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())}]+")
_SCORED = "id long, lang_pred string, score double, n_words long, known_share double"
_SCORED_ARROW = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_words", pa.int64()), ("known_share", pa.float64())])


class Model(NamedTuple):
    languages: list[str]
    words: dict[str, tuple[float, ...]]
    grams: dict[int, dict[str, tuple[float, ...]]]


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    runs = _RUN.findall(text.lower())
    if "".join(runs).isalpha():
        return runs
    # matching those numbers is slow, so only runs that have them are split there
    return [word for run in runs for word in ([run] if run.isalpha() else _NUMBERS.split(run)) if word]


def grams_of(word: str, order: int) -> list[str]:
    marked = f"^{word}$" if order > 1 else word
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = defaultdict(Counter)

    def flush() -> pa.RecordBatch:
        rows = [(lang, word, n) for lang, c in counts.items() for word, n in c.items()]
        counts.clear()
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts[lang].update(words_of(text.as_py()))
        if sum(map(len, counts.values())) > 500_000:
            yield flush()
    if any(counts.values()):
        yield flush()


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", most: int = TRAIN_DOCUMENTS) -> Model:
    """A model of the rows with a text and a language; of more than about `most` rows of a language a sample by a hash of the id.

    It knows the sample's words and n-grams that are met often enough (WORD_LEAST, GRAM_LEAST).  The languages are the labels met; of a table without labelled rows, the model knows none.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    small_batches(rows.sparkSession)
    share = {r.lang: most / r["count"] for r in rows.groupBy("lang").count().collect() if r["count"] > most}
    bound = F.create_map(*(F.lit(x) for lang, part in share.items() for x in (lang, int(part * (1 << 20))))) if share else None
    drawn = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(20)), F.lit(1 << 20))
    sample = rows if bound is None else rows.filter(drawn < F.coalesce(bound[F.col("lang")], F.lit(1 << 20)))
    counts = sample.select("lang", "text").mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    known = counts.filter(F.col("n") >= WORD_LEAST)
    return model([(r.lang, r.word, r.n) for r in known.select("lang", "word", "n").collect()], totals, GRAM_LEAST)


def model(counts: list[tuple[str, str, int]], totals: dict[str, int], least: int = 1) -> Model:
    """From (language, word, count) of known words, and the number of all words of each language; n-grams met less often than `least` go."""
    languages = sorted(totals)
    at = {lang: i for i, lang in enumerate(languages)}
    words: dict[str, list[float]] = {}
    grams: dict[int, dict[str, list[float]]] = {order: {} for order in ORDERS}
    for lang, word, n in sorted(counts):
        words.setdefault(word, [0.0] * len(languages))[at[lang]] += n
        for order in ORDERS:
            for gram in grams_of(word, order):
                grams[order].setdefault(gram, [0.0] * len(languages))[at[lang]] += n
    out = {}
    for order, table in grams.items():
        out[order] = _logs({g: c for g, c in table.items() if sum(c) >= least}, [sum(c[i] for c in table.values()) for i in range(len(languages))])
    return Model(languages, _logs(words, [totals[lang] for lang in languages]), out)


def _logs(counts: dict[str, list[float]], totals: list[float]) -> dict[str, tuple[float, ...]]:
    base = [math.log(t + SMOOTHING * (len(counts) + 1)) for t in totals]
    return {x: tuple(math.log(n + SMOOTHING) - b for n, b in zip(c, base, strict=True)) for x, c in counts.items()}


class Scorer(dict):
    """Numbers of the words met lately; a word's row holds its scores, whether it says anything, and whether the model knows it."""

    def __init__(self, fitted: Model):
        self.model = fitted
        self.rows = np.zeros((1024, len(fitted.languages) + 2))

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        if at == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        scores, known = self.score(word)
        self.rows[at] = 0.0 if scores is None else (*scores, 1.0, known)
        return at

    def score(self, word: str) -> tuple[tuple[float, ...] | None, bool]:
        if (known := self.model.words.get(word)) is not None:
            return known, True
        for order in ORDERS:
            table = self.model.grams[order]
            if found := [table[g] for g in grams_of(word, order) if g in table]:
                return tuple(sum(x) / len(found) for x in zip(*found, strict=True)), False
        return None, False

    def predict(self, text: str | None) -> tuple[str, float, int, float]:
        """(language, confidence, number of words, share of them that the model knows)."""
        words = words_of(text or "")
        n = len(words)
        if not n or not self.model.languages:
            return UNKNOWN, 0.0, n, 0.0
        if len(self) + n > CACHED_WORDS:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, n)
        *sums, said, known = self.rows[at].sum(axis=0).tolist()
        weight = min(said, EVIDENCE) / said if said else 0.0
        best = max(range(len(sums)), key=lambda i: (sums[i], -i))
        score = 1 / sum(math.exp(max(-700.0, weight * (x - sums[best]))) for x in sums)
        return self.model.languages[best], score, n, known / n


_scorers: dict[str, Scorer] = {}


def _predicted(shared, token: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _scorers:  # one for each worker process
            _scorers.clear()
            _scorers[token] = Scorer(shared.value)
        scorer = _scorers[token]
        for batch in batches:
            if batch.num_rows:
                found = [scorer.predict(text.as_py()) for text in batch.column(1)]
                said = [pa.array(x, t.type) for x, t in zip(zip(*found, strict=True), list(_SCORED_ARROW)[1:], strict=True)]
                yield pa.record_batch([batch.column(0), *said, *batch.columns[2:]], names=[*_SCORED_ARROW.names, *batch.schema.names[2:]])
        trim()

    return run


def predict(docs: DataFrame, fitted: Model, text_col: str = "text", id_col: str = "doc_id", whole_rows: bool = False) -> DataFrame:
    """(id, lang_pred, score, n_words, known_share) of each row, from its whole text alone; with whole_rows also the struct `row` of all columns.

    `und` and a score of 0 if the text is null or has no letter, or the model knows no language.  Languages
    of equal sums: the first by name.  Repeated rows and rows without an id are predicted like any other; a text
    of any length is read whole, and its words must fit in a task.  An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if whole_rows else []
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *row)
    schema = T.StructType([*T._parse_datatype_string(_SCORED).fields, *rows.schema.fields[2:]])
    return rows.mapInArrow(_predicted(shared, uuid.uuid4().hex), schema)


def fold(id_col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds

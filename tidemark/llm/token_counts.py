"""Token counts under a unigram model, computed once for each shared prefix.

The distinct pre-tokens that a worker meets (a word with the space mark before it) are inserted in one trie.  A node
stands for a prefix; its forward score is the largest sum of piece scores over the segmentations of that
prefix, and its count the pieces of that segmentation.  Both follow from the nodes above it, so a prefix
that many pre-tokens share is worked out once.  The counts of nodes where pre-tokens end are stored, and
a document's count is the sum over its pre-tokens.

The vocabulary is a file of pieces in order of rank; a piece's score is its log probability under Zipf's
law.  A character that is no piece costs one piece for each of its UTF-8 bytes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import small_batches

MARK = "▁"
#: Counts that a worker stores, and nodes of its trie; beyond, it begins anew.
STORED, NODES = 200_000, 250_000
DOCUMENTS_AT_A_TIME = 500

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_COUNTS = "id long, n_words long, n_tokens long"


class Trie:
    """Forward scores of the prefixes of pre-tokens.  Nodes are numbers; node 0 is the empty prefix."""

    def __init__(self, scores: dict[str, float], longest: int, byte: float):
        self.scores, self.longest, self.byte = scores, longest, byte
        self.children: list[dict[str, int]] = [{}]
        self.best, self.count = [0.0], [0]

    def insert(self, text: str) -> int:
        """The count of the best segmentation of a pre-token; of equal ones, the one whose last piece is longest."""
        path = [0]
        children, scores, best, count = self.children, self.scores, self.best, self.count
        for end, char in enumerate(text, 1):
            node = children[path[-1]].get(char)
            if node is None:
                top, pieces = -math.inf, 0
                for begin in range(max(0, end - self.longest), end):
                    score = scores.get(text[begin:end])
                    if score is not None and best[path[begin]] + score > top:
                        top, pieces = best[path[begin]] + score, count[path[begin]] + 1
                if scores.get(char) is None:
                    size = len(char.encode("utf-8", "surrogatepass"))
                    if best[path[-1]] + size * self.byte > top:
                        top, pieces = best[path[-1]] + size * self.byte, count[path[-1]] + size
                node = children[path[-1]][char] = len(best)
                children.append({})
                best.append(top)
                count.append(pieces)
            path.append(node)
        return count[path[-1]]


class Counts(dict):
    """The count of each pre-token stored lately, and the trie that holds the prefixes of all of them."""

    def __init__(self, scores: dict[str, float], longest: int, byte: float):
        self.model = scores, longest, byte
        self.trie = Trie(*self.model)

    def add(self, words: set[str]) -> None:
        if len(self) + len(words) > STORED:
            self.clear()
        for word in sorted(words.difference(self)):
            if len(self.trie.best) + len(word) > NODES:
                self.trie = Trie(*self.model)
            # a pre-token longer than the bound has a trie of its own, which isn't kept
            trie = self.trie if len(word) <= NODES else Trie(*self.model)
            self[word] = trie.insert(MARK + word)


def vocabulary(path: str) -> tuple[dict[str, float], int, float]:
    """(score of each piece, characters of the longest, score of a byte) of a sentencepiece file, pieces by rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = math.log(sum(1 / (rank + 1) for rank in range(len(pieces) + 1)))
    scores = {piece: -math.log(rank + 1) - total for rank, piece in enumerate(pieces)}
    return scores, max(map(len, scores)), -math.log(len(pieces) + 1) - total


_counts: dict[str, Counts] = {}


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counts:  # one for each worker process
            _counts[path] = Counts(*vocabulary(path))
        counts = _counts[path]
        for batch in batches:
            for lo in range(0, batch.num_rows, DOCUMENTS_AT_A_TIME):
                part = batch.slice(lo, DOCUMENTS_AT_A_TIME)
                words = [_WORD.findall(text or "") for text in part.column(1).to_pylist()]
                counts.add(set().union(*words))
                found = [sum(map(counts.__getitem__, own)) for own in words]
                yield pa.record_batch([part.column(0), pa.array([len(own) for own in words], pa.int64()), pa.array(found, pa.int64())], names=["id", "n_words", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens) of each row, over its whole text.

    A null or empty text, or one without words, has 0 of both.  Repeated rows and rows without an id are
    counted like any other; extra columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_counted(path), _COUNTS)

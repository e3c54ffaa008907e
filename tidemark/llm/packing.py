"""Cost-balanced packing of tokenized documents into sequences of one length.

Each task tokenizes its documents and packs them block by block (a block is a number of tokens, so its
size doesn't depend on the table).  In a block the sequences are laid out first: as many full ones as the
tokens fill, and for the tokens left over sequences whose lengths are powers of two.  Documents then go,
longest first, to the sequence of least estimated attention cost (linear plus quadratic in a piece's
length) that has room for them; one that fits nowhere whole is cut.  Nothing is shuffled, and no
sequence holds padding.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import trim
from tidemark.llm.store import small_batches

CAPACITY = 2048
END_ID = 1
BLOCK_TOKENS = 1 << 21
CACHED_PIECES = 200_000

_PIECES = "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_PIECES_ARROW = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

#: Texts of these characters alone are split by `_PIECE`, which then agrees with the vocabulary's pattern.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
_OTHER_TEXT = re.compile(f"[^\\x00-\\x1b -~{_LETTERS}–—‘’“”…€°§©®]|<\\|")
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s{_LETTERS}0-9]+|\\s+(?!\\S)|\\s+")


class Vocabulary(dict):
    """Little-endian 32-bit ids of each pre-token met lately; a text's ids are those of its pre-tokens."""

    def __init__(self, path: str, ranks: str):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.single = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=table, special_tokens={})._encode_single_piece

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHED_PIECES:
            self.clear()
        ids = self[piece] = np.array(self.single(piece), dtype="<u4").tobytes()
        return ids

    def ids(self, text: str) -> bytes:
        if _OTHER_TEXT.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.__getitem__, _PIECE.findall(text)))


_vocabularies: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, ranks: str) -> Vocabulary:
    """One for each worker process."""
    if (path, ranks) not in _vocabularies:
        _vocabularies[path, ranks] = Vocabulary(path, ranks)
    return _vocabularies[path, ranks]


def layout(total: int, capacity: int) -> np.ndarray:
    """Lengths of the sequences that `total` tokens fill without padding."""
    full, rest = divmod(total, capacity)
    return np.array([capacity] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], dtype=np.int64)


def assign(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; every sequence of `layout` is filled."""
    room = layout(sum(lengths), capacity)
    used, cost = np.zeros(len(room), np.int64), np.zeros(len(room))
    out = []

    def place(doc: int, start: int, length: int, at: int) -> None:
        out.append((doc, start, length, at, int(used[at])))
        used[at] += length
        room[at] -= length
        cost[at] += length + length * length / capacity if room[at] else np.inf

    whole, rest = 0, []
    for doc, length in enumerate(lengths):
        cut = length // capacity
        for i in range(cut):
            place(doc, i * capacity, capacity, whole)
            whole += 1
        if length % capacity:
            rest.append((length % capacity, doc, cut * capacity))
    rest.sort(key=lambda x: (-x[0], x[1]))
    for length, doc, start in rest:
        while length:
            fits = np.where(room >= length, cost, np.inf)
            at = int(fits.argmin()) if len(fits) else 0
            if fits[at] == np.inf:
                at = int(room.argmax())
            take = min(length, int(room[at]))
            place(doc, start, take, at)
            start, length = start + take, length - take
    return out


def _pack(path: str, ranks: str, capacity: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, end = vocabulary(path, ranks), np.array([END_ID], dtype="<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 36
        keys: list = []
        ids: list[bytes] = []
        have = 0

        def flush() -> Iterator[pa.RecordBatch]:
            lengths = [len(x) // 4 for x in ids]
            pieces = assign(lengths, capacity)
            for lo in range(0, len(pieces), 4096):
                part = pieces[lo : lo + 4096]
                doc, start, length, at, offset = (list(x) for x in zip(*part, strict=True))
                yield pa.record_batch([pa.array([keys[d] for d in doc], pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([ids[d][4 * s : 4 * (s + n)] for d, s, n in zip(doc, start, length, strict=True)], pa.binary()), pa.array([lengths[d] for d in doc], pa.int64()), pa.array([sequence + x for x in at], pa.int64()), pa.array(offset, pa.int64())], schema=_PIECES_ARROW)

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                keys.append(key.as_py())
                ids.append(vocab.ids(text.as_py() or "") + end)
                have += len(ids[-1]) // 4
                if have >= block:
                    yield from flush()
                    sequence += len(layout(have, capacity))
                    keys, ids, have = [], [], 0
        if keys:
            yield from flush()
        trim()

    return run


def pack(docs: DataFrame, path: str, ranks: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset): one row for each piece of a document.

    path: the tokenizers file of a byte-level BPE; ranks: the same vocabulary as ranks.  ids: the piece's
    token ids, little-endian 32 bits each; each document ends in END_ID.  A null text is empty, so it is
    the end token alone.  Every row is a document, repeats and rows without an id too; extra columns are
    ignored; an empty table gives no pieces.  The pieces of a sequence follow each other from offset 0.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_pack(path, ranks, capacity, block_tokens), _PIECES)

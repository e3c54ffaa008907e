"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

A text is cut into segments where no piece can cross.  A segment begins as single characters; its agenda holds
the spans of characters that are pieces, the highest piece score first, the leftmost of equal ones.  A span
whose two halves stand beside each other comes up and is merged, unless a hash of seed, document, place of
the segment in the text and span falls below the rate: then it is skipped, there and for good.  So one word is
segmented in several ways in one run, a seed always gives the same result, and at rate 0 it is the
model's own.  What is no piece goes into byte pieces, and so decoding gives the text back, however it was cut.

The agendas of new segments are worked out together, by hashes of all short spans.  Draws are made for all
occurrences of a batch at once; those that skip nothing their agenda would take share the model's own result,
and for the others the agenda runs over arrays: each two symbols beside each other hold the place of their span
in the agenda, and each step merges the first span of every occurrence and looks up the two that come of it.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import arrays as A
from tidemark.llm.store import small_batches

MARK = "▁"
RATE = 0.1
#: Segments that a worker keeps; beyond, it goes on with those met most often, half as many at most.
CACHED_SEGMENTS = 200_000
#: Characters and spans of a segment that the arrays take; others run their agenda one at a time.
MOST_CHARACTERS, MOST_SPANS = 40, 96
#: Occurrences that are drawn for together.
TOGETHER = 1 << 15
#: Stands for a mark that a text itself holds: a lone surrogate, which no text has.
_MARK_ITSELF = "\ud800"
#: Stands before the code point of a character that is no piece.
_NONE = 1 << 30
#: Bits of the table that tells which spans may be pieces.
_SIEVE = 20
#: Place in an agenda that stands for no span; and the bytes that tables of places may take at a time.
_NO_SPAN, _TABLES = 255, 1 << 21

_SEGMENT = re.compile(r" *[^ \n]+| +|\n")
_ENCODED = "id long, ids array<int>"
_CHECKED = "id long, n_tokens long, ids_crc32 long, lossless boolean"
_U = np.uint64
_ONE = _U(1)
_SEED, _PLACE, _SPAN = _U(0x9E3779B97F4A7C15), _U(0xD1B54A32D192ED03), _U(0x8CB92BA72F3D8DD7)
REPLACEMENT = "�"


class Pieces:
    """Pieces, scores and byte pieces of a sentencepiece BPE file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        names = [model.id_to_piece(i) for i in ids]
        control = {i for i in ids if model.is_control(i)}
        special = control | {i for i in ids if model.is_unknown(i) or model.is_unused(i)}
        byte = {i: int(names[i][1:-1], 16) for i in ids if model.is_byte(i)}
        self.byte_ids = [i for _, i in sorted((b, i) for i, b in byte.items())]
        self.merged = {names[i]: (-model.get_score(i), i) for i in ids if i not in special and i not in byte}
        self.longest = max(map(len, self.merged))
        # a cut before a space that follows another character, or around a line end, must cross no piece
        if any("\n" in name or re.search(f"[^{MARK}]{MARK}", name) for name in self.merged):
            raise ValueError("pieces of this vocabulary cross the cuts between segments")
        self._index_spans()
        # bytes of each id; the last stands for ids that are none
        raw = [bytes([byte[i]]) if i in byte else b"" if i in control else REPLACEMENT.encode() if i in special else names[i].replace(MARK, " ").encode() for i in ids]
        raw.append(REPLACEMENT.encode())
        self.lengths = np.array([len(x) for x in raw], np.int64)
        self.starts = self.lengths.cumsum() - self.lengths
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def _index_spans(self) -> None:
        """Hashes of the pieces of two or more characters, in order, with their ids and places in the order of scores."""
        long = sorted((x, name) for name, x in self.merged.items() if len(name) > 1)
        points = np.frombuffer("".join(name for _, name in long).encode("utf-32-le", "surrogatepass"), "<u4")
        size = np.array([len(name) for _, name in long], np.int64)
        ends = size.cumsum()
        hashes = span_hashes(prefix_sums(points), ends - size, ends)
        scores = np.array([x[0] for x, _ in long])
        rank = np.searchsorted(np.unique(scores), scores)
        order = np.argsort(hashes)
        self.hashes, self.ranks, self.ids = hashes[order], rank[order], np.array([x[1] for x, _ in long], np.int64)[order]
        upper = (self.hashes >> _U(64 - _SIEVE)).astype(np.int64)
        size = np.bincount(upper, minlength=1 << _SIEVE)
        self.sieve, self.slot, self.deepest = size > 0, (size.cumsum() - size).astype(np.int32), int(size.max())
        # the piece of each character, or its code point behind _NONE
        self.single = np.arange(_NONE, _NONE + 0x110000, dtype=np.int32)
        for name, x in self.merged.items():
            if len(name) == 1:
                self.single[ord(name)] = x[1]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces, and the pieces' places in `hashes`."""
        upper = (hashes >> _U(64 - _SIEVE)).astype(np.int64)
        some = np.flatnonzero(self.sieve[upper])
        h, place = hashes[some], self.slot[upper[some]].astype(np.int64)
        for _ in range(self.deepest - 1):
            place = np.minimum(place + (self.hashes[place] < h), len(self.hashes) - 1)
        hit = self.hashes[place] == h
        return some[hit], place[hit]


def prefix_sums(points: np.ndarray) -> np.ndarray:
    """Running sums of code points times powers, by which any span has a hash."""
    power, _ = A._power_tables(len(points) + 1)
    return np.concatenate([np.zeros(1, _U), np.cumsum(A.mix(points.astype(_U) + _PLACE) * power[: len(points)])])


def span_hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inverse = A._power_tables(len(sums))
    return A.mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(_U) * _SPAN)


def characters(segment: str) -> str:
    """A segment as pieces write it; a mark that the text itself holds is no space, and stays out of every piece."""
    return segment.replace(MARK, _MARK_ITSELF).replace(" ", MARK)


def spans_of(segment: str, pieces: Pieces) -> list[tuple[float, int, int, int]]:
    """(-score, begin, end, piece) of the spans of two or more characters that are pieces: the agenda's order."""
    text, n, merged = characters(segment), len(segment), pieces.merged
    found = []
    for a in range(n - 1):
        for b in range(a + 2, min(n, a + pieces.longest) + 1):
            x = merged.get(text[a:b])
            if x is not None:
                found.append((x[0], a, b, x[1]))
    found.sort()
    return found


def occurrence_keys(seed: int, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A key of each occurrence of a segment, from document id and the segment's place in its text."""
    return A.mix(A.mix(doc.astype(np.int64).view(_U) + _U(seed * int(_SEED) % (1 << 64))) + place.astype(_U) * _PLACE)


def skipped(keys: np.ndarray, begin: np.ndarray, end: np.ndarray, rate: float) -> np.ndarray:
    """Whether each span of each occurrence is skipped."""
    if rate >= 1:
        return np.ones(len(keys), bool)
    return A.mix(keys + (begin.astype(_U) << _U(32) | end.astype(_U)) * _SPAN) < _U(int(rate * (1 << 64)))


def boundaries(spans: list[tuple[int, int]], n: int) -> list[int]:
    """Where the symbols of n characters begin and end, once an agenda of (begin, end) is through; spans that may not merge are left out."""
    after, before = {a: a + 1 for a in range(n)}, {a + 1: a for a in range(n)}
    place = {span: i for i, span in enumerate(spans)}
    agenda: list[int] = []

    def propose(a: int, b: int) -> None:
        found = place.get((a, b))
        if found is not None:
            heapq.heappush(agenda, found)

    for a in range(n - 1):
        propose(a, a + 2)
    while agenda:
        a, b = spans[heapq.heappop(agenda)]
        middle = after.get(a)
        if middle is None or middle == b or after.get(middle) != b:
            continue
        after[a], before[b] = b, a
        del after[middle], before[middle]
        if a:
            propose(before[a], b)
        if b < n:
            propose(a, after[b])
    out = [0]
    while out[-1] < n:
        out.append(after[out[-1]])
    return out


def symbol_ids(segment: str, cuts: list[int], pieces: Pieces) -> bytes:
    """Little-endian 32-bit ids of a segment cut at `cuts`."""
    text, out = characters(segment), []
    for a, b in zip(cuts, cuts[1:], strict=False):
        found = pieces.merged.get(text[a:b])
        out += [found[1]] if found is not None else [pieces.byte_ids[x] for x in segment[a:b].encode()]
    return np.array(out, "<u4").tobytes()


def appended(a: np.ndarray, more: np.ndarray) -> np.ndarray:
    """An array with more at its end; room is kept behind it, so that it is seldom copied."""
    room, n = a if a.base is None else a.base, len(a) + len(more)
    if n > len(room):
        room = np.empty(max(n, 2 * len(room)), a.dtype)
        room[: len(a)] = a
    room[len(a) : n] = more
    return room[:n]


def stretches(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, count in all."""
    ends = count.cumsum()
    return np.repeat(first - ends + count, count) + np.arange(int(ends[-1]) if len(ends) else 0)


class _Numbers(dict):
    """Segments and their numbers; a new one gets the next."""

    def __init__(self, names: list[str]):
        super().__init__(zip(names, range(len(names)), strict=True))
        self.names = names

    def __missing__(self, name: str) -> int:
        self[name] = n = len(self.names)
        self.names.append(name)
        return n


class Encoder:
    """Encodes batches of texts, and keeps the agendas of segments met lately."""

    def __init__(self, path: str, rate: float, seed: int):
        self.pieces, self.rate, self.seed = Pieces(path), rate, seed
        self.names: list[str] = []
        self.number = _Numbers(self.names)
        self.own: list[bytes | None] = []  # at rate 0; none of a segment that arrays don't take
        zero = lambda kind: np.zeros(0, kind)
        # of each segment: its first span and how many, its first character and how many, how often it was met
        self.first, self.count, self.head, self.size, self.met = (zero(np.int64) for _ in range(5))
        # of each span: begin, end, piece, and whether a run without skips merges it; of each character: its piece
        self.begin, self.end, self.piece, self.taken = zero(np.uint8), zero(np.uint8), zero(np.int32), zero(bool)
        self.characters = zero(np.int32)

    def _forget(self) -> None:
        """Go on with the segments that were met again, those met most often if they are many."""
        stay = np.flatnonzero(self.met > 1)
        if len(stay) > CACHED_SEGMENTS // 2:
            stay = np.sort(stay[np.argsort(-self.met[stay], kind="stable")[: CACHED_SEGMENTS // 2]])
        self.names = [self.names[i] for i in stay.tolist()]
        self.number = _Numbers(self.names)
        self.own = [self.own[i] for i in stay.tolist()]
        self.count, self.size, self.met = self.count.take(stay), self.size.take(stay), self.met.take(stay) // 2
        spans, own = stretches(self.first.take(stay), self.count), stretches(self.head.take(stay), self.size)
        self.first, self.head = self.count.cumsum() - self.count, self.size.cumsum() - self.size
        self.begin, self.end, self.piece, self.taken = (x.take(spans) for x in (self.begin, self.end, self.piece, self.taken))
        self.characters = self.characters.take(own)

    def _learn(self, new: list[str]) -> None:
        """Work out the agendas of new segments, which have numbers already."""
        p = self.pieces
        size = np.fromiter(map(len, new), np.int64, len(new))
        short = size <= MOST_CHARACTERS
        texts = characters("".join(new if short.all() else [t for t, fits in zip(new, short.tolist(), strict=True) if fits]))
        n = np.where(short, size, 0)
        points = np.frombuffer(texts.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        sums = prefix_sums(points)
        head = n.cumsum() - n
        owner = np.repeat(np.arange(len(new)), n)
        left = (head + n)[owner] - np.arange(len(points))
        found, at = [], np.arange(len(points))
        for k in range(2, min(p.longest, MOST_CHARACTERS) + 1):
            at = at[left[at] >= k]
            if not len(at):
                break
            hit, place = p.find(span_hashes(sums, at, at + k))
            found.append((at[hit], np.full(len(hit), k), place))
        at, k, place = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in range(3))
        of = owner[at]
        begin = at - head[of]
        # by segment, rank, begin and length, no two of which are alike
        order = np.argsort(((of * (len(p.ranks) + 1) + p.ranks[place]) * (MOST_CHARACTERS + 1) + begin) * (MOST_CHARACTERS + 1) + k)
        begin, k, place = begin[order], k[order], place[order]
        count = np.bincount(of, minlength=len(new))
        fits = short & (count <= MOST_SPANS)
        base = len(self.first)
        self.first = appended(self.first, len(self.begin) + count.cumsum() - count)
        self.count = appended(self.count, np.where(fits, count, 0))
        self.head, self.size = appended(self.head, len(self.characters) + head), appended(self.size, n)
        self.met = appended(self.met, np.zeros(len(new), np.int64))
        self.begin, self.end = appended(self.begin, begin.astype(np.uint8)), appended(self.end, (begin + k).astype(np.uint8))
        self.piece, self.taken = appended(self.piece, p.ids[place].astype(np.int32)), appended(self.taken, np.zeros(len(k), bool))
        self.characters = appended(self.characters, p.single[points])
        numbers = base + np.flatnonzero(fits)
        self.own += [None] * len(new)
        for i, x in zip(numbers.tolist(), self._run(numbers), strict=True):
            self.own[i] = x

    def _run(self, numbers: np.ndarray, skip: np.ndarray | None = None, at_skip: np.ndarray | None = None) -> list[bytes]:
        """Ids of segments; skip: of each span, from at_skip of its segment on, whether it may not be merged.

        Without skip, notes which spans are merged.
        """
        out: list[bytes] = [b""] * len(numbers)
        size = self.size[numbers]
        rows = np.argsort(size, kind="stable")
        size, lo = size[rows], 0
        while lo < len(rows):
            # rows of about as many characters, padded to the largest of them
            most = int(size[lo]) * 3 // 2 + 1
            hi = min(int(np.searchsorted(size, most, side="right")), lo + max(1, _TABLES // ((most + 1) * (most + 2))))
            some, n = rows[lo:hi], size[lo:hi]
            self._merge(numbers[some], n, skip, None if skip is None else at_skip[some], some, out)
            lo = hi
        return out

    def _merge(self, number: np.ndarray, n: np.ndarray, skip: np.ndarray | None, at_skip: np.ndarray | None, some: np.ndarray, out: list[bytes]) -> None:
        """Put the ids of a few segments, of n characters each, into `out` at `some`."""
        wide, many, first, count = int(n.max()), len(number), self.first[number], self.count[number]
        each, place = np.arange(many), np.arange(wide)
        symbols = self.characters[self.head[number][:, None] + np.minimum(place, n[:, None] - 1)]
        cut = place < n[:, None]
        # of each row, begin and end: the span's place in the agenda; no span begins at `wide` or ends after it
        step = wide + 2
        base = each * ((wide + 1) * step)
        table = np.full(many * (wide + 1) * step, _NO_SPAN, np.uint8)
        owner, where = np.repeat(each, count), stretches(first, count)
        at = (where - first[owner]).astype(np.uint8)
        if skip is not None:
            stay = np.flatnonzero(~skip[stretches(at_skip, count)])
            owner, where, at = owner[stay], where[stay], at[stay]
        table[base[owner] + self.begin[where].astype(np.int64) * step + self.end[where]] = at
        # of each character and row: the place of the span of the symbol that begins there and the next one; their ends and begins
        beside = np.full((wide + 1, many), _NO_SPAN, np.uint8)
        beside[:wide] = table.reshape(many, wide + 1, step)[:, place, place + 2].T
        after = np.repeat(np.arange(1, wide + 2), many)
        before = np.repeat(np.arange(-1, wide), many)
        before[:many] = wide
        flat, flat_symbols, flat_cut = beside.reshape(-1), symbols.reshape(-1), cut.reshape(-1)
        while True:
            best = beside.min(axis=0)
            live = np.flatnonzero(best != _NO_SPAN)
            if not len(live):
                break
            span = first[live] + best[live]
            a, b = self.begin[span].astype(np.int64), self.end[span].astype(np.int64)
            at_a, at_b, line = a * many + live, b * many + live, base[live]
            middle, right, left = after[at_a], after[at_b], before[at_a]
            after[at_a], before[at_b] = b, a
            flat[middle * many + live] = _NO_SPAN
            flat[at_a] = table[line + a * step + right]
            flat[left * many + live] = table[line + left * step + b]
            line = live * wide
            flat_symbols[line + a] = self.piece[span]
            flat_cut[line + middle] = False
            if skip is None:
                self.taken[span] = True
        ids, ends = symbols[cut], 4 * cut.sum(axis=1).cumsum()
        raw, start = ids.astype("<u4").tobytes(), 0
        odd = np.flatnonzero((cut & (symbols >= _NONE)).any(axis=1)).tolist() if len(ids) and ids.max() >= _NONE else []
        for row, end in zip(some.tolist(), ends.tolist(), strict=True):
            out[row] = raw[start:end]
            start = end
        for i in odd:
            out[some[i]] = self._with_bytes(symbols[i][cut[i]].tolist())

    def _with_bytes(self, ids: list[int]) -> bytes:
        """Ids with the byte pieces of characters that are none."""
        spelled = [[i] if i < _NONE else [self.pieces.byte_ids[b] for b in chr(i - _NONE).replace(_MARK_ITSELF, MARK).encode()] for i in ids]
        return np.array([i for x in spelled for i in x], "<u4").tobytes()

    def _one(self, number: int, key: int) -> bytes:
        """A segment by itself."""
        segment = self.names[number]
        spans = spans_of(segment, self.pieces)
        begin, end = (np.array([s[i] for s in spans], np.int64) for i in (1, 2))
        stay = ~skipped(np.full(len(spans), key, _U), begin, end, self.rate) if self.rate else np.ones(len(spans), bool)
        return symbol_ids(segment, boundaries([(s[1], s[2]) for s, k in zip(spans, stay.tolist(), strict=True) if k], len(segment)), self.pieces)

    def _drawn(self, numbers: np.ndarray, keys: np.ndarray, out: list[bytes]) -> None:
        """Put the results of occurrences that skip something into `out`, which has the model's own."""
        count = self.count[numbers]
        ends = count.cumsum()
        if not len(ends) or not ends[-1]:
            return
        where = stretches(self.first[numbers], count)
        skip = skipped(np.repeat(keys, count), self.begin[where], self.end[where], self.rate)
        rows = np.searchsorted(ends, np.flatnonzero(skip & self.taken[where]), side="right")
        rows = rows[A.runs(rows)]
        for row, x in zip(rows.tolist(), self._run(numbers[rows], skip, (ends - count)[rows]), strict=True):
            out[row] = x

    def encode(self, ids: np.ndarray, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, little-endian 32 bits each; a space is put before a text, as the model has it.  An empty text has none."""
        out, group, size = [], [], 0
        for i, text in enumerate(texts):
            found = _SEGMENT.findall(" " + text) if text else []
            group.append((i, found))
            size += len(found)
            if size >= TOGETHER:
                out += self._group(ids, group)
                group, size = [], 0
        return out + self._group(ids, group)

    def _group(self, ids: np.ndarray, group: list[tuple[int, list[str]]]) -> list[bytes]:
        out = []
        for i, found in group:
            if len(found) > 4 * TOGETHER:  # a very long text by itself
                out.append(b"".join(b"".join(self._slab(ids[i : i + 1], [(0, found[lo : lo + TOGETHER])], lo)) for lo in range(0, len(found), TOGETHER)))
        short = [(i, found) for i, found in group if len(found) <= 4 * TOGETHER]
        made = iter(self._slab(ids, short, 0))
        long = iter(out)
        return [next(long) if len(found) > 4 * TOGETHER else next(made) for _, found in group]

    def _slab(self, ids: np.ndarray, group: list[tuple[int, list[str]]], place: int) -> list[bytes]:
        if len(self.names) >= CACHED_SEGMENTS:
            self._forget()
        known, counts = len(self.names), np.array([len(found) for _, found in group], np.int64)
        numbers = list(map(self.number.__getitem__, chain.from_iterable(found for _, found in group)))
        if len(self.names) > known:
            self._learn(self.names[known:])
        pieces = list(map(self.own.__getitem__, numbers))
        numbers = np.array(numbers, np.int64)
        self.met += np.bincount(numbers, minlength=len(self.names))
        ends = counts.cumsum()
        at = np.arange(len(numbers)) - np.repeat(ends - counts, counts) + place
        keys = occurrence_keys(self.seed, np.repeat(ids[[i for i, _ in group]] if group else ids[:0], counts), at)
        if self.rate > 0:
            self._drawn(numbers, keys, pieces)
        for row in [i for i, x in enumerate(pieces) if x is None]:
            pieces[row] = self._one(int(numbers[row]), int(keys[row]))
        return [b"".join(pieces[hi - n : hi]) for hi, n in zip(ends.tolist(), counts.tolist(), strict=True)]

    def decode(self, ids: bytes) -> str:
        """The text of ids, without the space that encoding put before it.

        Control pieces say nothing; an id that the vocabulary lacks, its unknown piece, and bytes that are no
        UTF-8 become U+FFFD.
        """
        p = self.pieces
        own = np.frombuffer(ids, "<u4").astype(np.int64)
        own = np.where(own < len(p.lengths) - 1, own, len(p.lengths) - 1)
        size = p.lengths[own]
        ends = size.cumsum()
        raw = p.bytes[np.repeat(p.starts[own] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        return raw.removeprefix(b" ").decode("utf-8", "replace")


_encoders: dict[tuple[str, float, int], Encoder] = {}


def encoder(path: str, rate: float, seed: int) -> Encoder:
    """One for each worker process."""
    if (path, rate, seed) not in _encoders:
        _encoders.clear()
        _encoders[path, rate, seed] = Encoder(path, rate, seed)
    return _encoders[path, rate, seed]


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.Array, np.ndarray, list[str | None]]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            part = batch.slice(lo, rows)
            yield part.column(0), np.asarray(part.column(0).fill_null(0)).astype(np.int64), part.column(1).to_pylist()


def _encode(path: str, rate: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, rate, seed)
        for keys, ids, texts in _slices(batches, 250):
            found = [np.frombuffer(x, "<i4") for x in own.encode(ids, texts)]
            yield pa.record_batch([keys, pa.array(found, pa.list_(pa.int32()))], names=["id", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, 0.0, 0)
        for batch in batches:
            # a null among ids is no id of the vocabulary
            texts = [None if ids is None else own.decode(np.array([-1 if i is None else i for i in ids], np.int32).tobytes()) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return run


def _check(path: str, rate: float, seed: int):
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, rate, seed)
        for keys, ids, texts in _slices(batches, 250):
            found = own.encode(ids, texts)
            n, crc, same = [len(x) // 4 for x in found], [zlib.crc32(x) for x in found], [own.decode(x) == (t or "") for x, t in zip(found, texts, strict=True)]
            yield pa.record_batch([keys, pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=["id", "n_tokens", "ids_crc32", "lossless"])

    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def encode(docs: DataFrame, path: str, rate: float = RATE, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of each row's whole text.

    A null text is empty and has no ids.  Repeated rows are kept and get the same ids; a null id is kept and
    draws as id 0.  Extra columns are ignored; an empty table gives no rows.
    """
    return _texts(docs, id_col, text_col).mapInArrow(_encode(path, rate, seed), _ENCODED)


def decode(ids: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of each row of ids, as Encoder.decode has it; null for null."""
    return ids.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(_decode(path), "id long, text string")


def checked(docs: DataFrame, path: str, rate: float = RATE, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_crc32, lossless): each row encoded and decoded again, in one pass without a shuffle.

    ids_crc32 is of the ids as little-endian 32-bit numbers; lossless: decoding gave the text back.  All else is
    as in encode.
    """
    return _texts(docs, id_col, text_col).mapInArrow(_check(path, rate, seed), _CHECKED)

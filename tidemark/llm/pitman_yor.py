"""Language-model scores by a hierarchical Pitman-Yor model.

Tokens are words (lower-cased in A-Z) and an end for each document.  The token before (a start mark before
the first) chooses a context restaurant, and each such word has its own, known by its 64-bit hash.  All
contexts share one parent, the unigram restaurant: who sits down at a new table in a context is a customer
of the parent, and a new table there draws from the uniform base over the training vocabulary and one
unknown token.

1. Each task counts a chunk of documents and sends (word, context, document) counts, packed, to a bucket of
   a grid: words choose its row, contexts its column.  So the customers of one pair are in one bucket, while a
   very common word or context is spread over a whole row or column.
2. Words and contexts span buckets: each bucket sends its sums to shards of the words' and contexts' hashes, which
   add up and send back the totals.  A shard of words also seats the parent's customers.
3. A sweep of Gibbs sampling: in its bucket, each customer of a pair stands up and sits down again, at a table in
   proportion to its size less the discount, or at a new one in proportion to the parent's probability.  Then all
   totals are summed anew and the parent's customers are seated again, from where they sat.  Draws are hashes of
   word, context, customer and sweep, so the seating doesn't depend on how rows are laid out.
4. A token's probability is the mean over the last sweeps of their predictive probabilities.  Sums of logarithms, as
   whole numbers, go back to the documents.

Counts are of all training documents, and all customers are seated; nothing is capped or sampled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import arrays as A
from tidemark.llm.store import buckets, drop, keep, shuffles_removed, small_batches

#: Buckets for each shard of the words, and of the contexts.
BUCKETS_A_SHARD = 4
STRENGTH = 10.0
BURN_IN, SAMPLES = 1, 3
#: Customers of one dish and restaurant that stand up at a time are every STEPS-th one.
STEPS = 64
#: Bits of the draws that put a dish's customers in order.
ORDER_BITS = 26
CHUNK_BYTES = 4 << 20
BASE_ADD = 0.1
#: Logarithms are summed in units of 2 ** -UNIT.
UNIT = 30

_U = np.uint64
_START, _END = _U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F)
_ROW, _COLUMN, _PARENT = _U(0x9FB21C651E98DF25), _U(0x2545F4914F6CDD1D), _U(0x632BE59BD9B4E019)
#: Of the kind of table sizes, so that adding in place needs no casts.
_ONE = np.int32(1)
_CUSTOMER, _DRAW = _U(0xD1342543DE82EF95), _U(0xAEF17502108EF2D9)


# --- 1. counts ---------------------------------------------------------------------------------------------------

def _pack(x: np.ndarray) -> bytes:
    """Positions, compressed: they fill most of the tables and messages here."""
    raw = A.pack_positions(x)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(raw: bytes) -> np.ndarray:
    size = int.from_bytes(raw[:8], "little")
    return A.unpack_positions(pa.decompress(memoryview(raw)[8:], size, codec="zstd", asbytes=True))


_SENT = "bucket int, chunk long, train binary, words binary, counts binary, contexts binary, context binary, doc binary, n binary, ids binary"
_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), *((c, pa.binary()) for c in ("train", "words", "counts", "contexts", "context", "doc", "n", "ids"))])


def tokens(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, token, token before) of each token of each row, ends included."""
    starts, ends, first = A.split_words(data, rows)
    words = A.hash_words(data, starts, ends, fold=True)
    count = np.diff(first) + 1
    row = np.repeat(np.arange(len(count)), count)
    token = np.empty(len(row), _U)
    last = count.cumsum() - 1
    is_end = np.zeros(len(row), bool)
    is_end[last] = True
    token[is_end], token[~is_end] = _END, words
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[last - count + 1] = _START
    return row, token, before


def _grid(parts: int) -> int:
    """Rows of a grid of about so many buckets, and its columns."""
    return max(1, int(np.ceil(np.sqrt(parts))))


def _sent(side: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, rows = A.text_bytes(batch.column(2))
            train = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(rows, rows[lo] + most, side="right")) - 1)
                out, n = _packed(data[rows[lo] : rows[hi]], rows[lo : hi + 1] - rows[lo], side)
                flags = np.packbits(train[lo:hi]).tobytes()
                out = [{**x, "chunk": chunk, "train": flags} for x in out]
                out.append({"bucket": chunk % side**2, "chunk": chunk, "train": flags, "ids": _ids(batch.column(0)[lo:hi]), "n": _pack(n)})
                yield from pa.Table.from_pylist(out, _SENT_ARROW).to_batches(max_chunksize=64)
                lo, chunk = hi, chunk + 1
                del out
                A.trim()

    return run


def _ids(ids: pa.Array) -> bytes:
    """The ids, and then for each whether it is null."""
    return np.asarray(ids.fill_null(0)).astype(np.int64).tobytes() + np.asarray(ids.is_null()).tobytes()


def _packed(data: np.ndarray, rows: np.ndarray, side: int) -> tuple[list[dict], np.ndarray]:
    """A message to each bucket, and the number of tokens of each row."""
    row, token, before = tokens(data, rows)
    size = np.bincount(row, minlength=len(rows) - 1)
    words, own = np.unique(token, return_inverse=True)
    # words in order of the grid's rows; contexts, in order of its columns, are these words, with the start for the end
    end = np.searchsorted(words, _END)
    contexts = words.copy()
    contexts[end] = _START
    context = np.empty_like(own)
    context[1:] = own[:-1]
    context[before == _START] = end
    del token, before
    own, words, across = _dealt(own, words, words ^ _ROW, side)
    context, contexts, down = _dealt(context, contexts, contexts ^ _COLUMN, side)
    bits, wide = (len(rows) - 1).bit_length(), len(contexts).bit_length()
    key, n = np.unique(((own << wide | context) << bits | row).astype(_U), return_counts=True)
    del row, context
    key = key.astype(np.int64)
    doc, context, own = key & (1 << bits) - 1, key >> bits & (1 << wide) - 1, key >> bits + wide
    at = np.repeat(np.arange(side), np.diff(across))[own] * side + np.repeat(np.arange(side), np.diff(down))[context]
    order, bounds = A.grouped(at, side**2)
    out = []
    for b in np.flatnonzero(np.diff(bounds)):
        i = order[bounds[b] : bounds[b + 1]]
        first = A.runs(own[i])
        lo, hi = down[b % side], down[b % side + 1]
        place, met = context[i] - lo, np.zeros(hi - lo, bool)
        met[place] = True
        out.append({"bucket": int(b), "words": words[own[i][first]].tobytes(), "counts": _pack(np.diff(np.append(first, len(i)))), "contexts": contexts[lo:hi][met].tobytes(), "context": _pack((met.cumsum() - 1)[place]), "doc": _pack(doc[i]), "n": _pack(n[i])})
    return out, size


def _dealt(own: np.ndarray, names: np.ndarray, by: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names and their numbers anew, in order of n buckets, and the bounds of these."""
    order, bounds = A.grouped(A.bucket_of(A.mix(by), n), n)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return rank[own], names[order], bounds


_GROUPED = "bucket int, words binary, types binary, contexts binary, context binary, c binary, counts binary, chunks binary, chunk binary, doc binary, n binary, one long, two long, ids binary, own long, train binary"
_GROUPED_ARROW = pa.schema([
    ("bucket", pa.int32()), *((x, pa.binary()) for x in ("words", "types", "contexts", "context", "c", "counts", "chunks", "chunk", "doc", "n")),
    ("one", pa.int64()), ("two", pa.int64()), ("ids", pa.binary()), ("own", pa.int64()), ("train", pa.binary()),
])


def _by_bucket(table: pa.Table) -> pa.Table:
    bucket = table["bucket"][0].as_py()
    out, parts_of = [], []
    for x in table.to_pylist():
        if x["ids"] is not None:
            out.append({"bucket": bucket, "ids": x["ids"], "own": x["chunk"], "train": x["train"], "n": x["n"]})
        else:
            parts_of.append(x)
    if parts_of:
        # repeated attempts see the messages in another order
        parts_of.sort(key=lambda x: x["chunk"])
        out.append({"bucket": bucket, **_grouped(parts_of)})
    made = pa.Table.from_pylist(out, _GROUPED_ARROW)
    del out, parts_of, table
    A.trim()
    return made


def _column(messages: list[dict], name: str) -> np.ndarray:
    """One packed column of all messages, which are emptied of it."""
    return np.concatenate([_unpack(x.pop(name)).astype(np.int32) for x in messages])


def _grouped(messages: list[dict]) -> dict:
    chunks = np.array([x["chunk"] for x in messages], np.int64)
    words, own = np.unique(np.concatenate([np.frombuffer(x.pop("words"), _U) for x in messages]), return_inverse=True)
    kind = np.repeat(own, _column(messages, "counts"))
    met = [np.frombuffer(x.pop("contexts"), _U) for x in messages]
    before = np.concatenate([[0], np.cumsum([len(x) for x in met])])
    contexts, own = np.unique(np.concatenate(met), return_inverse=True)
    del met
    at = [_unpack(x.pop("context")) for x in messages]
    chunk = np.repeat(np.arange(len(messages), dtype=np.int32), [len(x) for x in at])
    wide = len(contexts).bit_length()
    kind <<= wide
    kind |= np.concatenate([own[x + lo] for x, lo in zip(at, before, strict=False)])
    del own, at
    order = np.argsort(kind, kind="stable").astype(np.int32)
    kind = kind[order]
    begin = A.runs(kind)
    word, context = kind[begin] >> wide, kind[begin] & (1 << wide) - 1
    del kind
    counts = np.diff(np.append(begin, len(order)))
    flags = [np.unpackbits(np.frombuffer(x["train"], np.uint8)) for x in messages]
    doc, n = _column(messages, "doc"), _column(messages, "n")
    ends = np.concatenate([[0], np.bincount(chunk, minlength=len(messages)).cumsum()])
    learnt = np.concatenate([n[lo:hi] * f[doc[lo:hi]] for f, lo, hi in zip(flags, ends, ends[1:], strict=False)])
    c = np.add.reduceat(learnt[order].astype(np.int64), begin)
    items = {"counts": _pack(counts), "chunks": chunks.tobytes(), "chunk": _pack(chunk[order]), "doc": _pack(doc[order]), "n": _pack(n[order])}
    del doc, n, learnt, chunk, order
    return {
        "words": words.tobytes(), "types": _pack(np.bincount(word, minlength=len(words))), "contexts": contexts.tobytes(), "context": _pack(context), "c": _pack(c),
        "one": int((c == 1).sum()), "two": int((c == 2).sum()), **items,
    }


# --- seating -----------------------------------------------------------------------------------------------------


class Seating:
    """Tables of dishes: dish i has c[i] >= 1 customers, of which each draws by its own key.

    tables and sizes: how many tables each dish had before, and their sizes, all dishes' one after another; without
    them each dish is served at one table.  Customers that left since are those of the least draws; who came since sits
    down beside a customer drawn by chance, until a sweep.
    """

    def __init__(self, c: np.ndarray, keys: np.ndarray, tables: np.ndarray | None = None, sizes: np.ndarray | None = None, number: int = 0):
        self.c, self.t, self.number, self.salt = c, np.ones(len(c), np.int64), number, 0
        self.many = np.flatnonzero(c > 1)
        many = c[self.many]
        self.first = many.cumsum() - many
        self.keys = keys[self.many]
        # twice the places that tables can need, so a free one is soon found
        self.places = 2 * many + 2
        self.place_of = self.places.cumsum() - self.places
        self.table = np.repeat(self.place_of, many)
        if tables is not None:
            self.table += self._places(keys, tables, sizes)
        self.size = np.bincount(self.table, minlength=int(self.places.sum())).astype(np.int32)
        self.t[self.many] = np.add.reduceat(self.size > 0, self.place_of) if len(many) else 0
        if tables is not None:
            self._shuffle()

    def _shuffle(self) -> None:
        """Customers in an order drawn by chance: a sweep takes them by number, which must not tell their tables."""
        c, t = self.c[self.many], self.t[self.many]
        some = (t > 1) & (t < c)
        at = np.flatnonzero(np.repeat(some, c))
        if not len(at):
            return
        c, place_of = c[some], np.repeat(self.place_of[some], c[some])
        dish, table = np.repeat(np.arange(len(c)), c), self.table[at] - place_of
        nth = np.arange(len(at)) - np.repeat(c.cumsum() - c, c)
        self.salt = 1 << 18
        draws = (self._bits(A.mix(np.repeat(self.keys[some], c) + nth.astype(_U) * _CUSTOMER)) >> _U(64 - ORDER_BITS)).astype(np.int64)
        wide = int(table.max()).bit_length()
        if len(c).bit_length() + ORDER_BITS + wide < 64:
            table = np.sort(dish << ORDER_BITS + wide | draws << wide | table) & (1 << wide) - 1
        else:
            table = table[np.lexsort((table, draws, dish))]
        self.table[at] = table + place_of

    def _draw(self, keys: np.ndarray) -> np.ndarray:
        """Numbers from 0 to 1, others on each call."""
        return (self._bits(keys) >> _U(11)) * 2.0**-53

    def _bits(self, keys: np.ndarray) -> np.ndarray:
        self.salt += 1
        return A.mix(keys + _U((self.number << 32 | self.salt) * int(_DRAW) % (1 << 64)))

    def _draw_two(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers each, of 32 bits: enough to choose one of a dish's customers, whose first number has no more than that."""
        bits = self._bits(keys)
        return (bits >> _U(32)) * 2.0**-32, (bits & _U((1 << 32) - 1)) * 2.0**-32

    def _places(self, keys: np.ndarray, tables: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The table of each customer, from the tables of before."""
        before, c = np.add.reduceat(sizes, tables.cumsum() - tables), self.c
        some = (before > 1) | (c > 1)
        sizes = sizes[np.repeat(some, tables)]
        before, c, keys, tables = before[some], c[some], keys[some], tables[some]
        first = before.cumsum() - before
        table = np.repeat(np.arange(len(sizes)) - np.repeat(tables.cumsum() - tables, tables), sizes)
        if (before != c).any():
            stay = np.ones(len(table), bool)
            stay[self._leaving(keys, before, c, first)] = False
            more = np.repeat(np.arange(len(before)), np.maximum(c - before, 0))
            begin = A.runs(more)
            nth = before[more] + np.arange(len(more)) - np.repeat(begin, np.diff(np.append(begin, len(more))))
            beside = first[more] + (self._draw(A.mix(keys[more] + nth.astype(_U) * _CUSTOMER)) * before[more]).astype(np.int64)
            # who came sits after those who stayed
            came = (c.cumsum() - c)[more] + nth
            old = np.ones(int(c.sum()), bool)
            old[came] = False
            both = np.empty(len(old), np.int64)
            both[old], both[came] = table[stay], table[beside]
            table = both
        return table[np.repeat(c > 1, c)]

    def _leaving(self, keys: np.ndarray, before: np.ndarray, c: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The customers of the least draws of each dish that has fewer than before."""
        fewer = np.flatnonzero(before > c)
        was, leave = before[fewer], (before - c)[fewer]
        own = np.repeat(np.arange(len(fewer)), was)
        nth = np.arange(len(own)) - np.repeat(was.cumsum() - was, was)
        draws = self._draw(A.mix(np.repeat(keys[fewer], was) + nth.astype(_U) * _CUSTOMER))
        # only low draws are put in order, unless too few are low
        low = draws < np.repeat((2 * leave + 8) / was, was)
        low |= np.repeat(np.bincount(own[low], minlength=len(fewer)) < leave, was)
        low = np.flatnonzero(low)
        low = low[np.lexsort((draws[low], own[low]))]
        begin = A.runs(own[low])
        rank = np.arange(len(low)) - np.repeat(begin, np.diff(np.append(begin, len(low))))
        least = low[rank < leave[own[low]]]
        return first[fewer][own[least]] + nth[least]

    def sweep(self, new: np.ndarray, discount: float) -> None:
        """Every customer of a dish with several stands up and sits down again; new: a dish's weight of a new table."""
        t, c = self.t[self.many], self.c[self.many]
        new = new[self.many]
        live = np.arange(len(c))
        for step in range(STEPS):
            live = live[c[live] > step]
            if not len(live):
                break
            # of a dish, every STEPS-th customer stands
            stand = (c[live] + (STEPS - 1 - step)) // STEPS
            dish = np.repeat(live, stand)
            own = STEPS * (np.arange(len(dish)) - np.repeat(stand.cumsum() - stand, stand)) + step
            first = self.first[dish]
            who = first + own
            key = A.mix(self.keys[dish] + own.astype(_U) * _CUSTOMER)
            self.salt = step << 20
            left = self.table[who]
            np.subtract.at(self.size, left, _ONE)
            empty = np.flatnonzero(self.size[left] == 0)
            if len(empty):
                gone = left[empty]
                np.subtract.at(t, dish[empty[self._one_each(gone)]], 1)
                self.size[gone] = 0
            tables, beside, weight = t[dish], np.repeat(c[live] - stand, stand), new[dish]
            seated = np.maximum(beside - discount * tables, 0)
            opens = self._draw(key) * (weight + seated) < weight
            opens |= tables == 0
            # an open place for a new table
            rest = np.flatnonzero(opens)
            served = dish[rest]
            np.add.at(t, served, 1)
            places, place_of = self.places[served], self.place_of[served]
            while len(rest):
                place = place_of + (self._draw(key[rest]) * places).astype(np.int64)
                # of several that choose one place, one takes it
                free = np.flatnonzero(self.size[place] == 0)
                takes = np.zeros(len(rest), bool)
                takes[free[self._one_each(place[free])]] = True
                self.size[place[free]] = 1
                self.table[who[rest[takes]]] = place[takes]
                more = ~takes
                rest, places, place_of = rest[more], places[more], place_of[more]
            # a table in proportion to its size less the discount: that of any customer who sits, taken by chance
            self.salt = step << 20 | 1 << 19
            stay = np.flatnonzero(~opens)
            tables, others, first, keys = tables[stay], beside[stay], first[stay], key[stay]
            # where there is but one table, any customer's will do
            joined = self.table[first + (step == 0)]
            rest = np.flatnonzero(tables > 1)
            tables, others, first, keys = tables[rest], others[rest], first[rest], keys[rest]
            alike = tables == others
            while len(rest):
                which, chance = self._draw_two(keys)
                other = (which * others).astype(np.int64)
                block = other // (STEPS - 1)
                other += block + (other - block * (STEPS - 1) >= step)
                place = self.table[first + other]
                size = self.size[place]
                takes = chance * size < size - discount
                takes |= alike
                joined[rest[takes]] = place[takes]
                more = ~takes
                rest, keys, first, others, alike = rest[more], keys[more], first[more], others[more], alike[more]
            self.table[who[stay]] = joined
            np.add.at(self.size, joined, _ONE)
        self.t[self.many] = t

    def _one_each(self, places: np.ndarray) -> np.ndarray:
        """Which is the first at its place; sizes at the places are lost."""
        at = np.arange(1, len(places) + 1, dtype=self.size.dtype)
        self.size[places[::-1]] = at[::-1]
        return self.size[places] == at

    def sizes(self) -> np.ndarray:
        """Sizes of the tables, all dishes' one after another."""
        out = np.ones(int(self.t.sum()), np.int64)
        out[np.repeat(self.c > 1, self.t)] = self.size[self.size > 0]
        return out


def discount(once: float, twice: float) -> float:
    """From how many dishes have one and two customers."""
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


class Head:
    """What all buckets need: training words and tokens, discounts, and the parent's customers and tables."""

    def __init__(self, words: int, tokens: int, pairs: tuple[int, int], kinds: tuple[int, int], customers: int, tables: int):
        self.words, self.tokens = words, tokens
        self.d1, self.d0 = discount(*pairs), discount(*kinds)
        self.pairs, self.kinds = pairs, kinds
        self.customers, self.tables = customers, tables

    def then(self, customers: int, tables: int) -> Head:
        return Head(self.words, self.tokens, self.pairs, self.kinds, customers, tables)

    @property
    def uniform(self) -> float:
        return 1 / (self.words + 1)

    def parent(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The parent's probability of words with so many customers and tables there."""
        return (customers - self.d0 * tables + (STRENGTH + self.d0 * self.tables) * self.uniform) / (STRENGTH + self.customers)

    def seated(self, c: np.ndarray, keys: np.ndarray, parent: np.ndarray, tables_of: np.ndarray, before: tuple | None, number: int) -> Seating:
        """The customers of pairs after a sweep; tables_of: those of each pair's context."""
        out = Seating(c, keys, *(before or (None, None)), number)
        out.sweep((STRENGTH + self.d1 * tables_of) * parent, self.d1)
        return out

    def seated_parent(self, customers: np.ndarray, keys: np.ndarray, before: tuple | None, number: int) -> Seating:
        out = Seating(customers, keys, *(before or (None, None)), number)
        out.sweep(np.full(len(customers), (STRENGTH + self.d0 * self.tables) * self.uniform), self.d0)
        return out

    def probability(self, c: np.ndarray, t: np.ndarray, customers_of: np.ndarray, tables_of: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """The predictive probability of pairs: their customers and tables, those of their contexts, and the parent's."""
        return (c - self.d1 * t + (STRENGTH + self.d1 * tables_of) * parent) / (STRENGTH + customers_of)


def pair_keys(words: np.ndarray, word: np.ndarray, contexts: np.ndarray, context: np.ndarray) -> np.ndarray:
    return A.mix(words[word] + A.mix(contexts ^ _CUSTOMER)[context])


# --- totals over buckets -----------------------------------------------------------------------------------------

CONTEXT, WORD = 0, 1
#: Messages to shards (with sums, and names at the start), and beside them the state of a bucket.
_SHARE = "bucket int, tables binary, sizes binary, samples array<binary>, shard int, names binary, v binary"
_SHARE_ARROW = pa.schema([("bucket", pa.int32()), ("tables", pa.binary()), ("sizes", pa.binary()), ("samples", pa.list_(pa.binary())), ("shard", pa.int32()), ("names", pa.binary()), ("v", pa.binary())])
#: Replies to buckets, and beside them the state of a shard and what it adds to the sums over all; at the start also its
#: index: which name each sum of its messages, in the order of buckets, belongs to, and the words.
_TOTAL = "shard int, bucket int, v binary, tables binary, sizes binary, sums array<long>, own binary, names binary"
_TOTAL_ARROW = pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), ("v", pa.binary()), ("tables", pa.binary()), ("sizes", pa.binary()), ("sums", pa.list_(pa.int64())), ("own", pa.binary()), ("names", pa.binary())])


def _one_by_one(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of megabytes each: one at a time is unpacked, and memory is given back after it."""
    for i in range(batch.num_rows):
        yield from batch.slice(i, 1).to_pylist()
        A.trim()


def _shares(kind: int, shards: int, bucket: int, names: np.ndarray, v: np.ndarray, named: bool = False) -> list[dict]:
    """What a bucket has of its words or contexts, by shard.  They are in order of their hashes, and so are shards."""
    bounds = np.searchsorted(A.bucket_of(names, shards), np.arange(shards + 1))
    return [{"shard": kind * shards + k, "bucket": bucket, "names": names[lo:hi].tobytes() if named else None, "v": _pack(v[:, lo:hi].ravel())} for k, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)) if lo < hi]


def _read(x: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, contexts, and of each pair its word, context and count."""
    types, context, c = (_unpack(x[k]) for k in ("types", "context", "c"))
    return np.frombuffer(x["words"], _U), np.frombuffer(x["contexts"], _U), np.repeat(np.arange(len(types)), types), context, c


def _counted(shards: int):
    """Training tokens of each context and word, and in how many pairs they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in _one_by_one(batch):
                words, contexts, word, context, c = _read(x)
                sums = lambda of, n: np.stack([np.bincount(of, c, n), np.bincount(of, c > 0, n)]).astype(np.int64)  # noqa: B023, E731
                rows = _shares(CONTEXT, shards, x["bucket"], contexts, sums(context, len(contexts)), True) + _shares(WORD, shards, x["bucket"], words, sums(word, len(words)), True)
                yield from pa.Table.from_pylist(rows, _SHARE_ARROW).to_batches(max_chunksize=64)

    return run


def _swept(shards: int, head: Head, number: int, sampled: bool):
    """A sweep over a bucket's pairs."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        x = next((x for x in rows if x["words"] is not None), None)
        if x is None:
            return pa.Table.from_pylist([], _SHARE_ARROW)
        state = next((x for x in rows if x["words"] is None), None)
        words, contexts, word, context, c = _read(x)
        replies = right.to_pylist()
        tables_of, (parents, roots) = _joined(replies, shards, CONTEXT, 2 if number == 1 else 1)[-1], _joined(replies, shards, WORD, 3 if number == 1 else 2)[-2:]
        some = np.flatnonzero(c)
        before = (_unpack(state["tables"]), _unpack(state["sizes"])) if state else None
        if len(some):
            keys = np.zeros(len(some), _U)
            many = np.flatnonzero(c[some] > 1)
            keys[many] = pair_keys(words, word[some[many]], contexts, context[some[many]])
            seating = head.seated(c[some], keys, head.parent(parents, roots)[word[some]], tables_of[context[some]], before, number)
            t, sizes = seating.t, seating.sizes()
            del seating, keys
        else:
            t = sizes = np.empty(0, np.int64)
        samples = (state["samples"] if state else []) + ([_pack(t)] if sampled else [])
        sums = lambda of, n: np.bincount(of[some], t, n).astype(np.int64)[None]
        out = [{"bucket": x["bucket"], "tables": _pack(t), "sizes": _pack(sizes), "samples": samples}]
        out += _shares(CONTEXT, shards, x["bucket"], contexts, sums(context, len(contexts))) + _shares(WORD, shards, x["bucket"], words, sums(word, len(words)))
        made = pa.Table.from_pylist(out, _SHARE_ARROW)
        del x, rows, replies, out, left, right, state
        A.trim()
        return made

    return run


def _added(shards: int, head: Head | None, number: int):
    """Totals of a shard; one of words seats the parent's customers.  Without a head, at the start, each word has one table there."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        if not rows:
            return pa.Table.from_pylist([], _TOTAL_ARROW)
        shard = rows[0]["shard"]
        rows.sort(key=lambda x: x["bucket"])
        parts, known = [_unpack(x["v"]) for x in rows], right.to_pylist()
        if head is None:
            found = [np.frombuffer(x["names"], _U) for x in rows]
            names, own = np.unique(np.concatenate(found), return_inverse=True)
            index = {"own": _pack(own), "names": names.tobytes() if shard >= shards else None}
            parts, size, n = [x.reshape(-1, len(at)) for x, at in zip(parts, found, strict=True)], [len(x) for x in found], len(names)
            sums = np.stack([np.bincount(own, x, n).astype(np.int64) for x in np.concatenate(parts, axis=1)])
        else:
            index = next(x for x in known if x["own"] is not None)
            names, own = np.frombuffer(index["names"] or b"", _U), _unpack(index["own"])
            index, size = {}, [len(x) for x in parts]
            sums = np.bincount(own, np.concatenate(parts)).astype(np.int64)[None]
        del parts
        beside = {"shard": shard}
        if shard >= shards:
            customers = sums[-1]
            some = np.flatnonzero(customers)
            before = [(_unpack(x["tables"]), _unpack(x["sizes"])) for x in known if x["tables"] is not None]
            roots = np.zeros(len(customers), np.int64)
            if head is None:
                tables, sizes = np.ones(len(some), np.int64), customers[some]
                beside["sums"] = [int((sums[0] > 0).sum()), int(sums[0].sum()), int((customers == 1).sum()), int((customers == 2).sum()), int(customers.sum()), len(some)]
            elif len(some):
                seating = head.seated_parent(customers[some], A.mix(names[some] ^ _PARENT), before[0], number)
                tables, sizes = seating.t, seating.sizes()
            else:
                tables = sizes = np.empty(0, np.int64)
            if head is not None:
                beside["sums"] = [int(customers.sum()), int(tables.sum())]
            beside |= {"tables": _pack(tables), "sizes": _pack(sizes)}
            roots[some] = tables
            sums = np.concatenate([sums, roots[None]])
        out = [beside] + ([{"shard": shard, **index}] if index else [])
        out += [{"shard": shard, "bucket": x["bucket"], "v": _pack(sums[:, own[hi - k : hi]].ravel())} for x, k, hi in zip(rows, size, np.cumsum(size), strict=True)]
        made = pa.Table.from_pylist(out, _TOTAL_ARROW)
        del rows, known, own, sums, out, left, right
        A.trim()
        return made

    return run


def _totals(shares: DataFrame, state: DataFrame, shards: int, head: Head | None, number: int) -> DataFrame:
    """state: rows of shards, (shard, tables, sizes, own, names)."""
    messages = shares.filter("shard IS NOT NULL").select("shard", "bucket", "names", "v")
    return messages.groupBy("shard").cogroup(state.groupBy("shard")).applyInArrow(_added(shards, head, number), _TOTAL)


def _joined(rows: list[dict], shards: int, kind: int, width: int) -> np.ndarray:
    """Totals of a bucket's contexts or words, one row for each kind of sum."""
    own = sorted((x for x in rows if x["shard"] // shards == kind), key=lambda x: x["shard"])
    return np.concatenate([_unpack(x["v"]).reshape(width, -1) for x in own], axis=1)


# --- 4. scores ---------------------------------------------------------------------------------------------------

_PARTS = "chunk long, doc binary, known binary, base binary, base_high binary, score binary, score_high binary, ids binary, train binary, n binary"
_PARTS_ARROW = pa.schema([("chunk", pa.int64()), *((x, pa.binary()) for x in ("doc", "known", "base", "base_high", "score", "score_high", "ids", "train", "n"))])


def _units(p: np.ndarray) -> np.ndarray:
    """Logarithms of probabilities, their sign changed, in whole units."""
    return np.rint(-np.log10(p) * (1 << UNIT))


def _scored(shards: int, heads: list[Head], numbers: list[int]):
    """heads: of the start and of each sample; numbers: the sweeps that are samples."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        x = next((x for x in rows if x["words"] is not None), None)
        if x is None:
            return pa.Table.from_pylist([], _PARTS_ARROW)
        samples = next(x for x in rows if x["words"] is None)["samples"]
        replies = right.to_pylist()
        totals = lambda number, kind, width: _joined([r for r in replies if r["number"] == number], shards, kind, width)
        words, _, word, context, c = _read(x)
        customers_of, total = totals(0, CONTEXT, 2)[0], totals(0, WORD, 3)[0]
        some, p = np.flatnonzero(c), np.zeros(len(c))
        for number, head, packed in zip(numbers, heads[1:], samples, strict=True):
            t = np.zeros(len(c), np.int64)
            t[some] = _unpack(packed)
            p += head.probability(c, t, customers_of[context], totals(number, CONTEXT, 1)[0][context], head.parent(*totals(number, WORD, 2))[word])
        score = _units(p / len(samples))
        n_all, v = heads[0].tokens, heads[0].words
        base = _units((total + BASE_ADD) / (n_all + BASE_ADD * (v + 1)))
        known = (total > 0)[word]
        item = np.repeat(np.arange(len(c)), _unpack(x["counts"]))
        n, doc, chunk = (_unpack(x[k]) for k in ("n", "doc", "chunk"))
        bits = int(doc.max()).bit_length()
        keys, own = np.unique(chunk << bits | doc, return_inverse=True)
        sums = [np.bincount(own, n * v, len(keys)).astype(np.int64) for v in (known[item], base[word][item], score[item])]
        owner = keys >> bits
        first = A.runs(owner)
        out = []
        for lo, hi in zip(first, np.append(first[1:], len(keys)), strict=True):
            parts = {"chunk": int(np.frombuffer(x["chunks"], np.int64)[owner[lo]]), "doc": _pack(keys[lo:hi] & (1 << bits) - 1), "known": _pack(sums[0][lo:hi])}
            for name, s in (("base", sums[1]), ("score", sums[2])):
                parts |= {name: s[lo:hi].astype("<u8").view("<u4")[::2].tobytes(), f"{name}_high": _pack(s[lo:hi] >> 32)}
            out.append(parts)
        made = pa.Table.from_pylist(out, _PARTS_ARROW)
        del x, rows, replies, out, left, right
        A.trim()
        return made

    return run


_SCORES = "id long, train boolean, n_tokens long, n_known long, base double, score double"
_SCORES_ARROW = pa.schema([("id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])


def _summed(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    head = next(x for x in rows if x["ids"] is not None)
    size = len(head["ids"]) // 9
    ids, null = np.frombuffer(head["ids"], np.int64, size), np.frombuffer(head["ids"], bool, size, 8 * size)
    known, base, score = (np.zeros(size, np.int64) for _ in range(3))
    for x in rows:
        if x["ids"] is None:
            doc = _unpack(x["doc"])
            known[doc] += _unpack(x["known"])
            for out, name in ((base, "base"), (score, "score")):
                out[doc] += np.frombuffer(x[name], "<u4").astype(np.int64) + (_unpack(x[f"{name}_high"]) << 32)
    train = np.unpackbits(np.frombuffer(head["train"], np.uint8), count=size).astype(bool)
    of = lambda units: pa.array(0.0 - units / (1 << UNIT))
    return pa.table([pa.array(ids, mask=null), pa.array(train), pa.array(_unpack(head["n"])), pa.array(known), of(base), of(score)], schema=_SCORES_ARROW)


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base, score) of each row, learning from the rows where train holds.

    n_known: tokens that training has; train_tokens: all training tokens; base: log10 probability of the text
    by additively smoothed training counts; score: by the model.  Logarithms of tokens are rounded to 2 ** -UNIT.  A null
    or empty text is one end token.  Every row is a document of its own, repeats too; a null id stays null, and a null in
    train is false.  Without training rows every token is unknown, and has probability 1.  A text of any length is
    counted whole; its tokens must fit in a task.  After burn_in sweeps, `samples` more are averaged.  Scores don't depend on how the rows are laid out.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    side = _grid(buckets(rows, 3))
    shards = max(1, side**2 // BUCKETS_A_SHARD)
    pair = ("bucket", "words", "types", "contexts", "context", "c")
    state_of = ("bucket", "tables", "sizes", "samples")
    with shuffles_removed(spark):
        grouped = keep(rows.mapInArrow(_sent(side, CHUNK_BYTES), _SENT).groupBy("bucket").applyInArrow(_by_bucket, _GROUPED))
        words = grouped.filter("ids IS NULL")
        pairs = words.select(*pair)
        once = [int(v or 0) for v in words.agg(F.sum("one"), F.sum("two")).first()]
        facts = ("shard", "tables", "sizes", "own", "names")
        nothing = spark.createDataFrame([], _TOTAL).select(*facts)
        last = keep(_totals(pairs.mapInArrow(_counted(shards), _SHARE), nothing, shards, None, 0))
        index = last.filter("own IS NOT NULL").select(*facts)
        sums = lambda df, n: [int(v or 0) for v in df.filter("sums IS NOT NULL").agg(*(F.sum(F.col("sums")[i]) for i in range(n))).first()]
        n_words, n_tokens, one0, two0, customers, tables = sums(last, 6)
        head = Head(n_words, n_tokens, (once[0], once[1]), (one0, two0), customers, tables)
        heads, kept, swept = [head], [last], None
        for number in range(1, burn_in + samples + 1):
            left = pairs if swept is None else pairs.unionByName(swept.filter("shard IS NULL").select(*state_of), allowMissingColumns=True)
            left = left if swept is not None else left.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("tables", "binary"), ("sizes", "binary"), ("samples", "array<binary>"))))
            replies = last.filter("bucket IS NOT NULL").select("shard", "bucket", "v")
            now = keep(left.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(_swept(shards, head, number, number > burn_in), _SHARE))
            if swept is not None:
                drop(swept)
            swept, before = now, last
            last = keep(_totals(now, before.filter("tables IS NOT NULL").select(*facts).unionByName(index), shards, head, number))
            head = head.then(*sums(last, 2))
            if number > burn_in:
                heads.append(head)
                kept.append(last)
            if before not in kept:
                drop(before)
        answers = None
        numbers = list(range(burn_in + 1, burn_in + samples + 1))
        for number, df in zip((0, *numbers), kept, strict=True):
            df = df.filter("bucket IS NOT NULL").select("bucket", "shard", "v", F.lit(number).alias("number"))
            answers = df if answers is None else answers.unionByName(df)
        both = words.select(*pair, "counts", "chunks", "chunk", "doc", "n").unionByName(swept.filter("shard IS NULL").select("bucket", "samples"), allowMissingColumns=True)
        found = keep(both.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_scored(shards, heads, numbers), _PARTS))
        drop(swept, *kept)
    ids = grouped.filter("ids IS NOT NULL").select(F.col("own").alias("chunk"), "ids", "train", "n")
    out = found.unionByName(ids, allowMissingColumns=True).groupBy("chunk").applyInArrow(_summed, _SCORES)
    return out.select("id", "train", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base", "score")

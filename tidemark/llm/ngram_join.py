"""N-gram Jaccard join of documents by prefix trees.

Documents link if their sets of word n-grams have a Jaccard similarity of THRESHOLD percent or more.

1. The n-grams of a chunk travel to buckets as packed hashes.  One that several documents of the chunk have is
   shared anyway and is sent once, with how many have it; for the others a bucket tells whether any other
   document has it.  A document that shares less than THRESHOLD percent of its set has no link and goes.
2. The sets of the others are put in one global order: very frequent n-grams last, then by hash.  Equal sets
   are one class, of which one set goes on.
3. Two sets that link share an n-gram among the first few of each (prefix filter).  The sets that share such a
   leading n-gram form a group.  A group's sets stand in a trie of the ordered n-grams, and its sets traverse
   it: a walk carries the overlaps of all branches down together, each shared by all sets below, and
   leaves a branch once its overlap and what remains on either side can't reach the threshold, or once
   all sets below are already connected with the one that walks.  The set most like the others walks first.
   A group gives only the links that connect something, so its rows follow its size, not the square.
4. This is done twice: first for the first LEAD n-grams of each set, which connects nearly all; then for all
   leading n-grams, and the lists whose sets aren't all connected by then.  So no link that matters for a
   component is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import arrays as A
from tidemark.llm.components import components
from tidemark.llm.filters import bitmap, bits_for, holds, of_ids, position
from tidemark.llm.store import buckets, documents_of, drop, keep, shuffles_removed, small_batches

N = 5
THRESHOLD = 75
CHUNK_WORDS = 1 << 20
#: An n-gram is very frequent if it is in so many documents, and in so large a share of all.
FREQUENT, FREQUENT_SHARE = 64, 1e-4
#: Bits of the filter of frequent n-grams, which is broadcast.
GRAM_BITS = 23
#: In the first round, sets meet by so many of their leading n-grams.
LEAD = 4
#: Sets of a trie at most, and sets in one task's groups.  A larger group is cut into tries that the sets
#: outside its largest component all traverse, TREE of them in a task; in the first round so many sets, drawn by hash, do.
TREE, GROUP, PIVOTS = 1024, 512, 64
#: A run of n-grams that a node of a trie holds at most: what is tested before branches may be left.
RUN = 48

_U = np.uint64
_LOW = _U((1 << 63) - 1)
_TOP = _U(1 << 63)


def gram_sets(data: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, second hash) of the distinct n-grams of each row, by row and hash; A-Z count as a-z.

    A row of fewer words has its whole sequence as the only one; a row without words has none.
    """
    starts, ends, first = A.split_words(data, rows)
    words = A.hash_words(data, starts, ends, fold=True)
    count = np.diff(first)
    length = np.maximum(count - n + 1, 0)
    row = np.repeat(np.arange(len(count)), length)
    where = first[row] + np.arange(len(row)) - np.repeat(length.cumsum() - length, length)
    one, two = (A.hash_runs(words, n, seed)[where] for seed in (1, 2))
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        row = np.concatenate([row, short])
        one, two = (np.concatenate([x, A.hash_rows(words, first, seed)[short]]) for x, seed in ((one, 1), (two, 2)))
    one = one & _LOW
    order = np.argsort(one)
    order = order[np.argsort(row[order].astype(np.uint16 if len(count) <= 1 << 16 else np.int64), kind="stable")]
    row, one, two = row[order], one[order], two[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (one[1:] != one[:-1])
    return row[new], one[new], two[new]


def _slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets) of whole documents, about 6 * most bytes at a time."""
    for batch in batches:
        data, rows = A.text_bytes(batch.column(1))
        ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
        lo = 0
        while lo < len(ids):
            hi = max(lo + 1, int(np.searchsorted(rows, rows[lo] + 6 * most, side="right")) - 1)
            yield ids[lo:hi], data[rows[lo] : rows[hi]], rows[lo : hi + 1] - rows[lo]
            lo = hi


# --- 1. how much of a document is shared -------------------------------------------------------------------------

_SENT = "bucket int, chunk long, docs binary, counts binary, grams binary, often binary, times binary, ids binary, n binary, own binary"
_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), *((c, pa.binary()) for c in ("docs", "counts", "grams", "often", "times", "ids", "n", "own"))])
_SHARED = "chunk long, docs binary, shared binary, frequent binary, ids binary, n binary, own binary"
_SHARED_ARROW = pa.schema([("chunk", pa.int64()), *((c, pa.binary()) for c in ("docs", "shared", "frequent", "ids", "n", "own"))])
_SIZES = "id long, n long, shared long"
_SIZES_ARROW = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("shared", pa.int64())])


def _grams(n: int, parts: int, most: int):
    """Of each chunk, a message to each bucket, and one row with its documents' ids, set sizes and n-grams shared inside it.

    An n-gram is named by 32 bits of one hash and the bucket, which another one chooses.  A bucket's n-grams are bounded,
    so few share a name by chance, and these only let a document pass that has no link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, rows in _slices(batches, most):
            row, one, two = gram_sets(data, rows, n)
            bucket, name = A.bucket_of(two, parts), (one >> _U(31)).astype(np.uint32)
            order = np.argsort(one)
            begin = A.runs(one[order])
            times = np.diff(np.append(begin, len(order)))
            lone = np.zeros(len(one), bool)
            lone[order[begin[times == 1]]] = True
            own = np.bincount(row[~lone], minlength=len(ids))
            often, times = order[begin[times > 1]], times[times > 1]
            alone = np.flatnonzero(lone)
            by, bounds = A.grouped(bucket[alone], parts)
            by_often, often_bounds = A.grouped(bucket[often], parts)
            out = [{"bucket": int(ids[0]) % parts, "chunk": int(ids[0]), "ids": ids.tobytes(), "n": A.pack_positions(np.bincount(row, minlength=len(ids))), "own": A.pack_positions(own)}]
            for b in np.flatnonzero(np.diff(bounds) + np.diff(often_bounds)):
                i, j = alone[by[bounds[b] : bounds[b + 1]]], by_often[often_bounds[b] : often_bounds[b + 1]]
                first = A.runs(row[i])
                out.append({
                    "bucket": int(b), "chunk": int(ids[0]), "docs": A.pack_positions(row[i][first]), "counts": A.pack_positions(np.diff(np.append(first, len(i)))),
                    "grams": name[i].tobytes(), "often": name[often[j]].tobytes(), "times": A.pack_positions(times[j]),
                })
            yield from pa.Table.from_pylist(out, _SENT_ARROW).to_batches(max_chunksize=64)
            del out, row, one, two, bucket, name, order, begin, lone, often, alone, by, by_often
            A.trim()

    return run


def _share(frequent: int):
    def run(table: pa.Table) -> pa.Table:
        told = table["ids"].is_valid()
        out = table.filter(told).select(["chunk", "ids", "n", "own"]).to_pylist()
        rows = table.filter(pc.invert(told)).select(["chunk", "docs", "counts", "grams", "often", "times"]).to_pylist()
        if rows:
            grams = np.concatenate([np.frombuffer(x[c], np.uint32) for c in ("grams", "often") for x in rows])
            weight = np.concatenate([np.ones(sum(len(x["grams"]) for x in rows) // 4, np.int64), *(A.unpack_positions(x["times"]) for x in rows)])
            order = np.argsort(grams)
            begin = A.runs(grams[order])
            df = np.add.reduceat(weight[order], begin)
            both = np.empty(len(grams), np.int64)
            both[order] = np.repeat(df > 1, np.diff(np.append(begin, len(order))))
            out.append({"frequent": np.unique(grams[order[begin[df >= frequent]]] >> np.uint32(32 - GRAM_BITS)).astype(np.int32).tobytes()})
            at = 0
            for x in rows:
                counts = A.unpack_positions(x["counts"])
                if not len(counts):
                    continue
                shared = np.add.reduceat(both, at + counts.cumsum() - counts)
                at += int(counts.sum())
                some = shared > 0
                if some.any():
                    out.append({"chunk": x["chunk"], "docs": A.pack_positions(A.unpack_positions(x["docs"])[some]), "shared": A.pack_positions(shared[some])})
            del grams, weight, order, both, begin, df
        made = pa.Table.from_pylist(out, _SHARED_ARROW)
        del out, rows
        A.trim()
        return made

    return run


def _total(table: pa.Table) -> pa.Table:
    rows = table.select(["docs", "shared", "ids", "n", "own"]).to_pylist()
    head = next(x for x in rows if x["ids"] is not None)
    shared = A.unpack_positions(head["own"]).copy()
    for x in rows:
        if x["ids"] is None:
            shared[A.unpack_positions(x["docs"])] += A.unpack_positions(x["shared"])
    return pa.table([pa.array(np.frombuffer(head["ids"], np.int64)), pa.array(A.unpack_positions(head["n"])), pa.array(shared)], schema=_SIZES_ARROW)


def _gram_positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = np.concatenate([np.empty(0, np.int32), *(np.frombuffer(x, np.int32) for x in batch.column(0).to_pylist())])
        yield pa.record_batch([pa.array(np.unique(at).astype(np.int64))], names=["at"])


# --- 2. ordered sets and their classes ---------------------------------------------------------------------------

_KEYS, _SETS = "id long, key string", "id long, n long, grams binary"


def _ordered_sets(n: int, bits: int, docs, grams, most: int, keys: bool):
    """The ordered set of each document that passes the filter; keys: a digest of it only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            wanted = pa.array(holds(docs.value, position(ids, bits)))
            for own, data, rows in _slices(iter([batch.filter(wanted)]), most):
                row, one, _ = gram_sets(data, rows, n)
                often = holds(grams.value, (one >> _U(63 - GRAM_BITS)).astype(np.int64))
                ranked = np.where(often, one | _TOP, one)
                begin = np.searchsorted(row, np.arange(len(own) + 1))
                some = np.flatnonzero(np.diff(begin))
                sets = [np.sort(ranked[begin[i] : begin[i + 1]]).astype(">u8").tobytes() for i in some]
                ids_of = pa.array(own[some])
                if keys:
                    yield pa.record_batch([ids_of, pa.array([hashlib.blake2b(a, digest_size=16).hexdigest() for a in sets], pa.string())], names=["id", "key"])
                else:
                    yield pa.record_batch([ids_of, pa.array([len(a) // 8 for a in sets], pa.int64()), pa.array(sets, pa.binary())], names=["id", "n", "grams"])

    return run


# --- 3. groups ---------------------------------------------------------------------------------------------------


def need(a: np.ndarray, b: np.ndarray, threshold: int) -> np.ndarray:
    """The least overlap of sets of a and b members that link."""
    return -(-threshold * (a + b) // (100 + threshold))


def prefix(n: int, threshold: int) -> int:
    """Two sets that link share a member among the first so many of each."""
    return n - -(-threshold * n // 100) + 1


_POSTED = "bucket int, ids binary, labels binary, counts binary, grams binary"
_POSTED_ARROW = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("ids", "labels", "counts", "grams"))])
_MET = "g long, id long"


def _posted(parts: int, threshold: int, lead: int | None):
    """Each set under its leading n-grams, at most `lead` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, label = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False), np.int64) for i in (0, 1, 3))
            take = np.array([prefix(int(x), threshold) for x in n], np.int64)
            take = take if lead is None else np.minimum(take, lead)
            grams = np.concatenate([np.empty(0, ">u8"), *(np.frombuffer(x.as_py(), ">u8", count=k) for x, k in zip(batch.column(2), take, strict=True))]).astype(_U)
            row = np.repeat(np.arange(len(ids)), take)
            order, bounds = A.grouped(A.bucket_of(A.mix(grams.copy()), parts), parts)
            out = []
            for b in np.flatnonzero(np.diff(bounds)):
                i = order[bounds[b] : bounds[b + 1]]
                first = A.runs(row[i])
                own = row[i][first]
                out.append({"bucket": int(b), "ids": ids[own].tobytes(), "labels": label[own].tobytes(), "counts": A.pack_positions(np.diff(np.append(first, len(i)))), "grams": grams[i].tobytes()})
            yield from pa.Table.from_pylist(out, _POSTED_ARROW).to_batches(max_chunksize=64)

    return run


def _lists(table: pa.Table) -> pa.Table:
    """(g, id): the sets of each n-gram's list whose labels differ, under the list's least label."""
    parts = [(np.frombuffer(x["ids"], np.int64), np.frombuffer(x["labels"], np.int64), A.unpack_positions(x["counts"])) for x in table.select(["ids", "labels", "counts"]).to_pylist()]
    ids, labels = (np.concatenate([np.repeat(p[i], p[2]) for p in parts]) for i in range(2))
    grams = np.concatenate([np.frombuffer(x, _U) for x in table["grams"].to_pylist()])
    order = np.argsort(grams)
    ids, labels, begin = ids[order], labels[order], A.runs(grams[order])
    size = np.diff(np.append(begin, len(order)))
    least, most = np.minimum.reduceat(labels, begin), np.maximum.reduceat(labels, begin)
    mixed = np.repeat(least != most, size)
    g, ids = np.repeat(least, size)[mixed], ids[mixed]
    order = np.lexsort((ids, g))
    g, ids = g[order], ids[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (ids[1:] != ids[:-1])
    return pa.table([pa.array(g[new]), pa.array(ids[new])], names=["g", "id"])


class PrefixTree:
    """A trie of ordered n-gram sets (arrays of rising ranks).

    A node is a run of at most RUN n-grams that the sets lo..hi, in their order in the trie, share.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.universe = np.unique(np.concatenate(sets)) if sets else np.empty(0, _U)
        sets = [np.searchsorted(self.universe, s).astype(">u4") for s in sets]
        self.order = np.array(sorted(range(len(sets)), key=lambda i: sets[i].tobytes()), np.int64)
        self.sizes = np.array([len(sets[i]) for i in self.order], np.int64)
        self.flat = np.concatenate([sets[i] for i in self.order]).astype(np.int64) if sets else np.empty(0, np.int64)
        self.start = np.concatenate([[0], self.sizes.cumsum()])
        self._build()

    def _common(self) -> np.ndarray:
        """How many leading n-grams each set shares with the next one."""
        out = np.minimum(self.sizes[:-1], self.sizes[1:])
        for i in range(len(out)):
            a, b = self.start[i], self.start[i + 1]
            differ = self.flat[a : a + out[i]] != self.flat[b : b + out[i]]
            at = int(differ.argmax()) if len(differ) else 0
            if len(differ) and differ[at]:
                out[i] = at
        return out

    def _build(self) -> None:
        common = self._common()
        nodes, children, at = [], [], 0
        todo = [(0, len(self.sizes), 0)] if len(self.sizes) else []

        def below(lo: int, hi: int, depth: int) -> None:
            cuts = (lo + 1 + np.flatnonzero(common[lo : hi - 1] <= depth)).tolist()
            for a, b in zip([lo, *cuts], [*cuts, hi], strict=True):
                end = int(common[a : b - 1].min()) if b - a > 1 else int(self.sizes[a])
                nodes.append((a, b, depth, min(end, depth + RUN), end))

        if todo:
            below(*todo[0])
        self.roots = np.arange(len(nodes))
        while at < len(nodes):
            lo, hi, begin, end, whole = nodes[at]
            children.append(len(nodes))
            if end < whole:
                nodes.append((lo, hi, end, min(whole, end + RUN), whole))
            elif hi - lo > 1:
                below(lo, hi, end)
            at += 1
        children.append(len(nodes))
        table = np.array(nodes, np.int64).reshape(-1, 5)
        self.lo, self.hi, self.begin, self.end, whole = table.T
        self.child = np.array(children, np.int64)
        self.leaf = np.diff(self.child) == 0
        self.smallest = np.array([self.sizes[lo:hi].min() for lo, hi in zip(self.lo, self.hi, strict=True)], np.int64)
        self.largest = np.array([self.sizes[lo:hi].max() for lo, hi in zip(self.lo, self.hi, strict=True)], np.int64)

    def search(self, probe: np.ndarray, threshold: int, other: np.ndarray | None = None) -> list[int]:
        """Numbers of the sets that link with the probe; other: of each set, whether it is looked for."""
        total, found = len(probe), [np.empty(0, np.int64)]
        at = np.searchsorted(self.universe, probe)
        at = at[self.universe[np.minimum(at, len(self.universe) - 1)] == probe]
        mark = np.zeros(len(self.universe), np.int64)
        mark[at] = 1
        # n-grams of the probe up to each one of the trie's
        upto = np.searchsorted(probe, self.universe, side="right")
        wanted = np.concatenate([[0], np.cumsum(np.ones(len(self.order), np.int64) if other is None else other[self.order])])
        node, overlap = self.roots, np.zeros(len(self.roots), np.int64)
        left = np.full(len(node), total)
        while len(node):
            some = wanted[self.hi[node]] > wanted[self.lo[node]]
            node, overlap, left = node[some], overlap[some], left[some]
            begin, size = self.start[self.lo[node]] + self.begin[node], self.end[node] - self.begin[node]
            ends = size.cumsum()
            where = np.repeat(begin - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)
            same = np.concatenate([[0], mark[self.flat[where]].cumsum()])
            overlap = overlap + same[ends] - same[ends - size]
            left = np.where(size > 0, total - upto[self.flat[np.maximum(begin + size - 1, 0)]], left)
            fits = overlap + np.minimum(self.largest[node] - self.end[node], left) >= need(total, self.smallest[node], threshold)
            node, overlap, left = node[fits], overlap[fits], left[fits]
            leaf = self.leaf[node]
            # at a leaf nothing remains of the set, so what fits links
            found.append(self.order[self.lo[node[leaf]]])
            node, overlap, left = node[~leaf], overlap[~leaf], left[~leaf]
            many = self.child[node + 1] - self.child[node]
            ends = many.cumsum()
            overlap, left = np.repeat(overlap, many), np.repeat(left, many)
            node = np.repeat(self.child[node] - ends + many, many) + np.arange(int(ends[-1]) if len(ends) else 0)
        return np.concatenate(found).tolist()

    def centrality(self) -> np.ndarray:
        """Of each set, in how many sets of the trie its n-grams are on average."""
        df = np.bincount(self.flat, minlength=len(self.universe))
        out = np.empty(len(self.order))
        out[self.order] = np.add.reduceat(df[self.flat], self.start[:-1]) / self.sizes
        return out


def connect(sets: list[np.ndarray], labels: np.ndarray, walkers: np.ndarray | None, threshold: int) -> list[tuple[int, int]]:
    """Links between sets that connect all labels that links of these sets connect, one for each two that become one.

    walkers: only links of these are looked for.
    """
    tree = PrefixTree(sets)
    label = np.unique(labels, return_inverse=True)[1]
    size = np.bincount(label)
    rest = np.argsort(-tree.centrality(), kind="stable").tolist()
    if walkers is not None:
        rest = [i for i in rest if walkers[i]]
    out = []
    while rest:
        # sets of the largest component need not walk: those outside do
        waiting, moved = [], False
        for i in rest:
            if walkers is None and size[label[i]] > 1 and size[label[i]] == size.max():
                waiting.append(i)
                continue
            moved = True
            other = label != label[i]
            found = np.array(tree.search(sets[i], threshold, other), np.int64) if other.any() else np.empty(0, np.int64)
            joined, one = np.unique(label[found], return_index=True)
            out += [(i, int(found[k])) for k in one]
            if len(joined):
                size[label[i]] += size[joined].sum()
                size[joined] = 0
                label[np.isin(label, joined)] = label[i]
        rest = waiting
        if not moved:
            largest = label[rest[0]]
            if (label[rest] == largest).all():
                break
            # several are as large: sets of all but one walk
            size[largest] += 1
    return out


def all_links(sets: list[np.ndarray], walkers: np.ndarray | None, threshold: int) -> list[tuple[int, int]]:
    """All links of the sets, or of those that walk."""
    tree = PrefixTree(sets)
    return [(i, j) for i in range(len(sets)) if walkers is None or walkers[i] for j in tree.search(sets[i], threshold) if j != i]


_PAIRS = "a long, b long"


def _walked(threshold: int, every: bool):
    def run(table: pa.Table) -> pa.Table:
        g, block, slab, ids, walks, split, labels = (table[c].to_numpy() for c in ("g", "block", "slab", "id", "walks", "split", "label"))
        grams = table["grams"]
        order = np.lexsort((~walks, ids, slab, block, g))
        change = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in (g, block, slab)])
        # a set that walks may stand in the block too
        twice = np.concatenate([[False], ~change & (ids[order][1:] == ids[order][:-1])])
        first = np.concatenate([[0], np.flatnonzero(change) + 1])
        a, b = [], []
        for lo, hi in zip(first, np.append(first[1:], len(order)), strict=True):
            own = order[lo:hi][~twice[lo:hi]]
            if len(own) < 2:
                continue
            sets = [np.frombuffer(grams[int(i)].as_py(), ">u8").astype(_U) for i in own]
            walkers = walks[own] if split[own[0]] else None
            found = all_links(sets, walkers, threshold) if every else connect(sets, labels[own], walkers, threshold)
            for i, j in found:
                a.append(ids[own[i]])
                b.append(ids[own[j]])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _round(sets: DataFrame, threshold: int, parts: int, lead: int | None, every: bool = False) -> DataFrame:
    """(a, b): links that the groups of sets (id, n, grams, label) give."""
    posted = sets.select("id", "n", "grams", "label").mapInArrow(_posted(parts, threshold, lead), _POSTED)
    met = keep(posted.groupBy("bucket").applyInArrow(_lists, _MET).distinct())
    large = keep(met.groupBy("g").count().filter(F.col("count") > TREE))
    tries = F.ceil(F.col("count") / TREE).cast("long").alias("tries")
    slabs = lambda walking: F.greatest(F.lit(1), F.ceil(walking / TREE)).cast("long").alias("slabs")
    if every:
        walks, large = F.lit(True), large.select("g", tries, slabs(F.col("count")))
    elif lead is not None:
        walks, large = F.pmod(F.xxhash64("id", F.lit(1)), F.col("tries") * max(1, TREE // PIVOTS)) == 0, large.select("g", tries, slabs(F.lit(PIVOTS)))
    else:
        # all but the largest component of a large group walk
        inside = met.join(large, "g").join(sets.select("id", "label"), "id").groupBy("g", "count", "label").agg(F.count("*").alias("k"))
        walks, large = F.col("label") != F.col("largest"), keep(inside.groupBy("g", "count").agg(F.max_by("label", "k").alias("largest"), F.max("k").alias("k")).select("g", tries, slabs(F.col("count") - F.col("k")), "largest"))
    rows = met.join(large, "g", "left").withColumn("split", F.col("tries").isNotNull())
    rows = rows.withColumn("tries", F.coalesce("tries", F.lit(1))).withColumn("slabs", F.coalesce("slabs", F.lit(1)))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = rows.select("g", F.pmod(F.xxhash64("id"), "tries").alias("block"), numbers("slabs").alias("slab"), "id", "split", F.lit(False).alias("walks"))
    again = rows.filter("split").join(sets.select("id", "label"), "id").filter(walks).select("g", numbers("tries").alias("block"), F.pmod(F.xxhash64("id", F.lit(2)), "slabs").alias("slab"), "id", "split", F.lit(True).alias("walks"))
    tasks = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), met.count() // GROUP)
    units = own.unionByName(again).withColumn("part", F.pmod(F.xxhash64("g", "block", "slab"), F.lit(tasks)).cast("int"))
    links = keep(units.join(sets.select("id", "label", "grams"), "id").groupBy("part").applyInArrow(_walked(threshold, every), _PAIRS))
    drop(met)
    return links


def _classes(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(ids, sizes, members, sets): members (id, class) of those that may link, and the ordered set of each class."""
    spark = docs.sparkSession
    rows = documents_of(docs, id_col, text_col)
    ids = rows.select("id")
    total = ids.count()
    parts = buckets(rows, 2)
    texts = rows.filter("text IS NOT NULL")
    sent = texts.mapInArrow(_grams(n, parts, CHUNK_WORDS), _SENT)
    shared = keep(sent.groupBy("bucket").applyInArrow(_share(max(FREQUENT, int(FREQUENT_SHARE * total))), _SHARED))
    sizes = keep(shared.filter("chunk IS NOT NULL").groupBy("chunk").applyInArrow(_total, _SIZES))

    bits = bits_for(total)
    wanted = sizes.filter(100 * F.col("shared") >= threshold * F.col("n")).filter("n > 0")
    doc_filter = spark.sparkContext.broadcast(of_ids(wanted.select("id"), bits))
    gram_filter = spark.sparkContext.broadcast(bitmap(shared.filter("frequent IS NOT NULL").select("frequent").mapInArrow(_gram_positions, "at long"), GRAM_BITS))
    drop(shared)
    keys = keep(texts.mapInArrow(_ordered_sets(n, bits, doc_filter, gram_filter, CHUNK_WORDS, True), _KEYS))
    classes = keep(keys.groupBy("key").agg(F.min("id").alias("class")))
    members = keep(keys.join(classes, "key").select("id", "class"))
    # a document that passes this filter by chance stands beside its class, with the same set
    class_filter = spark.sparkContext.broadcast(of_ids(classes.select(F.col("class").alias("id")), bits))
    sets = keep(texts.mapInArrow(_ordered_sets(n, bits, class_filter, gram_filter, CHUNK_WORDS, False), _SETS))
    drop(keys, classes)
    return ids, sizes, members, sets


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: int = THRESHOLD) -> DataFrame:
    """(id, n_grams, component): the size of each document's set, and the least id that links lead to.

    Two documents link if 100 * common n-grams >= threshold * n-grams of either.  Words are lower-cased in
    A-Z; a text of fewer than n words is one n-gram; a null or empty text, or one without words, has none
    and links with nothing.  One row for each id: of rows that share an id the one with the least text
    counts.  A row without an id is returned with nulls.  Extra columns are ignored.  A text of any length is
    taken whole; its set must fit in a task.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with shuffles_removed(spark):
        ids, sizes, members, sets = _classes(docs, id_col, text_col, n, threshold)
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sets.rdd.getNumPartitions())
        links = _round(sets.withColumn("label", F.col("id")), threshold, parts, LEAD)
        found = components(links).withColumnRenamed("component", "label")
        labelled = keep(sets.join(found, "id", "left").withColumn("label", F.coalesce("label", "id")))
        drop(sets)
        more = _round(labelled, threshold, parts, None)
        drop(labelled)
        found = components(links.unionByName(more)).select(F.col("id").alias("class"), "component")
        linked = members.join(found, "class", "left").select("id", F.coalesce("component", "class").alias("component"))
    out = ids.join(sizes.select("id", "n"), "id", "left").join(linked, "id", "left")
    out = out.select("id", F.coalesce("n", F.lit(0)).alias("n_grams"), F.coalesce("component", "id").alias("component"))
    nothing = F.lit(None).cast("long")
    return out.unionByName(docs.filter(F.col(id_col).isNull()).select(nothing.alias("id"), nothing.alias("n_grams"), nothing.alias("component")))


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members, links): (id, class) of the documents that may link, and all links (a, b), a < b, between classes.

    A class is the documents of one set, named by its least id; its documents link with each other.  All else is as in join.  The links
    of a group of documents that all link are as many as its pairs of different sets.
    """
    small_batches(docs.sparkSession)
    with shuffles_removed(docs.sparkSession):
        _, _, members, sets = _classes(docs, id_col, text_col, n, threshold)
        found = _round(sets.withColumn("label", F.col("id")), threshold, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), sets.rdd.getNumPartitions()), None, every=True)
    real = members.select("class").distinct()
    pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return members, pairs.join(real.withColumnRenamed("class", "a"), "a", "left_semi").join(real.withColumnRenamed("class", "b"), "b", "left_semi")

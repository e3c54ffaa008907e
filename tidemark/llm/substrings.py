"""Removal of word sequences that already occur in an earlier document.

The corpus is a de Bruijn graph over words: an edge is a window of `window` words, its nodes the first and
the last window - 1 of these, and edges that follow each other in a document share a node.  An edge is
repeated for a document if a document with a smaller id has it too.  Edges travel as packed arrays:

1. Each task hashes the edges of a chunk of documents, resolves copies inside the chunk to their first
   place in it, and sends one document's occurrences of an edge to the edge's bucket (so a very common
   passage arrives once from each chunk, however many documents hold it).
2. A bucket finds the first place of each edge, and names it to the buckets of the documents that have the
   edge later: (document, position, source document, source position).
3. There, edges that go on alike in the document and in its source compact to one path.  A path ends at a
   node where the two branch.
4. Spark joins bring each distinct path to its source's text, which gives a 128-bit digest of the words that
   stand there, and the digests to the documents that repeat the path.
5. A span is removed if the digest of its own words is the source's; if not, two windows had equal hashes,
   and the job stops.

An edge is told from others by two independent 64-bit hashes (across chunks one whole, and of the other the
bits that choose a bucket).  The graph isn't written out as a table: paths are those that a document shares
with one source, and a node's other neighbours aren't counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import arrays as A
from tidemark.llm.filters import bits_for, kept_rows, of_ids, rows_by_id, split
from tidemark.llm.store import buckets, documents_of, keep, small_batches

WINDOW = 50
CHUNK_WORDS = 1 << 19

#: Paths of one source that a row asks for; a source with more is dealt to several rows.
PATHS_A_ROW = 4096

_PARTS = ("docs", "sources", "shifts", "counts", "at", "lengths")
_FOUND = "bucket int, " + ", ".join(f"{x} binary" for x in _PARTS)
_SENT = f"{_FOUND}, edges binary"
_RUNS = "id long, first long, words long, source long, at long"
_PROOFS = "source long, at long, words long, proof binary"
_KEPT = "id long, n_words long, n_removed long, kept string"
_FOUND_ARROW = pa.schema([("bucket", pa.int32()), *((x, pa.binary()) for x in _PARTS)])
_SENT_ARROW = _FOUND_ARROW.append(pa.field("edges", pa.binary()))
_RUNS_ARROW = pa.schema([(x, pa.int64()) for x in ("id", "first", "words", "source", "at")])
_PROOFS_ARROW = pa.schema([("source", pa.int64()), ("at", pa.int64()), ("words", pa.int64()), ("proof", pa.binary())])
_PATHS = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("proof", pa.binary())]))


def _packed(doc: np.ndarray, source: np.ndarray, shift: np.ndarray, at: np.ndarray, length: np.ndarray) -> dict:
    """Runs of edges in their order: each (document, source, shift) in a row once, how many runs it has, and these."""
    head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (source[1:] != source[:-1]) | (shift[1:] != shift[:-1])]))
    own = {"docs": doc[head].tobytes(), "sources": source[head].tobytes(), "shifts": shift[head].tobytes()}
    counts = A.pack_positions(np.diff(np.append(head, len(doc))))
    return {**own, "counts": counts, "at": A.pack_positions(at), "lengths": b"" if (length == 1).all() else A.pack_positions(length)}


def _unpacked(rows: pa.Table) -> tuple[np.ndarray, ...]:
    out = [[np.empty(0, np.int64)] for _ in range(5)]
    for docs, sources, shifts, counts, at, lengths in zip(*(rows[x].to_pylist() for x in _PARTS), strict=True):
        n = A.unpack_positions(counts)
        for have, x in zip(out, (docs, sources, shifts), strict=False):
            have.append(np.repeat(np.frombuffer(x, np.int64), n))
        out[3].append(A.unpack_positions(at))
        out[4].append(A.unpack_positions(lengths) if lengths else np.ones(len(out[3][-1]), np.int64))
    return tuple(np.concatenate(x) for x in out)


def _by_document(n: int, doc: np.ndarray, source: np.ndarray, shift: np.ndarray, at: np.ndarray, length: np.ndarray) -> Iterator[dict]:
    """Packed runs for each bucket of documents."""
    order, bounds = A.grouped(A.bucket_of(A.mix(doc.view(np.uint64)), n), n)
    for b in np.flatnonzero(np.diff(bounds)):
        i = order[bounds[b] : bounds[b + 1]]
        i = i[np.lexsort((at[i], shift[i], source[i], doc[i]))]
        yield {"bucket": int(b), **_packed(doc[i], source[i], shift[i], at[i], length[i])}


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, word hashes, word offsets) of about `most` words, whole documents each."""
    ids, words, counts, have = [], [], [], 0
    for batch in batches:
        data, rows = A.text_bytes(batch.column(1))
        own = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
        lo = 0
        while lo < len(own):
            hi = max(lo + 1, int(np.searchsorted(rows, rows[lo] + 6 * most, side="right")) - 1)
            part = data[rows[lo] : rows[hi]]
            starts, ends, first = A.split_words(part, rows[lo : hi + 1] - rows[lo])
            ids.append(own[lo:hi])
            words.append(A.hash_words(part, starts, ends))
            counts.append(np.diff(first))
            have, lo = have + len(starts), hi
            if have >= most:
                yield np.concatenate(ids), np.concatenate(words), np.concatenate([[0], *counts]).cumsum()
                ids, words, counts, have = [], [], [], 0
    if ids:
        yield np.concatenate(ids), np.concatenate(words), np.concatenate([[0], *counts]).cumsum()


def _edges(window: int, n: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, first in _chunks(batches, most):
            by = np.argsort(ids)
            length = np.maximum(np.diff(first) - window + 1, 0)[by]
            # edges in the order of (id, position), so that the least number is the first place
            doc = np.repeat(by, length)
            if not len(doc):
                continue
            at = np.arange(len(doc)) - np.repeat(length.cumsum() - length, length)
            where = first[doc] + at
            edge, other = A.hash_runs(words, window, 1)[where], A.hash_runs(words, window, 2)[where]
            order = np.argsort(edge)
            begin = A.runs(edge[order])
            source = np.empty(len(doc), np.int64)
            source[order] = np.repeat(np.minimum.reduceat(order, begin), np.diff(np.append(begin, len(order))))
            told = (doc[source] != doc) & (other[source] == other)
            i = np.flatnonzero(told)
            rows = []
            if len(i):
                j = source[i]
                head = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (np.diff(j) != 1) | (np.diff(doc[i]) != 0) | (np.diff(doc[j]) != 0)]))
                i, j, size = i[head], j[head], np.diff(np.append(head, len(i)))
                rows += [{**x, "edges": None} for x in _by_document(n, ids[doc[i]], ids[doc[j]], at[j] - at[i], at[i], size)]
            sent = np.flatnonzero(~told)
            order, bounds = A.grouped(A.bucket_of(other[sent], n), n)
            for b in np.flatnonzero(np.diff(bounds)):
                i = sent[order[bounds[b] : bounds[b + 1]]]
                none = np.zeros(len(i), np.int64)
                rows.append({"bucket": int(b), **_packed(ids[doc[i]], none, none, at[i], none + 1), "sources": b"", "shifts": b"", "edges": edge[i].tobytes()})
            yield from pa.Table.from_pylist(rows, _SENT_ARROW).to_batches(max_chunksize=64)
            del rows, words, doc, at, where, edge, other, order, begin, source, told, sent, bounds, i
            A.trim()

    return run


def _asked(rows: pa.Table) -> tuple[np.ndarray, ...]:
    doc, at, edge = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for d, c, a, e in zip(*(rows[x].to_pylist() for x in ("docs", "counts", "at", "edges")), strict=True):
        doc.append(np.repeat(np.frombuffer(d, np.int64), A.unpack_positions(c)))
        at.append(A.unpack_positions(a))
        edge.append(np.frombuffer(e, np.uint64))
    return np.concatenate(doc), np.concatenate(at), np.concatenate(edge)


def _repeated(n: int):
    def run(table: pa.Table) -> pa.Table:
        asked = pc.is_valid(table["edges"])
        rows = table.filter(pc.invert(asked)).drop_columns("edges").to_pylist()
        doc, at, edge = _asked(table.filter(asked))
        if len(doc):
            order = np.argsort(edge)
            begin = A.runs(edge[order])
            size = np.diff(np.append(begin, len(order)))
            doc, at = doc[order], at[order]
            source = np.repeat(np.minimum.reduceat(doc, begin), size)
            place = np.repeat(np.minimum.reduceat(np.where(doc == source, at, np.iinfo(np.int64).max), begin), size)
            later = np.flatnonzero(doc > source)
            rows += _by_document(n, doc[later], source[later], place[later] - at[later], at[later], np.ones(len(later), np.int64))
        out = pa.Table.from_pylist(rows, _FOUND_ARROW)
        del rows
        A.trim()
        return out

    return run


def _compact(window: int):
    def run(table: pa.Table) -> pa.Table:
        doc, source, shift, at, length = _unpacked(table)
        if not len(doc):
            return pa.Table.from_pylist([], _RUNS_ARROW)
        order = np.lexsort((at, doc))
        doc, source, shift, at, length = (x[order] for x in (doc, source, shift, at, length))
        # the node between two edges doesn't branch: the document goes on as its source does
        on = (np.diff(doc) == 0) & (np.diff(source) == 0) & (np.diff(shift) == 0) & (at[1:] == at[:-1] + length[:-1])
        head = np.flatnonzero(np.concatenate([[True], ~on]))
        words = np.add.reduceat(length, head) + window - 1
        return pa.table([pa.array(x) for x in (doc[head], at[head], words, source[head], at[head] + shift[head])], schema=_RUNS_ARROW)

    return run


def _digest(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int, words: int) -> bytes:
    """128 bits of the words from `first` on, joined by one space."""
    return blake2b(b" ".join(data[starts[first] : ends[first + words - 1]].tobytes().split()), digest_size=16).digest()


def _parts(rows: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices of the rows of a text column (offsets as from text_bytes) of about 4 MB, or one text."""
    lo, n = 0, len(rows) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(rows, rows[lo] + (1 << 22), side="right")) - 1)
        yield lo, hi
        lo = hi


def _proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, rows = A.text_bytes(batch.column(1))
        for lo, hi in _parts(rows):
            part = data[rows[lo] : rows[hi]]
            starts, ends, first = A.split_words(part, rows[lo : hi + 1] - rows[lo])
            out = []
            for i, (source, spans) in enumerate(zip(batch.column(0)[lo:hi].to_pylist(), batch.column(2)[lo:hi].to_pylist(), strict=True)):
                for x in spans:
                    if first[i] + x["at"] + x["words"] > first[i + 1]:
                        raise ValueError("a repeated span lies outside its source")
                    out.append({"source": source, **x, "proof": _digest(part, starts, ends, first[i] + x["at"], x["words"])})
            yield from pa.Table.from_pylist(out, _PROOFS_ARROW).to_batches()


def _proofs(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """(source, at, words, proof): what stands at each distinct place that a run names as its source.

    Only texts of sources are shuffled.  A source of very many runs has them dealt to several rows, so no row, and with
    the splitting of skewed joins no task, has to hold all of them.
    """
    spans = runs.select("source", "at", "words").distinct()
    many = spans.groupBy("source").agg(F.ceil(F.count("*") / PATHS_A_ROW).alias("parts")).filter("parts > 1")
    part = F.pmod(F.xxhash64("at", "words"), F.coalesce("parts", F.lit(1)))
    asked = spans.join(many, "source", "left").groupBy("source", part.alias("part")).agg(F.collect_list(F.struct("at", "words")).alias("spans"))
    shared, bits = _filter_of(runs.select(F.col("source").alias("id")), rows)
    texts = rows.mapInArrow(kept_rows(shared, bits, inside=True), rows.schema)
    return asked.join(texts, F.col("source") == F.col("id")).select("source", "text", "spans").mapInArrow(_proved, _PROOFS)


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, first, words, source, at): spans of `words` words, from word `first` of a document on, that stand from
    word `at` on in the document `source`, which has a smaller id; runs go on while both documents do.

    Each window that an earlier document has is in exactly one run.  The words aren't compared yet.
    """
    small_batches(docs.sparkSession)
    rows = documents_of(docs, id_col, text_col)
    n = buckets(rows)
    sent = rows.filter("text IS NOT NULL").mapInArrow(_edges(window, n, CHUNK_WORDS), _SENT)
    found = sent.groupBy("bucket").applyInArrow(_repeated(n), _FOUND)
    return found.groupBy("bucket").applyInArrow(_compact(window), _RUNS)


def repeated_paths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, paths): a document's repeated runs, each with the digest of its source's words; ids without any are left out."""
    runs = keep(repeated_runs(docs, id_col, text_col, window))
    proofs = _proofs(runs, documents_of(docs, id_col, text_col))
    met = runs.join(proofs, ["source", "at", "words"], "left")
    return met.groupBy("id").agg(F.collect_list(F.struct("first", "words", "proof")).alias("paths"))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, rows = A.text_bytes(batch.column(1))
        paths = batch.column(2) if batch.num_columns > 2 else pa.nulls(batch.num_rows, _PATHS)
        for lo, hi in _parts(rows):
            yield _cleaned(batch.column(0)[lo:hi], data[rows[lo] : rows[hi]], rows[lo : hi + 1] - rows[lo], paths[lo:hi])


def _whole(shared, bits: int):
    passing = kept_rows(shared, bits, inside=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _without(passing(batches))

    return run


def _filter_of(paths: DataFrame, rows: DataFrame) -> tuple:
    """A broadcast filter of the ids that have a path, so that only their texts are shuffled to meet the paths."""
    bits = bits_for(rows.select("id").count())
    return rows.sparkSession.sparkContext.broadcast(of_ids(paths.select("id"), bits)), bits


def _cleaned(ids: pa.Array, data: np.ndarray, rows: np.ndarray, paths: pa.Array) -> pa.RecordBatch:
    starts, ends, first = A.split_words(data, rows)
    count = np.diff(first)
    step = np.zeros(len(starts) + 1, np.int32)
    size = np.asarray(paths.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    flat = paths.flatten()
    if len(flat):
        owner = np.repeat(np.arange(len(ids)), size)
        a, k = flat.field("first").to_numpy(), flat.field("words").to_numpy()
        if (a + k > count[owner]).any():
            raise ValueError("a repeated span lies outside its document")
        for at, words, proof in zip(first[owner] + a, k, flat.field("proof").to_pylist(), strict=True):
            if _digest(data, starts, ends, at, words) != proof:
                raise ValueError("a repeated span differs from its source: two windows have equal hashes")
        np.add.at(step, first[owner] + a, 1)
        np.add.at(step, first[owner] + a + k, -1)
    stay = step.cumsum()[:-1] == 0
    row = np.repeat(np.arange(len(ids)), count)
    kept, kept_row = np.flatnonzero(stay), row[stay]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts[kept]] += 1
    edge[ends[kept]] -= 1
    inside = edge[:-1].cumsum(dtype=np.int8).astype(bool)
    inner = kept[np.flatnonzero(kept_row[1:] == kept_row[:-1]) + 1] if len(kept) else kept
    # the separator right before a kept word that isn't its document's first one
    out = data.copy()
    inside[starts[inner] - 1] = True
    out[starts[inner] - 1] = 0x20
    length = np.zeros(len(ids), np.int64)
    np.add.at(length, kept_row, ends[kept] - starts[kept])
    n_kept = np.bincount(kept_row, minlength=len(ids))
    length += np.maximum(n_kept - 1, 0)
    offsets = np.concatenate([[0], length.cumsum()]).astype(np.int32)
    text = pa.StringArray.from_buffers(len(ids), pa.py_buffer(offsets.tobytes()), pa.py_buffer(out[inside].tobytes()))
    return pa.record_batch([ids, pa.array(count, pa.int64()), pa.array(count - n_kept, pa.int64()), text], names=["id", "n_words", "n_removed", "kept"])


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept): each document with its kept words, joined by one space.

    A word goes if a window of `window` words covers it whose sequence also starts in a document with a
    smaller id; windows are judged on the input.  A null or empty text has no words.  One row for each
    id: of rows that share an id the one with the least text counts; exact repeats count once.  Rows
    without an id come out as they are, are no sources, and lose nothing.  Other columns are ignored.
    """
    paths = keep(repeated_paths(docs, id_col, text_col, window))
    rows = documents_of(docs, id_col, text_col)
    shared, bits = _filter_of(paths, rows)
    met = rows.mapInArrow(kept_rows(shared, bits, inside=True), rows.schema).join(paths, "id", "left").select("id", "text", "paths")
    own = docs.filter(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("id"), F.col(text_col).alias("text"))
    return met.mapInArrow(_without, _KEPT).unionByName(rows.mapInArrow(_whole(shared, bits), _KEPT)).unionByName(own.mapInArrow(_without, _KEPT))


def clean_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with the kept words for text where any were removed, and as it is elsewhere; rows that lose every word go.

    Columns stay; what counts as removed is as in remove_repeated.  Ids must not repeat.
    """
    paths = keep(repeated_paths(docs, id_col, text_col, window))
    rows = rows_by_id(docs, id_col)
    shared, bits = _filter_of(paths, rows)
    doubtful, sure = split(rows, shared, bits)
    met = doubtful.join(paths, "id", "left")
    changed = met.filter("paths IS NOT NULL")
    cut = changed.select("id", F.col(f"row.`{text_col}`").alias("text"), "paths").mapInArrow(_without, _KEPT).filter("n_removed < n_words").select("id", "kept")
    there = changed.select("id", "row").join(cut, "id")
    out = there.select(F.col("row").withField(f"`{text_col}`", F.col("kept")).alias("row"))
    return out.unionByName(met.filter("paths IS NULL").select("row")).unionByName(sure.select("row")).select("row.*")

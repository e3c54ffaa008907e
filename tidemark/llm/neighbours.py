"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing with exact reranking.

Vectors are turned into unit vectors whose distance falls with the inner product (one more coordinate
takes up what a vector lacks of the largest norm).  A table has PROJECTIONS Gaussian projections, each cut
into CELLS cells; a vector's bucket in a table is its cells.  So a table has at most CELLS ** PROJECTIONS
buckets, and the directory of their sizes, which is broadcast, is bounded.

A query visits buckets in the order of estimated success: the chance that a neighbour's projections fall
into a bucket's cells, given the query's own (normal, about `nearness` times these), over the bucket's
chance to hold any vector.  It stops at the chance `mass`, which is calibrated on a bounded sample of rows
(`SAMPLE`, by hash of the id) so that the sample's recall reaches `recall`.

Equal vectors are one class with its least ids, as many as any result can need.  A task gets a large bucket's part, or
small buckets that are neighbours, and the queries that visit any of them; each query is multiplied with the
rows of the buckets that it visits, and no others.  Where very many queries visit, they are split too.  The
candidates of all tables are merged and reranked in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import arrays as A
from tidemark.llm.store import keep

TABLES, PROJECTIONS, CELLS = 2, 6, 4
NEIGHBOURS = 20
RECALL = 0.95
LEAST = 256
SAMPLE, SAMPLE_QUERIES = 8192, 256
#: Rows of a part, queries that meet it together, and queries that are multiplied or probed for at a time.
GROUP_ROWS = 8192
QUERY_ROWS = 16384
BLOCK = 256


class Index(NamedTuple):
    """What every task needs: projections, cell bounds, the largest norm, the directory, and how to probe."""

    norm: float
    axes: np.ndarray  # TABLES x (dimensions + 1) x PROJECTIONS
    shifts: np.ndarray  # TABLES x PROJECTIONS
    bounds: np.ndarray  # CELLS - 1 inner bounds
    parts: np.ndarray  # of each table's bucket: parts it is split into; 0 if it is empty
    first: np.ndarray  # of each bucket: its first part
    nearness: float
    mass: float
    sizes: np.ndarray  # TABLES x buckets: classes held
    blocks: np.ndarray  # of each part: blocks of the queries that visit it


def unit(x: np.ndarray, norm: float) -> np.ndarray:
    """Vectors of at most `norm` as unit vectors of one more dimension."""
    scaled = x / norm if norm else x
    return np.concatenate([scaled, np.sqrt(np.maximum(0.0, 1 - (scaled**2).sum(axis=1)))[:, None]], axis=1)


def unit_query(q: np.ndarray) -> np.ndarray:
    return np.concatenate([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1))], axis=1)


def _tables(dimensions: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gaussian axes, for which a unit vector's projections are standard normal, their shifts, and bounds of equal cells."""
    rng = np.random.default_rng(seed)
    width = 4.0 / CELLS
    axes = rng.normal(size=(TABLES, dimensions + 1, PROJECTIONS))
    return axes, rng.uniform(-width / 4, width / 4, size=(TABLES, PROJECTIONS)), (np.arange(1, CELLS) - CELLS / 2) * width


def buckets_of(units: np.ndarray, axes: np.ndarray, shifts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The bucket in one table: floor((a . x + b) / w) of each axis a and shift b, clipped to the outer cells."""
    return np.searchsorted(bounds, units @ axes + shifts, side="right") @ CELLS ** np.arange(PROJECTIONS)


def _phi(x: np.ndarray) -> np.ndarray:
    """Distribution function of the normal distribution, to about 1e-7 (Abramowitz and Stegun 26.2.17)."""
    k = 1 / (1 + 0.2316419 * np.abs(x))
    tail = np.exp(-x * x / 2) * 0.3989422804014327 * k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
    return np.where(x >= 0, 1 - tail, tail)


def _chances(centres: np.ndarray, spread: float, bounds: np.ndarray) -> np.ndarray:
    """For each row of projections, the chance of each bucket."""
    edges = _phi((bounds - centres[:, :, None]) / spread)
    cells = np.diff(np.concatenate([np.zeros((*centres.shape, 1)), edges, np.ones((*centres.shape, 1))], axis=2), axis=2)
    out = np.ones((len(centres), 1))
    for i in range(centres.shape[1]):
        out = (cells[:, i, :, None] * out[:, None, :]).reshape(len(centres), -1)
    return out


def probes(queries: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """For each table and unit query: its buckets, most likely first, and the chances covered after each."""
    order, covered = [], []
    for axes, shifts in zip(index.axes, index.shifts, strict=True):
        chance = _chances(queries @ axes * index.nearness + shifts, np.sqrt(1 - index.nearness**2), index.bounds)
        rate = chance / _chances(shifts[None], 1.0, index.bounds)
        by = np.argsort(-rate, axis=1, kind="stable")
        order.append(by)
        covered.append(np.take_along_axis(chance, by, axis=1).cumsum(axis=1))
    return np.stack(order), np.stack(covered)


def visited(queries: np.ndarray, index: Index) -> np.ndarray:
    """TABLES x queries x buckets: whether a query visits a bucket.

    It goes on beyond the calibrated chance until it has met LEAST classes in a table, or all.
    """
    order, covered = probes(queries, index)
    before = np.concatenate([np.zeros((*covered.shape[:2], 1)), covered[:, :, :-1]], axis=2)
    held = np.take_along_axis(np.broadcast_to(index.sizes[:, None, :], order.shape), order, axis=2)
    out = np.zeros(order.shape, bool)
    np.put_along_axis(out, order, (before < index.mass) | (held.cumsum(axis=2) - held < LEAST), axis=2)
    return out


def calibrate(sample: np.ndarray, norm: float, seed: int, neighbours: int, recall: float) -> tuple[float, float]:
    """(nearness, mass) by which the first rows of a sample find their neighbours in it."""
    if len(sample) < 2:
        return 0.5, 1.0
    queries = sample[: min(SAMPLE_QUERIES, len(sample))]
    scores = queries @ sample.T
    np.fill_diagonal(scores, -np.inf)
    k = min(neighbours, len(sample) - 1)
    nearest = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    units, asked = unit(sample, norm), unit_query(queries)
    cosines = (asked[:, None, :] * units[nearest]).sum(axis=2)
    axes, shifts, bounds = _tables(sample.shape[1], seed)
    nearness = float(np.clip(np.median(cosines), 0.05, 0.98))
    index = Index(norm, axes, shifts, bounds, np.empty(0), np.empty(0), nearness, 1.0, np.empty(0), np.empty(0))
    order, covered = probes(asked, index)
    needed = np.full(nearest.shape, np.inf)
    for t in range(TABLES):
        at = np.empty_like(order[t])
        np.put_along_axis(at, order[t], np.broadcast_to(np.arange(order.shape[2]), order[t].shape), axis=1)
        place = np.take_along_axis(at, buckets_of(units, axes[t], shifts[t], bounds)[nearest], axis=1)
        before = np.concatenate([np.zeros((len(asked), 1)), covered[t][:, :-1]], axis=1)
        needed = np.minimum(needed, np.take_along_axis(before, place, axis=1))
    return nearness, float(np.quantile(needed, recall)) + 1e-9


# --- jobs --------------------------------------------------------------------------------------------------------


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors with an id that hold numbers only, at least one of them not zero."""
    v = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.filter(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double") + F.lit(0.0)).alias("v"))


def _bucket_counts(norm: float, axes: np.ndarray, shifts: np.ndarray, bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = CELLS**PROJECTIONS
        sums = np.zeros(TABLES * n, np.int64)
        for batch in batches:
            if batch.num_rows:
                units = unit(_matrix(batch.column(0)), norm)
                for t in range(TABLES):
                    sums[t * n : (t + 1) * n] += np.bincount(buckets_of(units, axes[t], shifts[t], bounds), minlength=n)
        at = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(sums[at])], names=["at", "n"])

    return run


_POSTED = "part long, bucket int, ids array<long>, v array<double>"
_ASKED = "part long, query long, v array<double>, visits array<int>"


def directory(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each bucket, its first part and how many it has.  Buckets in a row share a part while they fit."""
    split = np.where(size > GROUP_ROWS, -(-size // GROUP_ROWS), np.minimum(size, 1))
    small = np.where(size <= GROUP_ROWS, size, 0)
    shared = (small.cumsum() - small) // GROUP_ROWS
    own = np.where(split > 1, split, 0)
    return np.where(split > 1, int(shared.max(initial=0)) + 1 + own.cumsum() - own, shared), split


def _parts(index: Index, bucket: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return index.first[bucket] + salt % np.maximum(index.parts[bucket], 1)


#: A part's number stands above that of a block of queries.
_BLOCKS = 24


def _posted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, n = shared.value, CELLS**PROJECTIONS
        for batch in batches:
            if not batch.num_rows:
                continue
            units = unit(_matrix(batch.column(1)), index.norm)
            salt = batch.column(2).to_numpy()
            for t in range(TABLES):
                bucket = t * n + buckets_of(units, index.axes[t], index.shifts[t], index.bounds)
                part = _parts(index, bucket, salt)
                times = index.blocks[part]
                row = np.repeat(np.arange(len(part)), times)
                block = np.arange(len(row)) - np.repeat(times.cumsum() - times, times)
                for lo in range(0, len(row), 1000):
                    i = row[lo : lo + 1000]
                    yield pa.record_batch([pa.array(part[i] << _BLOCKS | block[lo : lo + 1000], pa.int64()), pa.array(bucket[i], pa.int32()), batch.column(0).take(pa.array(i)), batch.column(1).take(pa.array(i))], names=["part", "bucket", "ids", "v"])

    return run


def _visits(index: Index, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, part, bucket) of all that the queries visit, by query and part."""
    n = CELLS**PROJECTIONS
    query, bucket = np.nonzero(visited(unit_query(vectors), index).transpose(1, 0, 2).reshape(len(vectors), TABLES * n) & (index.parts > 0))
    times = index.parts[bucket]
    query, bucket = np.repeat(query, times), np.repeat(bucket, times)
    part = _parts(index, bucket, np.arange(len(bucket)) - np.repeat(times.cumsum() - times, times))
    order = np.lexsort((bucket, part, query))
    return query[order], part[order], bucket[order]


def _heads(query: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Where a query's visits to another part begin."""
    return np.flatnonzero(np.concatenate([[True], (query[1:] != query[:-1]) | (part[1:] != part[:-1])])) if len(query) else np.empty(0, np.int64)


def _visitors(shared):
    """How many queries visit each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        sums = np.zeros(len(index.blocks), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                query, part, _ = _visits(index, _matrix(batch.column(1)[lo : lo + BLOCK]))
                sums += np.bincount(part[_heads(query, part)], minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(sums[at])], names=["at", "n"])

    return run


def _asked(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                ids, vectors = batch.column(0)[lo : lo + BLOCK], batch.column(1)[lo : lo + BLOCK]
                query, part, bucket = _visits(index, _matrix(vectors))
                first = _heads(query, part)
                visits = pa.ListArray.from_arrays(pa.array(np.append(first, len(query)), pa.int32()), pa.array(bucket, pa.int32()))
                query, part = query[first], part[first]
                block = A.bucket_of(A.mix(ids.to_numpy().astype(np.int64).view(np.uint64)), 1 << _BLOCKS)[query] % index.blocks[part]
                for at in range(0, len(query), 1000):
                    i = pa.array(query[at : at + 1000])
                    yield pa.record_batch([pa.array(part[at : at + 1000] << _BLOCKS | block[at : at + 1000], pa.int64()), ids.take(i), vectors.take(i), visits[at : at + 1000]], names=["part", "query", "v", "visits"])

    return run


_FOUND = "query long, ids array<long>, scores array<double>"
_FOUND_ARROW = pa.schema([("query", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])


def _best(queries: pa.Table, rows: pa.Table, neighbours: int) -> pa.Table:
    """For each query of a part, its nearest among the classes in the buckets that it visits there."""
    if not queries.num_rows or not rows.num_rows:
        return pa.Table.from_pylist([], _FOUND_ARROW)
    bucket = rows["bucket"].to_numpy()
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows.take(pa.array(order)), bucket[order]
    base, ids = _matrix(rows["v"]), rows["ids"].combine_chunks()
    asked, visits, names = _matrix(queries["v"]), queries["visits"].combine_chunks(), queries["query"].to_numpy()
    met, owner = visits.flatten().to_numpy(), np.repeat(np.arange(len(asked)), visits.value_lengths().to_numpy())
    begins = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    held, ends = bucket[begins], np.append(begins[1:], len(bucket))
    place = np.minimum(np.searchsorted(held, met), len(held) - 1)
    there = held[place] == met
    place, owner = place[there], owner[there]
    # beyond what rounding can do to either way of adding up
    slack = 1e-12 * np.linalg.norm(asked, axis=1) * np.sqrt((base**2).sum(axis=1).max())
    # a class stands here once for each table, and each but the query's own has an id to offer
    most = TABLES * (neighbours + 1)
    found = []
    for at in range(0, len(asked), BLOCK):
        lo, hi = np.searchsorted(owner, [at, at + BLOCK])
        order = np.argsort(place[lo:hi], kind="stable")
        who, here = owner[lo:hi][order] - at, place[lo:hi][order]
        first = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]])) if len(here) else np.empty(0, np.int64)
        block = asked[at : at + BLOCK]
        scores = np.full((len(block), len(base)), -np.inf)
        for i, j, k in zip(first.tolist(), np.append(first[1:], len(here)).tolist(), here[first].tolist(), strict=True):
            scores[who[i:j], begins[k] : ends[k]] = block[who[i:j]] @ base[begins[k] : ends[k]].T
        least = np.full(len(block), -np.inf)
        if len(base) > most:
            least = np.partition(scores, len(base) - most, axis=1)[:, len(base) - most]
        q, c = np.nonzero((scores >= (least - slack[at : at + BLOCK])[:, None]) & (scores > -np.inf))
        found.append((q + at, c))
    if not found:
        return pa.Table.from_pylist([], _FOUND_ARROW)
    query, row = (np.concatenate([f[i] for f in found]) for i in range(2))
    exact = np.concatenate([(asked[query[k : k + 65536]] * base[row[k : k + 65536]]).sum(axis=1) for k in range(0, len(query), 65536)]) if len(query) else np.empty(0)
    least_id = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]
    order = np.lexsort((least_id[row], -exact, query))
    query, row, exact = query[order], row[order], exact[order]
    first = np.searchsorted(query, np.arange(len(asked) + 1))
    out = []
    for i in np.flatnonzero(np.diff(first)):
        lo, hi = first[i], first[i + 1]
        some = range(lo, min(hi, lo + most))
        pairs = sorted({(-exact[k], x) for k in some for x in ids[int(row[k])].as_py() if x != names[i]})[:neighbours]
        out.append((int(names[i]), [x for _, x in pairs], [float(-v) for v, _ in pairs]))
    return pa.table([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True) if out else ([], [], []), _FOUND_ARROW, strict=True)], schema=_FOUND_ARROW)


def search(rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", neighbours: int = NEIGHBOURS, recall: float = RECALL, seed: int = 20) -> DataFrame:
    """(query, rank, id, score): the nearest rows found for each query, by inner product, ties by smaller id.

    queries has the columns of rows; a row whose id is the query's is no neighbour.  Vectors that are null,
    zero, or hold null or non-finite components take no part, nor do rows without an id; all others must
    be of one length.  Of fewer candidates than neighbours, all are candidates.  Repeated rows (id and
    vector) count once, as do repeated queries.  Extra columns are ignored.
    """
    spark = rows.sparkSession
    valid = _valid(rows, id_col, vector_col).distinct()
    by_id = Window.partitionBy("v").orderBy("id")
    least = valid.withColumn("rank", F.row_number().over(by_id)).filter(F.col("rank") <= neighbours + 1)
    classes = keep(least.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("salt", F.expr("ids[0] & 9223372036854775807")))
    facts = classes.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("norm"), F.max(F.size("v")).alias("most"), F.min(F.size("v")).alias("least")).first()
    none = "query long, rank int, id long, score double"
    if not facts.n:
        return spark.createDataFrame([], none)
    if facts.most != facts.least:
        raise ValueError("all vectors must be of one length")
    hashed = F.pmod(F.xxhash64("salt", F.lit(seed)), F.lit(1 << 20))
    sample = classes.filter(hashed < int(min(1.0, SAMPLE / facts.n) * (1 << 20)) + 1).select("v", hashed.alias("h"), "salt").orderBy("h", "salt").limit(2 * SAMPLE).toArrow()
    nearness, mass = calibrate(_matrix(sample["v"]), facts.norm, seed, neighbours, recall)
    axes, shifts, bounds = _tables(facts.most, seed)
    counts = classes.select("v").mapInArrow(_bucket_counts(facts.norm, axes, shifts, bounds), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    size = np.zeros(TABLES * CELLS**PROJECTIONS, np.int64)
    size[counts["at"].to_numpy()] = counts["n"].to_numpy()
    first, split = directory(size)
    index = Index(facts.norm, axes, shifts, bounds, split, first, nearness, mass, size.reshape(TABLES, -1), np.ones(int((first + split).max()) + 1, np.int64))
    asking = _valid(queries, id_col, vector_col).distinct()
    asking = keep(asking)
    # queries are few and each is probed for with thousands of buckets: spread them
    asking = asking.repartition(max(1, min(asking.count() // BLOCK, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))), "id")
    visitors = asking.mapInArrow(_visitors(spark.sparkContext.broadcast(index)), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    index.blocks[visitors["at"].to_numpy()] = -(-visitors["n"].to_numpy() // QUERY_ROWS)
    shared = spark.sparkContext.broadcast(index)
    posted = classes.select("ids", "v", "salt").mapInArrow(_posted(shared), _POSTED)
    asked = asking.mapInArrow(_asked(shared), _ASKED)

    def best(key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
        return _best(queries, rows, neighbours)

    found = asked.groupBy("part").cogroup(posted.groupBy("part")).applyInArrow(best, _FOUND)
    # a query meets a candidate once in each table: keep one, then the nearest
    each = found.select("query", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query", F.col("x.ids").alias("id"), F.col("x.scores").alias("score"))
    once = each.groupBy("query", "id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")))
    return ranked.filter(F.col("rank") <= neighbours).select("query", "rank", "id", "score")

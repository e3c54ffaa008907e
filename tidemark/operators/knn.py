"""Exact k nearest neighbours in blocks: every row against each bounded block of the training rows, and the nearest of all blocks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 27
#: Bytes of a block of training vectors at most; one at a time is collected and broadcast.
MOST_BYTES = 64 << 20
#: Rows that are compared with a block at a time: their distances take BLOCK doubles for each training row.
BLOCK = 32

_NEAR = "array<struct<d: double, id: bigint, y: double>>"
_NEAR_ARROW = pa.list_(pa.struct([("d", pa.float64()), ("id", pa.int64()), ("y", pa.float64())]))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _nearest(x: np.ndarray, key: int, rough: np.ndarray, slack: np.ndarray, ids: np.ndarray, base: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and squared distances of the k nearest.  rough differs from the distance by less than slack, which only saves work."""
    rough[ids == key] = np.inf
    some = np.arange(len(ids))
    if len(ids) > k and not np.isnan(rough).any():
        far = np.partition(rough + slack, k - 1)[k - 1]
        some = np.flatnonzero(rough - slack <= far)
    some = some[ids[some] != key]
    d = ((base[some] - x) ** 2).sum(axis=1)
    some, d = some[np.isfinite(d)], d[np.isfinite(d)]
    first = np.lexsort((ids[some], d))[:k]
    return some[first], d[first]


def _near(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, base, y = shared.value
        norms = (base**2).sum(axis=1)
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                own = batch.slice(lo, BLOCK)
                near = [[]] * own.num_rows
                if len(ids):
                    x = _matrix(own.column(2))
                    with np.errstate(all="ignore"):
                        both = (x**2).sum(axis=1)[:, None] + norms
                        rough = both - 2 * (x @ base.T)
                        # far beyond what rounding can do to either way of adding up
                        slack = both * (8 * (base.shape[1] + 4) * np.finfo(float).eps)
                        found = [_nearest(row, key, r, s, ids, base, k) for key, row, r, s in zip(own.column(0).to_pylist(), x, rough, slack, strict=True)]
                    near = [[{"d": float(v), "id": int(ids[i]), "y": float(y[i])} for i, v in zip(at, d, strict=True)] for at, d in found]
                yield pa.record_batch([own.column(0), own.column(1), pa.array(near, _NEAR_ARROW)], names=["id", "nth", "near"])

    return run


def rates(test: DataFrame, train: DataFrame, id_col: str, vector_col: str, y_col: str, k: int = K) -> DataFrame:
    """(id, p): mean y of the k nearest training rows by Euclidean distance, ties by smaller id; a row isn't its own neighbour.

    All training rows count; they are cut by id hash into blocks of about MOST_BYTES, and a row's nearest of each block are merged.
    """
    spark = test.sparkSession
    known = train.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(y_col).cast("double").alias("y")).na.drop()
    size = known.agg(F.sum(8 * F.size("v"))).first()[0] or 0
    n = -(-size // MOST_BYTES) or 1
    rows = test.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).na.drop()
    # rows that share an id are told apart by their place among them
    nth = F.row_number().over(Window.partitionBy("id").orderBy("v")) if n > 1 else F.lit(1)
    rows = rows.select("id", nth.alias("nth"), "v")
    parts = []
    for block in range(n):
        got = known.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == block).orderBy("id").toArrow().combine_chunks()
        base = _matrix(got["v"].combine_chunks()) if got.num_rows else np.empty((0, 1))
        shared = spark.sparkContext.broadcast((got["id"].to_numpy(), base, got["y"].to_numpy()))
        parts.append(rows.mapInArrow(_near(shared, k), f"id long, nth int, near {_NEAR}"))
    near = parts[0]
    if n > 1:
        merged = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)
        near = reduce(DataFrame.unionAll, parts).groupBy("id", "nth").agg(merged.alias("near"))
    mean = F.aggregate("near", F.lit(0.0), lambda s, x: s + x["y"]) / F.size("near")
    return near.select("id", F.when(F.size("near") > 0, mean).alias("p"))

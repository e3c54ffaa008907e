"""Filters of bits for broadcasting: a member always passes, others pass rarely.

A filter has a fixed number of bits at most, whatever the table's size; one that fills up passes more.  It
may only save work, so results never depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import arrays as A

#: Bits of a filter of ids: eight for each row of the table, up to 32 MB.
MOST_BITS = 28


def bits_for(rows: int) -> int:
    return min(MOST_BITS, max(16, (8 * rows).bit_length()))


def bitmap(positions: DataFrame, bits: int) -> np.ndarray:
    """A filter of 2 ** bits bits from a column `at` of positions; what reaches the driver is at most the filter."""
    words = positions.select(F.shiftright("at", 5).cast("int").alias("w"), F.expr("shiftleft(1L, cast(at % 32 as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(1 << (bits - 5), np.uint32)
    found = words.toArrow()
    out[found["w"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    return out


def holds(filter_bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (filter_bits[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)


def position(ids: np.ndarray, bits: int) -> np.ndarray:
    """Where an id's bit stands."""
    return (A.mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _positions(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(np.unique(position(batch.column(0).to_numpy(zero_copy_only=False), bits)))], names=["at"])

    return run


def of_ids(ids: DataFrame, bits: int) -> np.ndarray:
    """The filter of a table of one column of ids without nulls."""
    return bitmap(ids.mapInArrow(_positions(bits), "at long"), bits)


def kept_rows(shared, bits: int, inside: bool):
    """For mapInArrow: the rows whose id, the first column, passes the filter, or those whose id doesn't (or is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0)
            passes = holds(shared.value, position(np.asarray(own.fill_null(0)), bits)) & ~np.asarray(own.is_null())
            yield batch.filter(pa.array(passes == inside))

    return run


def split(df: DataFrame, shared, bits: int) -> tuple[DataFrame, DataFrame]:
    """The rows of df, whose first column is an id, that pass the filter, and the others."""
    return df.mapInArrow(kept_rows(shared, bits, True), df.schema), df.mapInArrow(kept_rows(shared, bits, False), df.schema)


def rows_by_id(df: DataFrame, id_col: str) -> DataFrame:
    """(id, row): each row as a struct beside its id, whatever its columns are called."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))


def without_ids(df: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """The rows of df whose id isn't among those of gone (id).  Only rows that may go are shuffled."""
    gone = gone.select("id").distinct()
    bits = bits_for(df.select(id_col).count())
    shared = df.sparkSession.sparkContext.broadcast(of_ids(gone, bits))
    doubtful, sure = split(rows_by_id(df, id_col), shared, bits)
    return sure.unionByName(doubtful.join(gone, "id", "left_anti")).select("row.*")

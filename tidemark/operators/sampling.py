"""Samples and splits that come out the same on every run, from a hash of the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A prime near 2**31, and the multiplier of the key's hash.
PRIME, FACTOR = 2_147_483_647, 48_271


def key_hash(key: Column, seed: int = 0) -> Column:
    """A number from 0 to PRIME - 1 by plain integer arithmetic, so that any SQL engine gives the same."""
    return ((key.cast("long") % PRIME + seed * 7919 + 1) * FACTOR) % PRIME


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows (all, if there are fewer), those of the least hashes."""
    return df.withColumn("_h", key_hash(F.col(key), seed)).orderBy("_h", key).limit(n).drop("_h")


def stratified_split(df: DataFrame, key: str, y: str, share: float = 0.7, seed: int = 42) -> DataFrame:
    """df with is_train: of each class the rows of the least hashes, `share` of them.

    Ranks are counted in ranges of the hash, so no task holds a whole class.
    """
    ranges = 256
    h = df.withColumn("_h", key_hash(F.col(key), seed)).withColumn("_r", F.floor(F.col("_h") / ((PRIME + ranges) // ranges)).cast("int"))
    n = h.groupBy(y, "_r").agg(F.count("*").alias("_n"))
    starts = n.withColumn("_s", F.coalesce(F.sum("_n").over(Window.partitionBy(y).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = n.groupBy(y).agg(F.sum("_n").alias("_total"))
    starts = starts.join(total, y).select(y, "_r", "_s", "_total")
    rank = F.col("_s") + F.row_number().over(Window.partitionBy(y, "_r").orderBy("_h", key))
    return h.join(F.broadcast(starts), [y, "_r"]).withColumn("is_train", (rank <= F.floor(F.col("_total") * share)).cast("int")).drop("_h", "_r", "_s", "_total")


def oversample(df: DataFrame, key: str, y: str) -> DataFrame:
    """Positives repeated until they are as many as the negatives: copies by hash, the odd ones first."""
    n = df.agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(y) == 0, 1).otherwise(0)).alias("n")).first()
    p, q = int(n.p or 0), int(n.n or 0)
    if not p or q <= p:
        return df
    times, rest = divmod(q, p)
    extra = sample(df.filter(F.col(y) == 1), key, rest, 1).select(key).withColumn("_extra", F.lit(1))
    copies = F.when(F.col(y) == 1, times + F.coalesce("_extra", F.lit(0))).otherwise(1)
    return df.join(extra, key, "left").withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy", "_extra")

"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import keep


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Hang neighbours on the least one: small, those below a node (and the node); large, those above it.

    The least neighbour of a node is a plain minimum, so it is found before anything is shuffled by node.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if small:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if small:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each id in the edges (a, b): the least id that can be reached.  Loops say nothing."""
    now = keep(edges.select("a", "b").filter("a <> b").distinct())
    seen = _state(now)
    while True:
        now = keep(_star(_star(now, small=False), small=True))
        before, seen = seen, _state(now)
        if seen == before:
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Equal for equal edge tables; a round that leaves the edges as they are is the last."""
    one, other = F.xxhash64("a", "b"), F.xxhash64("b", "a", F.lit(1))
    return tuple(edges.agg(F.count("*"), F.bit_xor(one), F.bit_xor(other)).first())

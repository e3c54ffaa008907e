"""Population stability of features against a reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMERIC = ("auto_renew", "amount_paid", "discount", "plan_days", "n_lapses", "days_active_m1", "secs_m1", "completion_ratio", "age")
CATEGORY = "payment_method"
UNKNOWN, FLOOR, WARN = -1.0, 1e-4, 0.20
DECILES = [i / 10 for i in range(11)]


def _values(features: DataFrame, names: tuple[str, ...] = NUMERIC) -> DataFrame:
    return features.select(F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.coalesce(F.col(f).cast("double"), F.lit(UNKNOWN)).alias("x")) for f in names))))


def edges(reference: DataFrame) -> DataFrame:
    """(feature, edges): the distinct deciles without the outer two; a nearly constant feature keeps none."""
    q = _values(reference).groupBy("feature").agg(F.percentile("x", F.array(*(F.lit(d) for d in DECILES))).alias("q"))
    d = q.select("feature", F.array_sort(F.array_distinct(F.transform("q", lambda e: F.round(e, 9)))).alias("d"))
    return d.select("feature", F.when(F.size("d") > 2, F.slice("d", 2, F.size("d") - 2)).otherwise(F.array().cast("array<double>")).alias("edges"))


def shares(features: DataFrame, cut: DataFrame) -> DataFrame:
    """(feature, bin, share) of the bins [edge, next edge); empty bins are there too."""
    bins = cut.select("feature", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"))
    own = _values(features).join(F.broadcast(cut), "feature").select("feature", F.size(F.filter("edges", lambda e: e <= F.col("x"))).alias("bin"))
    n = own.groupBy("feature", "bin").count()
    total = n.groupBy("feature").agg(F.sum("count").alias("total"))
    return bins.join(n, ["feature", "bin"], "left").join(total, "feature", "left").select("feature", "bin", F.coalesce(F.col("count") / F.col("total"), F.lit(0.0)).alias("share"))


def category_shares(features: DataFrame, name: str = CATEGORY) -> DataFrame:
    n = features.groupBy(F.col(name).cast("string").alias("bin")).count()
    total = n.agg(F.sum("count").alias("total"))
    return n.join(F.broadcast(total)).select(F.lit(name).alias("feature"), "bin", (F.col("count") / F.col("total")).alias("share"))


def psi(reference: DataFrame, current: DataFrame) -> DataFrame:
    """(feature, psi) from shares by bin; a bin that one side lacks counts as FLOOR there."""
    side = lambda df, name: df.select("feature", "bin", F.col("share").alias(name))
    both = side(reference, "r").join(side(current, "c"), ["feature", "bin"], "full_outer")
    r, c = (F.greatest(F.coalesce(F.col(x), F.lit(0.0)), F.lit(FLOOR)) for x in ("r", "c"))
    return both.groupBy("feature").agg(F.round(F.sum((c - r) * F.log(c / r)), 4).alias("psi"))


def report(reference: DataFrame, current: DataFrame) -> DataFrame:
    """(feature, psi, warning) of all drift features."""
    cut = edges(reference)
    numeric = psi(shares(reference, cut), shares(current, cut))
    return numeric.unionByName(psi(category_shares(reference), category_shares(current))).withColumn("warning", F.col("psi") >= WARN)

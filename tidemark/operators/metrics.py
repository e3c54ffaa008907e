"""Exact ranking, probability and threshold metrics by group.

Ranks come from distinct scores: rows of equal score are summed first, then running sums go over the
distinct scores.  So that no task has to hold them all, scores are cut into ranges (by approximate
quantiles of each group, which only balance the work): sums run inside a range, and a range's start is the
sum of those before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64
CLIP = 1e-6


def running(df: DataFrame, group: list[str], order: str, sums: list[str]) -> DataFrame:
    """df, of one row for each group and value of `order`, with sums of all rows below: before_<column>."""
    at = [i / RANGES for i in range(1, RANGES)]
    bounds = df.groupBy(*group).agg(F.percentile_approx(order, at, 1000).alias("_bounds"))
    ranged = df.join(bounds, group).withColumn("_range", F.size(F.filter("_bounds", lambda b: b < F.col(order)))).drop("_bounds")
    totals = ranged.groupBy(*group, "_range").agg(*(F.sum(c).alias(f"_t_{c}") for c in sums))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*group, "_range", *(F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_s_{c}") for c in sums))
    inside = Window.partitionBy(*group, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(starts, [*group, "_range"]).withColumns({f"before_{c}": F.col(f"_s_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    return out.drop("_range", *(f"_s_{c}" for c in sums))


def _distinct(df: DataFrame, group: list[str], y: str, score: str) -> DataFrame:
    return df.groupBy(*group, F.col(score).cast("double").alias("_x")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))


def ranking(df: DataFrame, group: list[str], y: str = "is_churn", score: str = "p") -> DataFrame:
    """Group columns, auc (ties count half) and ap (step-wise average precision); null where a class is missing."""
    scores = _distinct(df, group, y, score)
    # class sizes come from the distinct scores too, so df is read once
    n = scores.groupBy(*group).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    d = running(scores, group, "_x", ["pos", "neg"]).join(n, group)
    # at a threshold, all rows of its score or more are taken
    taken_pos, taken_neg = F.col("P") - F.col("before_pos"), F.col("N") - F.col("before_neg")
    g = d.groupBy(*group, "P", "N").agg(
        F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)).alias("wins"), F.sum(F.col("pos") * taken_pos / (taken_pos + taken_neg)).alias("steps")
    )
    both = (F.col("P") > 0) & (F.col("N") > 0)
    return g.select(*group, F.when(both, F.col("wins") / (F.col("P") * F.col("N"))).alias("auc"), F.when(both, F.col("steps") / F.col("P")).alias("ap"))


def probability(df: DataFrame, group: list[str], y: str = "is_churn", score: str = "p") -> DataFrame:
    """n, churn_rate, log_loss and brier; the last two are null where a class is missing, p is clipped for them."""
    p = F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), F.col(score)))
    both = (F.max(y) == 1) & (F.min(y) == 0)
    loss = -F.avg(F.when(F.col(y) == 1, F.log(p)).otherwise(F.log(1 - p)))
    return df.groupBy(*group).agg(F.count("*").alias("n"), F.avg(y).alias("churn_rate"), F.when(both, loss).alias("log_loss"), F.when(both, F.avg(F.pow(p - F.col(y), 2))).alias("brier"))


def hard(df: DataFrame, group: list[str], y: str = "is_churn", score: str = "p", threshold: float = 0.5) -> DataFrame:
    """accuracy, f1, precision and recall at a threshold; 0 where nothing is there to divide by."""
    yes, is_y = F.col(score) >= threshold, F.col(y) == 1
    g = df.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(yes & is_y).alias("tp"), F.count_if(yes & ~is_y).alias("fp"), F.count_if(~yes & is_y).alias("fn"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.select(*group, ((F.col("n") - fp - fn) / F.col("n")).alias("accuracy"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"))


def scores(df: DataFrame, group: list[str], y: str = "is_churn", score: str = "p") -> DataFrame:
    return probability(df, group, y, score).join(ranking(df, group, y, score), group)


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(1), c))

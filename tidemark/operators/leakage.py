"""How much a feature changes, and how much signal it loses, once it is built from the past alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.metrics import ranking

RELATIVE, ABSOLUTE = 1e-5, 1e-8
CHANGED, LOST = 0.005, 0.02
KEYS = ["msno", "cutoff"]


def is_close(a: Column, b: Column) -> Column:
    """Close relative to b (so not symmetric); two nulls are close, a null and a number aren't."""
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= ABSOLUTE + RELATIVE * F.abs(b))


def long_form(published: DataFrame, honest: DataFrame, features: list[str]) -> DataFrame:
    """(msno, cutoff, feature, a, b): each feature as published and as known."""
    p = published.select(*KEYS, *(F.col(f).alias(f"p_{f}") for f in features))
    h = honest.select(*KEYS, *(F.col(f).alias(f"h_{f}") for f in features))
    rows = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"p_{f}").alias("a"), F.col(f"h_{f}").alias("b")) for f in features))
    return p.join(h, KEYS).select(*KEYS, F.inline(rows))


def changed_share(pairs: DataFrame) -> DataFrame:
    """Share of users whose value isn't close, and whose value isn't equal."""
    strict = ~F.col("a").eqNullSafe(F.col("b"))
    return pairs.groupBy("feature").agg(F.avg((~is_close(F.col("a"), F.col("b"))).cast("double")).alias("changed_share"), F.avg(strict.cast("double")).alias("changed_strict"))


def signal(values: DataFrame, group: list[str], x: str = "x", y: str = "is_churn") -> DataFrame:
    """How well one feature alone tells classes apart: max(auc, 1 - auc) with nulls at the median; 0.5 if it has under two values."""
    middle = values.groupBy(*group).agg(F.median(x).alias("_mid"), F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    filled = values.join(middle, group).select(*group, y, F.coalesce(F.col(x), F.col("_mid")).alias("_v"))
    # a feature without any value has no rank
    auc = ranking(filled.filter("_v IS NOT NULL"), group, y, "_v").select(*group, "auc")
    constant = F.coalesce(F.col("_lo") == F.col("_hi"), F.lit(True))
    return middle.join(auc, group, "left").select(*group, F.when(constant, 0.5).otherwise(F.greatest("auc", 1 - F.col("auc"))).alias("signal"))


def leak_table(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(feature, changed_share, changed_strict, signal_published, signal_honest, leaked), largest loss first."""
    rows = pairs.join(labels.select(*KEYS, "is_churn"), KEYS)
    both = rows.select("feature", "is_churn", F.inline(F.array(F.struct(F.lit("published").alias("kind"), F.col("a").alias("x")), F.struct(F.lit("honest").alias("kind"), F.col("b").alias("x")))))
    s = signal(both, ["feature", "kind"]).groupBy("feature").pivot("kind", ["published", "honest"]).agg(F.first("signal"))
    out = changed_share(pairs).join(s, "feature").select("feature", "changed_share", "changed_strict", F.round("published", 4).alias("signal_published"), F.round("honest", 4).alias("signal_honest"), (F.col("changed_share") > CHANGED).alias("leaked"))
    return out.orderBy(F.desc(F.col("signal_published") - F.col("signal_honest")), "feature")


def headline(leaks: DataFrame, n: int = 3) -> DataFrame:
    """The n features that lose most signal, over LOST each."""
    lost = F.col("signal_published") - F.col("signal_honest")
    return leaks.filter(F.col("leaked") & (lost > LOST)).orderBy(F.desc(lost), "feature").limit(n).select("feature", "signal_published", "signal_honest")

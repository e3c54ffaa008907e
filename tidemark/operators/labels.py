"""Who is scored on a cut-off, and who turned out to leave."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators.asof import AsOf
from tidemark.sources.tables import Dataset


def population(ds: Dataset, cutoffs: list[date]) -> DataFrame:
    """(msno, cutoff, expire_date): latest known membership runs out within the month after the cut-off."""
    last = AsOf(ds, tuple(cutoffs)).last_tx()
    ends = F.col("membership_expire_date")
    return last.filter((ends > F.col("cutoff")) & (ends <= cal.shift_months(F.col("cutoff"), 1))).select("msno", "cutoff", ends.alias("expire_date"))


def churn_labels(ds: Dataset, scored: DataFrame) -> DataFrame:
    """scored with is_churn: 1 unless a transaction that is no cancel renews within the grace days.

    A renewal is dated after the cut-off, at most GRACE_DAYS after the expiry, and expires later.
    """
    t = ds.tx.select(F.col("msno").alias("_user"), F.col("transaction_date").alias("_date"), F.col("membership_expire_date").alias("_expire"), "is_cancel").filter("is_cancel = 0").drop("is_cancel")
    s = scored.select("msno", "cutoff", "expire_date")
    renews = (F.col("_user") == F.col("msno")) & (F.col("_date") > F.col("cutoff")) & (F.col("_date") <= F.date_add("expire_date", cal.GRACE_DAYS)) & (F.col("_expire") > F.col("expire_date"))
    kept = s.join(t, renews, "left_semi").withColumn("_kept", F.lit(1))
    return scored.join(kept, ["msno", "cutoff", "expire_date"], "left").withColumn("is_churn", F.when(F.col("_kept").isNull(), 1).otherwise(0)).drop("_kept")


def churn_rate(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("cutoff").agg(F.count("*").alias("n"), F.avg("is_churn").alias("churn_rate"))

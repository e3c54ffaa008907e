"""The 31 honest features of every scored user, for many cut-offs in one job."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators.asof import ORDER, dealt, people_of
from tidemark.operators.clean import LOG_SUMS, valid_age
from tidemark.operators.labels import churn_labels, population
from tidemark.sources.tables import Dataset

LAST = ("plan_days", "list_price", "amount_paid", "discount", "auto_renew", "cancel_last", "days_to_expire", "days_since_last_tx", "payment_method")
HISTORY = ("n_tx", "n_tx_180d", "n_cancel", "n_cancel_365d", "tenure_days", "auto_renew_share", "n_plans", "avg_paid")
LAPSES = ("n_lapses",)
PROFILE = ("age", "reg_days", "city", "registered_via", "gender")
LISTENING = ("days_active_m1", "secs_m1", "unique_songs_m1", "days_active_m3", "secs_m3", "activity_trend", "completion_ratio", "months_since_active")
CATEGORICAL = ("payment_method", "city", "registered_via", "gender")
FEATURES = tuple(f for f in (*LAST, *HISTORY, *LAPSES, *PROFILE, *LISTENING) if f not in CATEGORICAL) + CATEGORICAL
NUMERIC = tuple(f for f in FEATURES if f not in CATEGORICAL)
#: Part of the path of cached feature tables: raise it when a definition changes.
VERSION = 1
NEVER_ACTIVE = 99
KEYS = ["msno", "cutoff"]


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("missing"))


def _tx_features(tx: DataFrame) -> DataFrame:
    """Last-transaction, history and lapse features: one window by user, then one grouping that reuses its shuffle."""
    paid = F.when(F.col("is_cancel") == 0, F.col("membership_expire_date"))
    before = Window.partitionBy("msno").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    # the expiry of the last payment before this one: the same at every cut-off that sees this row
    gap = F.datediff("transaction_date", F.last(paid, ignorenulls=True).over(before))
    history = tx.withColumn("lapsed", F.coalesce((F.col("is_cancel") == 0) & (gap > cal.GRACE_DAYS), F.lit(False)).cast("int"))
    t = dealt(history, lambda c: c >= F.col("transaction_date"))
    day, c = F.col("transaction_date"), F.col("cutoff")
    last = F.struct(*ORDER, "payment_plan_days", "plan_list_price", "actual_amount_paid", "is_auto_renew", "is_cancel", "payment_method_id")
    g = t.groupBy("msno", "cutoff").agg(
        F.max(last).alias("l"), F.count("*").alias("n_tx"), F.count_if(day > F.date_sub(c, 180)).alias("n_tx_180d"), F.sum("is_cancel").alias("n_cancel"),
        F.sum(F.when(day > F.date_sub(c, 365), F.col("is_cancel")).otherwise(0)).alias("n_cancel_365d"), F.min(day).alias("first"), F.avg("is_auto_renew").alias("auto_renew_share"),
        F.count_distinct("payment_plan_days").alias("n_plans"), F.avg("actual_amount_paid").alias("avg_paid"), F.sum("lapsed").alias("n_lapses"),
    )
    return g.select(
        "msno", "cutoff", F.col("l.payment_plan_days").alias("plan_days"), F.col("l.plan_list_price").alias("list_price"), F.col("l.actual_amount_paid").alias("amount_paid"),
        (F.col("l.plan_list_price") - F.col("l.actual_amount_paid")).alias("discount"), F.col("l.is_auto_renew").alias("auto_renew"), F.col("l.is_cancel").alias("cancel_last"),
        F.datediff("l.membership_expire_date", "cutoff").alias("days_to_expire"), F.datediff("cutoff", "l.transaction_date").alias("days_since_last_tx"), _text(F.col("l.payment_method_id")).alias("payment_method"),
        "n_tx", "n_tx_180d", "n_cancel", "n_cancel_365d", F.datediff("cutoff", "first").alias("tenure_days"), "auto_renew_share", "n_plans", "avg_paid", "n_lapses",
    )


def _profile_features(members: DataFrame) -> DataFrame:
    known = dealt(members, lambda c: F.col("registration_init_time").isNull() | (c >= F.col("registration_init_time")))
    return known.select("msno", "cutoff", valid_age(F.col("bd")).alias("age"), F.datediff("cutoff", "registration_init_time").alias("reg_days"), _text(F.col("city")).alias("city"), _text(F.col("registered_via")).alias("registered_via"), _text(F.col("gender")).alias("gender"))


def _listening_features(logs: DataFrame) -> DataFrame:
    """A month is dealt to the cut-offs of the three months from its end on, which sum it, and to those for which it is the last."""
    month, c = F.col("month_end"), F.col("cutoff")
    last3 = month > cal.shift_months(c, -3)
    following = logs.withColumn("following", F.lead("month_end").over(Window.partitionBy("msno").orderBy("month_end")))
    latest = lambda c: F.col("following").isNull() | (c < F.col("following"))
    seen = dealt(following, lambda c: (c >= month) & ((month > cal.shift_months(c, -3)) | latest(c)))
    one = {x: F.sum(F.when(month == c, F.col(x))).alias(f"{x}_1") for x in ("days_active", "total_secs", "num_unq")}
    three = {x: F.sum(F.when(last3, F.col(x))).alias(f"{x}_3") for x in ("days_active", *LOG_SUMS)}
    g = seen.groupBy("msno", "cutoff").agg(*one.values(), *three.values(), F.max("month_end").alias("last_month"))
    played = sum((F.coalesce(F.col(f"{x}_3"), F.lit(0)) for x in ("num_50", "num_75", "num_985", "num_100")), F.coalesce(F.col("num_25_3"), F.lit(0)))
    return g.select("msno", "cutoff", "days_active_1", "total_secs_1", "num_unq_1", "days_active_3", "total_secs_3", F.try_divide(F.col("num_100_3"), F.nullif(played, F.lit(0))).alias("completion_ratio"), "last_month")


def build(ds: Dataset, scored: DataFrame, cutoffs: list[date]) -> DataFrame:
    """(msno, cutoff, features) of each scored user; nothing dated after its cut-off enters a row.

    Rows meet the scored users before anything else, and go only to the cut-offs that score their user.
    """
    c, last = F.col("cutoff"), F.lit(max(cutoffs))
    people = people_of(scored.filter(c.isin(*cutoffs)))
    tx, logs = (df.filter(F.col(day) <= last).join(people, "msno") for df, day in ((ds.tx, "transaction_date"), (ds.logs, "month_end")))
    joined = scored.select(*KEYS)
    for made in (_tx_features(tx), _profile_features(ds.members.join(people, "msno")), _listening_features(logs)):
        joined = joined.join(made, KEYS, "left")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    days3 = F.datediff(c, cal.shift_months(c, -3))
    made = joined.withColumns({"days_active_m1": zero("days_active_1") / F.day(c), "secs_m1": zero("total_secs_1") / F.day(c), "unique_songs_m1": zero("num_unq_1") / F.day(c), "days_active_m3": zero("days_active_3") / days3, "secs_m3": zero("total_secs_3") / days3})
    made = made.withColumns({
        "activity_trend": (F.col("days_active_m1") + 0.03) / (F.col("days_active_m3") + 0.03),
        "months_since_active": F.coalesce(cal.months_between_ends(c, F.col("last_month")), F.lit(NEVER_ACTIVE)),
        **{x: zero(x) for x in ("n_tx", "n_tx_180d", "n_cancel", "n_cancel_365d", "n_lapses")},
    })
    return made.select(*KEYS, *(F.col(f).cast("double").alias(f) for f in NUMERIC), *(F.coalesce(F.col(f), F.lit("missing")).alias(f) for f in CATEGORICAL))


def training_table(ds: Dataset, cutoffs: list[date]) -> DataFrame:
    """Features, expiry and label of everyone scored on the cut-offs."""
    scored = churn_labels(ds, population(ds, cutoffs))
    return build(ds, scored, cutoffs).join(scored, KEYS)

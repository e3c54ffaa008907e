"""Feature sets of three published notebooks, over a whole file or an as-of view.

A recipe gets an AsOf: with the cut-offs' own dates it is honest; with `published` every row of the file is
seen from each cut-off, as the notebooks did.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import as_number
from tidemark.operators.asof import ORDER, AsOf
from tidemark.operators.clean import LOG_SUMS, indicator, valid_age
from tidemark.sources.tables import Dataset

KEYS = ["msno", "cutoff"]
LAST = ("payment_method_id", "payment_plan_days", "plan_list_price", "actual_amount_paid", "is_auto_renew", "is_cancel")
#: The values that recipe C turns into indicators.
CITIES, CHANNELS = (1, 4, 5, 13, 22), (3, 4, 7, 9)


class Whole(AsOf):
    """Every row, whatever its date, at each cut-off: the leak that the audit measures."""

    def _dealt(self, df: DataFrame, day: str) -> DataFrame:
        return df.withColumn("cutoff", F.explode(F.array(*(F.lit(c) for c in sorted(set(self.cutoffs))))))

    @property
    def members(self) -> DataFrame:
        return self._dealt(self.ds.members, "registration_init_time")


def _members(view: AsOf) -> DataFrame:
    return view.members.select(*KEYS, "city", "bd", "gender", "registered_via", "registration_init_time")


def _last(view: AsOf) -> DataFrame:
    return view.last_tx().select(*KEYS, *LAST, "transaction_date", "membership_expire_date")


def _doubles(df: DataFrame, columns: dict) -> DataFrame:
    return df.select(*KEYS, *(c.cast("double").alias(name) for name, c in columns.items()))


def features_a(view: AsOf, users: DataFrame) -> DataFrame:
    """Counts, modes (the smallest of equal ones), revenue, tenure, listening per active day, profile."""
    tx = view.tx.withColumn("quarter", F.quarter("transaction_date"))
    mode = lambda c: F.mode(c, True)
    g = tx.groupBy(*KEYS).agg(
        F.count("*").alias("regist_trans"), mode("payment_plan_days").alias("mode_plan_days"), mode("payment_method_id").alias("mode_payment_method"), F.sum("actual_amount_paid").alias("revenue"),
        F.avg("is_auto_renew").alias("is_auto_renew"), F.sum("is_cancel").alias("regist_cancels"), mode("quarter").alias("mode_quarter"), F.max("transaction_date").alias("last_tx"),
    )
    logs = view.logs.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in LOG_SUMS), F.sum("days_active").alias("days"))
    f = users.select(*KEYS).join(g, KEYS, "left").join(_members(view), KEYS, "left").join(logs, KEYS, "left")
    same = ("regist_trans", "mode_plan_days", "mode_payment_method", "revenue", "is_auto_renew", "regist_cancels", "mode_quarter")
    return _doubles(f, {
        **{c: F.col(c) for c in same}, "tenure": F.datediff("last_tx", "registration_init_time"), **{f"avg_{c}": F.log1p(F.try_divide(F.col(c), F.nullif("days", F.lit(0)))) for c in LOG_SUMS},
        "age": valid_age(F.col("bd"), 1, 89), "city": F.col("city"), "gender_male": indicator(F.col("gender"), "male"),
    })


def features_b(view: AsOf, users: DataFrame) -> DataFrame:
    """The last transaction and the member columns as they come, dates as numbers."""
    f = users.select(*KEYS).join(_last(view), KEYS, "left").join(_members(view), KEYS, "left")
    dates = ("transaction_date", "membership_expire_date")
    return _doubles(f, {**{c: F.col(c) for c in LAST}, **{c: as_number(F.col(c)) for c in dates}, "city": F.col("city"), "bd": F.col("bd"), "gender_male": indicator(F.col("gender"), "male"), "registered_via": F.col("registered_via"), "registration_init_time": as_number(F.col("registration_init_time"))})


def features_c(view: AsOf, users: DataFrame) -> DataFrame:
    """Transaction count, last transaction, log count and sums, indicators of the profile."""
    n = view.tx.groupBy(*KEYS).agg(F.count("*").alias("trans_count"))
    logs = view.logs.groupBy(*KEYS).agg(F.sum("days_active").alias("logs_count"), *(F.sum(c).alias(c) for c in LOG_SUMS))
    f = users.select(*KEYS).join(n, KEYS, "left").join(_last(view), KEYS, "left").join(_members(view), KEYS, "left").join(logs, KEYS, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return _doubles(f, {
        "trans_count": zero("trans_count"), **{c: F.col(c) for c in LAST}, "transaction_date": as_number(F.col("transaction_date")), "membership_expire_date": as_number(F.col("membership_expire_date")),
        "logs_count": zero("logs_count"), **{c: zero(c) for c in LOG_SUMS}, "bd": F.col("bd"), "registration_init_time": as_number(F.col("registration_init_time")),
        **{f"city_{v}": indicator(F.col("city"), v) for v in CITIES}, **{f"registered_via_{v}": indicator(F.col("registered_via"), v) for v in CHANNELS}, "gender_male": indicator(F.col("gender"), "male"),
    })


@dataclass(frozen=True)
class Recipe:
    """A user may add their own: features(view, users) gives (msno, cutoff, doubles); model names an estimator of models.py."""

    key: str
    features: Callable[[AsOf, DataFrame], DataFrame]
    model: str
    oversample: bool = False

    def published(self, ds: Dataset, users: DataFrame, cutoffs: list[date]) -> DataFrame:
        return self.features(Whole(ds, tuple(cutoffs)), users)

    def honest(self, ds: Dataset, users: DataFrame, cutoffs: list[date]) -> DataFrame:
        return self.features(AsOf(ds, tuple(cutoffs)), users)


RECIPES = {"A": Recipe("A", features_a, "forest_a", oversample=True), "B": Recipe("B", features_b, "forest_b"), "C": Recipe("C", features_c, "knn")}
__all__ = ["KEYS", "ORDER", "RECIPES", "Recipe", "Whole", "features_a", "features_b", "features_c"]

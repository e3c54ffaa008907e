"""Cleaning of raw rows, and the monthly grain of logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOG_COUNTS = ("num_25", "num_50", "num_75", "num_985", "num_100", "num_unq")
LOG_SUMS = (*LOG_COUNTS, "total_secs")
TX_INTS = ("payment_method_id", "payment_plan_days", "plan_list_price", "actual_amount_paid", "is_auto_renew", "is_cancel")
DAY_SECONDS = 86400


def compact_date(x: Column) -> Column:
    """A yyyymmdd number or text as a date; null if it is none."""
    return F.try_to_date(x.cast("string"), "yyyyMMdd")


def whole(x: Column) -> Column:
    """An integer; what is none counts as 0."""
    return F.coalesce(x.try_cast("double").try_cast("int"), F.lit(0))


def clean_tx(raw: DataFrame) -> DataFrame:
    """Typed transactions without rows that lack a date or repeat another row; tx_id tells ties apart, the same on every run."""
    rows = raw.select("msno", *(whole(F.col(c)).alias(c) for c in TX_INTS[:5]), compact_date(F.col("transaction_date")).alias("transaction_date"), compact_date(F.col("membership_expire_date")).alias("membership_expire_date"), whole(F.col("is_cancel")).alias("is_cancel"))
    rows = rows.na.drop(subset=["msno", "transaction_date", "membership_expire_date"]).dropDuplicates()
    return rows.withColumn("tx_id", F.xxhash64(*rows.columns))


def clean_members(raw: DataFrame, order: Column | None = None) -> DataFrame:
    """One row for each member: the first by `order` (by all values, if there is none to go by)."""
    have = set(raw.columns)
    of = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    number = lambda c: of(c).try_cast("double").try_cast("int").alias(c)
    rows = raw.select("msno", number("city"), number("bd"), F.coalesce(F.nullif(of("gender"), F.lit("")), F.lit("unknown")).alias("gender"), number("registered_via"), compact_date(of("registration_init_time")).alias("registration_init_time"), (order if order is not None else F.lit(0)).alias("_order"))
    first = Window.partitionBy("msno").orderBy("_order", "city", "bd", "gender", "registered_via", "registration_init_time")
    return rows.filter("msno IS NOT NULL").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_order")


def clip_seconds(x: Column) -> Column:
    """Seconds of one day; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(float(DAY_SECONDS)), x)))


def clean_daily_logs(raw: DataFrame) -> DataFrame:
    return raw.select("msno", compact_date(F.col("date")).alias("date"), *(F.col(c).try_cast("double").try_cast("long").alias(c) for c in LOG_COUNTS), F.col("total_secs").try_cast("double").alias("total_secs")).filter("msno IS NOT NULL AND date IS NOT NULL")


def monthly_logs(daily: DataFrame) -> DataFrame:
    """Sums, exact active days and the last day of each user and month."""
    rows = daily.withColumn("total_secs", clip_seconds(F.col("total_secs"))).withColumn("month_end", F.last_day("date"))
    # days are counted by a first grouping on the day itself, so that hot users are summed before the shuffle by month
    by_day = rows.groupBy("msno", "month_end", "date").agg(*(F.sum(c).alias(c) for c in LOG_SUMS))
    return by_day.groupBy("msno", "month_end").agg(*(F.sum(c).alias(c) for c in LOG_SUMS), F.count("*").alias("days_active"), F.max("date").alias("last_date"))


def valid_age(bd: Column, low: int = 10, high: int = 80) -> Column:
    """The age if it is from low to high, else null."""
    return F.when((bd >= low) & (bd <= high), bd)


def indicator(c: Column, value: object) -> Column:
    """1.0 if c is the value, 0.0 if not or null."""
    return F.coalesce((c == F.lit(value)).cast("double"), F.lit(0.0))

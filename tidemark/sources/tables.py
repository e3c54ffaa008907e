"""The canonical tables, and their mapping from a star schema of orders."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import clean

#: Raw files hold text; cleaning casts it.
RAW_TX = T.StructType([T.StructField(c, T.StringType()) for c in ("msno", "payment_method_id", "payment_plan_days", "plan_list_price", "actual_amount_paid", "is_auto_renew", "transaction_date", "membership_expire_date", "is_cancel")])
RAW_MEMBERS = T.StructType([T.StructField(c, T.StringType()) for c in ("msno", "city", "bd", "gender", "registered_via", "registration_init_time")])
RAW_LOGS = T.StructType([T.StructField(c, T.StringType()) for c in ("msno", "date", *clean.LOG_COUNTS, "total_secs")])


@dataclass(frozen=True)
class Dataset:
    """Transactions, members and monthly logs; nothing is read until a result is asked for."""

    tx: DataFrame
    members: DataFrame
    logs: DataFrame

    @cached_property
    def data_end(self) -> date:
        return self.tx.agg(F.max("transaction_date")).first()[0]


def star_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a transaction of its customer."""
    day = F.to_date("o_orderdate")
    plan = F.element_at(F.array(*(F.lit(x) for x in (90, 180, 365, 540))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    price = F.round("o_totalprice").cast("int")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_custkey IS NOT NULL")
    return orders.select(
        F.col("o_custkey").cast("string").alias("msno"), F.substring("o_orderpriority", 1, 1).cast("int").alias("payment_method_id"), plan.alias("payment_plan_days"), price.alias("plan_list_price"),
        F.when(F.col("o_orderkey") % 7 == 0, F.floor(price * 0.8).cast("int")).otherwise(price).alias("actual_amount_paid"), (F.col("o_orderstatus") == "O").cast("int").alias("is_auto_renew"),
        day.alias("transaction_date"), F.date_add(day, plan).alias("membership_expire_date"), (F.col("o_orderkey") % 10 == 0).cast("int").alias("is_cancel"), F.col("o_orderkey").alias("tx_id"),
    )


def star_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    gender = F.when(F.col("c_mktsegment") == "BUILDING", "male").when(F.col("c_mktsegment") == "MACHINERY", "female").otherwise("unknown")
    return c.select(
        F.col("c_custkey").cast("string").alias("msno"), F.col("c_nationkey").cast("int").alias("city"), F.floor(F.col("c_acctbal") / 100).cast("int").alias("bd"), gender.alias("gender"),
        (F.col("c_custkey") % 5).cast("int").alias("registered_via"), F.date_add(F.lit(date(1994, 1, 1)), (F.col("c_custkey") % 2500).cast("int")).alias("registration_init_time"),
    )


def star_daily_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order line as a day of listening."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_quantity", "l_linenumber", "l_extendedprice", "l_shipdate")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    q, n = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("string").alias("msno"), F.to_date("l_shipdate").alias("date"), q.alias("num_25"), n.alias("num_50"), (q % 7).alias("num_75"), (n % 3).alias("num_985"), (q + n).alias("num_100"), (q % 11).alias("num_unq"), F.col("l_extendedprice").alias("total_secs")
    )


def star(spark: SparkSession, sf_dir: str) -> Dataset:
    return Dataset(star_tx(spark, sf_dir), star_members(spark, sf_dir), clean.monthly_logs(star_daily_logs(spark, sf_dir)))

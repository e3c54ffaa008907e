"""Structured Streaming: monthly logs from a file stream, ticks by month, and labels by event time."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators.clean import LOG_SUMS, clip_seconds
from tidemark.sources.shared import Folder, work_dir


def monthly(stream: DataFrame, delay: str = "30 days") -> DataFrame:
    """Calendar-month sums of a stream of daily logs (msno, date, counters); days are exact within a batch's state.

    Months aren't of one length, so the month end is the key; its timestamp carries the watermark.
    """
    rows = stream.withColumn("total_secs", clip_seconds(F.col("total_secs"))).withColumn("month_ts", F.last_day("date").cast("timestamp")).withWatermark("month_ts", delay)
    sums = rows.groupBy("msno", "month_ts").agg(*(F.sum(c).alias(c) for c in LOG_SUMS), F.size(F.collect_set("date")).alias("days_active"), F.max("date").alias("last_date"))
    return sums.withColumn("month_end", F.to_date("month_ts")).drop("month_ts")


def run_available(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Drain what a stream has now into Parquet in the shared folder, one folder for each batch; the last row of each key.

    A batch that is tried again overwrites its folder, so each counts once.
    """
    spark = stream.sparkSession
    at = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{at}/rows/batch={batch}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if not Folder(spark, at).names("rows"):
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.parquet(f"{at}/rows")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row")).select(*keys, "_row.*").select(*stream.columns)


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A stream of a Parquet table, which may be one file or a folder of files."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if Folder(spark, path).is_folder():
        return reader.parquet(path)
    folder, file = path.rstrip("/").rsplit("/", 1)
    return reader.option("pathGlobFilter", file).parquet(folder)


def monthly_from_stream(spark: SparkSession, lines_path: str, orders_path: str) -> DataFrame:
    """The monthly logs of the star schema, from its order lines as a stream joined with the orders."""
    lines = stream_of(spark, lines_path)
    orders = spark.read.parquet(orders_path).select("o_orderkey", "o_custkey")
    q, n = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    daily = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("string").alias("msno"), F.to_date("l_shipdate").alias("date"),
        q.alias("num_25"), n.alias("num_50"), (q % 7).alias("num_75"), (n % 3).alias("num_985"), (q + n).alias("num_100"), (q % 11).alias("num_unq"),
        F.col("l_extendedprice").alias("total_secs"),
    )
    return run_available(monthly(daily), ["msno", "month_end"]).select("msno", "month_end", "days_active", "total_secs")


def ticks(months: DataFrame, on_month: Callable[[DataFrame, int], None], checkpoint: str):
    """Call on_month for each new file of a stream of month files, one file a batch, so that months keep their order."""
    return months.writeStream.foreachBatch(on_month).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed_labels(scored: DataFrame, tx: DataFrame, grace: int = cal.GRACE_DAYS) -> DataFrame:
    """(msno, cutoff, is_churn) by event time.

    scored (msno, cutoff_ts, expire_ts) and tx (msno, tx_ts, tx_expire_ts, is_cancel) are streams with
    timestamps.  A scored user without a renewal in time comes out as a leaver once both watermarks have
    passed the grace days; one with several renewals comes out once, with the first that is met.
    """
    s = scored.withWatermark("expire_ts", "0 seconds")
    t = tx.filter("is_cancel = 0").withWatermark("tx_ts", "0 seconds").withColumnRenamed("msno", "tx_msno")
    end: Column = F.col("expire_ts") + F.expr(f"INTERVAL {grace} DAYS")
    # the cut-off is within a month before the expiry: that bounds the state
    near = (F.col("tx_ts") > F.col("expire_ts") - F.expr("INTERVAL 32 DAYS")) & (F.col("tx_ts") <= end)
    on = (F.col("msno") == F.col("tx_msno")) & near & (F.col("tx_ts") > F.col("cutoff_ts")) & (F.col("tx_expire_ts") > F.col("expire_ts"))
    out = s.join(t, on, "leftOuter").select("msno", "cutoff_ts", "expire_ts", F.col("tx_msno").isNull().cast("int").alias("is_churn"))
    once = out.dropDuplicates(["msno", "cutoff_ts", "expire_ts"])
    return once.select("msno", F.to_date("cutoff_ts").alias("cutoff"), "is_churn")

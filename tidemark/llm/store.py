"""Intermediate tables in the folder that the cluster shares, and how many buckets to deal rows into."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


ROWS_AT_A_TIME = 1000


def work_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where none is set (tests in one process), a folder of this machine."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        at = tempfile.mkdtemp(prefix="tidemark-")
        context.setCheckpointDir(at)
    return at.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def drop(*kept: DataFrame) -> None:
    """Delete tables that keep() wrote, once nothing reads them any more."""
    for df in kept:
        _remove(df.sparkSession, df.kept_at)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Remove the shuffle files of each job once it ends: what it made is kept, so nothing reads them again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession) -> None:
    """Let at most ROWS_AT_A_TIME rows travel to Python at once: texts may be long, and workers share a machine's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS_AT_A_TIME:
        spark.conf.set(name, ROWS_AT_A_TIME)


def buckets(df: DataFrame, per_split: int = 4) -> int:
    """A bucket number in proportion to the input: its scan's splits bound a bucket's bytes."""
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(shuffle, per_split * df.rdd.getNumPartitions())


def documents_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the rows with an id, one for each id; of rows that share an id, the least text counts.

    Only the ids are read to see whether any repeats; texts are shuffled only if one does.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    if rows.select("id").groupBy("id").count().filter("count > 1").isEmpty():
        return rows
    return rows.groupBy("id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def unique_ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with one row for each id, that of the least text (null counts as empty); rows without an id all stay.

    Nothing is shuffled but the ids, unless one repeats.
    """
    if docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").isEmpty():
        return docs
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row).filter(F.col("row").getField(id_col).isNotNull())
    least = Window.partitionBy(F.col("row").getField(id_col)).orderBy(F.coalesce(F.col("row").getField(text_col), F.lit("")), F.to_json("row"))
    first = rows.withColumn("_n", F.row_number().over(least)).filter("_n = 1").select("row")
    return first.unionByName(docs.filter(F.col(id_col).isNull()).select(row)).select("row.*")

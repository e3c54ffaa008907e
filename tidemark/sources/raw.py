"""Raw CSV files to prepared Parquet tables, and back into a dataset."""

from __future__ import annotations

import tomllib
import warnings
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import clean
from tidemark.sources.tables import RAW_LOGS, RAW_MEMBERS, RAW_TX, Dataset

TX_FILES, MEMBER_FILES, LOG_FILES = ("transactions.csv", "transactions_v2.csv"), ("members_v3.csv", "members.csv"), ("user_logs.csv", "user_logs_v2.csv")
#: Rows at which a spreadsheet cuts a file off.
SPREADSHEET_ROWS = 1_048_575


def _there(spark: SparkSession, folder: str, names: tuple[str, ...]) -> list[str]:
    """The files that exist, wherever Spark can read them."""
    out = []
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            out.append(f"{folder}/{name}")
    return out


def _csv(spark: SparkSession, paths: list[str], schema) -> DataFrame:
    """Text columns by the header's names; columns that a file lacks are null, others are left out."""
    out = None
    for path in paths:
        rows = spark.read.csv(path, header=True)
        rows = rows.select(*(F.col(f.name) if f.name in rows.columns else F.lit(None).cast("string").alias(f.name) for f in schema))
        out = rows if out is None else out.unionByName(rows)
    return out


def prepare(spark: SparkSession, raw: str, prepared: str) -> None:
    """Write transactions, members and monthly logs.  Transactions must exist; the others may be missing."""
    tx = _there(spark, raw, TX_FILES)
    if not tx:
        raise FileNotFoundError(f"{raw} has none of {', '.join(TX_FILES)}")
    clean.clean_tx(_csv(spark, tx, RAW_TX)).write.mode("overwrite").parquet(f"{prepared}/transactions")
    members = _there(spark, raw, MEMBER_FILES)[:1]
    rows = _csv(spark, members, RAW_MEMBERS).withColumn("_line", F.monotonically_increasing_id()) if members else spark.createDataFrame([], RAW_MEMBERS).withColumn("_line", F.lit(0))
    clean.clean_members(rows, F.col("_line")).write.mode("overwrite").parquet(f"{prepared}/members")
    n = spark.read.parquet(f"{prepared}/members").count()
    if n == SPREADSHEET_ROWS:
        warnings.warn("the members file has as many rows as a spreadsheet holds: it may be cut off", stacklevel=2)
    logs = _there(spark, raw, LOG_FILES)
    if logs:
        clean.monthly_logs(clean.clean_daily_logs(_csv(spark, logs, RAW_LOGS))).write.mode("overwrite").parquet(f"{prepared}/logs_monthly")


def load(spark: SparkSession, prepared: str) -> Dataset:
    """The prepared tables; without logs, an empty table of them."""
    logs = spark.read.parquet(f"{prepared}/logs_monthly") if _there(spark, prepared, ("logs_monthly",)) else clean.monthly_logs(clean.clean_daily_logs(spark.createDataFrame([], RAW_LOGS)))
    return Dataset(spark.read.parquet(f"{prepared}/transactions"), spark.read.parquet(f"{prepared}/members"), logs)


def load_config(path: str | Path) -> dict:
    """Settings from a TOML file."""
    return tomllib.loads(Path(path).read_text())

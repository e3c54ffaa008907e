"""The only door to history: what was known on each of several cut-offs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import Dataset

#: Later rows first: by day, then by expiry, then by the id that tells ties apart.
ORDER = ("transaction_date", "membership_expire_date", "tx_id")


def visible(ds: Dataset, cutoff: date) -> Dataset:
    """The rows that were known on one cut-off."""
    c = F.lit(cutoff)
    return Dataset(ds.tx.filter(F.col("transaction_date") <= c), ds.members.filter(F.col("registration_init_time").isNull() | (F.col("registration_init_time") <= c)), ds.logs.filter(F.col("month_end") <= c))


def _dates(cutoffs: list[date]) -> Column:
    return F.array(*(F.lit(c) for c in sorted(set(cutoffs))))


def people_of(scored: DataFrame) -> DataFrame:
    """(msno, cutoffs): each scored user once, with the cut-offs that score them."""
    return scored.groupBy("msno").agg(F.array_sort(F.collect_set("cutoff")).alias("cutoffs"))


def dealt(df: DataFrame, sees: Callable[[Column], Column]) -> DataFrame:
    """Rows of df, which has people_of's `cutoffs`, dealt to those cut-offs for which `sees` holds."""
    return df.withColumn("cutoff", F.explode(F.filter("cutoffs", sees))).drop("cutoffs")


@dataclass(frozen=True)
class AsOf:
    """A dataset seen from several cut-offs at once.

    Each row is dealt to the cut-offs from its day on, so one job serves them all; dates after the last
    cut-off are filtered at the scan.
    """

    ds: Dataset
    cutoffs: tuple[date, ...]

    def _dealt(self, df: DataFrame, day: str) -> DataFrame:
        last = max(self.cutoffs)
        from_day = F.filter(_dates(list(self.cutoffs)), lambda c: c >= F.col(day))
        return df.filter(F.col(day) <= F.lit(last)).withColumn("cutoff", F.explode(from_day))

    @property
    def tx(self) -> DataFrame:
        return self._dealt(self.ds.tx, "transaction_date")

    @property
    def logs(self) -> DataFrame:
        return self._dealt(self.ds.logs, "month_end")

    @property
    def members(self) -> DataFrame:
        """Members whose registration was known; one without a registration date always is."""
        known = F.filter(_dates(list(self.cutoffs)), lambda c: F.col("registration_init_time").isNull() | (c >= F.col("registration_init_time")))
        return self.ds.members.withColumn("cutoff", F.explode(known))

    def last_tx(self) -> DataFrame:
        """The latest known transaction of each user at each cut-off."""
        row = F.struct(*ORDER, *(c for c in self.ds.tx.columns if c not in (*ORDER, "msno")))
        last = self.tx.groupBy("msno", "cutoff").agg(F.max(row).alias("row"))
        return last.select("msno", "cutoff", "row.*")

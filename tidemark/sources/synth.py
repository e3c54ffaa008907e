"""Made-up subscription histories in the raw file format, one customer a group of rows, the same on every run.

What is built in, so that audits and monitors have something to find: manual renewal and little listening
go with leaving; leavers listen less in their last month; automatic renewers who leave mostly file a cancel
some days before; and from PROMO_FROM on a free first period brings in many who leave once they must pay.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tidemark.functions import calendar as cal

FIRST, LAST, PROMO_FROM = date(2015, 1, 1), date(2017, 3, 31), date(2016, 9, 1)
#: Price and share of customers of each plan, by its days; payment methods by how a customer renews.
PLANS = {30: (150, 0.80), 90: (420, 0.08), 180: (800, 0.05), 365: (1500, 0.04), 14: (0, 0.03)}
METHODS = {"automatic": (41, 40, 39), "manual": (38, 32, 30), "promo": (34,)}
#: Chance to leave at the end of a period; a free promo's first paid period comes third.
LEAVES = {"automatic": 0.05, "manual": 0.22, "promo": 0.06}
PROMO_PAYS = 0.75

_ROWS = "kind string, msno string, a string, b string, c string, d string, e string, f string, g string, h string"
_TX = ["msno", "payment_method_id", "payment_plan_days", "plan_list_price", "actual_amount_paid", "is_auto_renew", "transaction_date", "membership_expire_date", "is_cancel"]
_MEMBERS = ["msno", "city", "bd", "gender", "registered_via", "registration_init_time"]
_LOGS = ["msno", "date", "num_25", "num_50", "num_75", "num_985", "num_100", "num_unq", "total_secs"]


class Customer:
    """One customer's life, drawn from a generator seeded by their number."""

    def __init__(self, number: int, seed: int):
        self.rng = rng = np.random.default_rng([seed, number])
        self.msno = f"u{number:09d}"
        self.months = cal.ends_between(FIRST, LAST)
        self.kind = str(rng.choice(["automatic", "manual", "promo"], p=[0.62, 0.20, 0.18]))
        self.plan = 30 if self.kind == "promo" else int(rng.choice(list(PLANS), p=[share for _, share in PLANS.values()]))
        # keenness wanders around a level of the customer's own
        steps = rng.normal(0, 0.3, len(self.months))
        self.keen = rng.normal() + np.convolve(steps, 0.7 ** np.arange(6))[: len(steps)]
        self.tx: list[tuple] = []
        self.heard: dict[int, float] = {}
        self._live()

    def _later(self, day: date, low: int, high: int) -> date:
        return day + timedelta(days=int(self.rng.integers(low, high)))

    def _month(self, day: date) -> int:
        return min(len(self.months) - 1, max(0, (day.year - FIRST.year) * 12 + day.month - 1))

    def _book(self, day: date, ends: date, paid: int, cancel: bool = False) -> None:
        if day <= LAST:
            method = METHODS[self.kind][int(self.rng.integers(len(METHODS[self.kind])))]
            self.tx.append((method, self.plan, PLANS[self.plan][0], paid, int(self.kind != "manual" and not cancel), f"{day:%Y%m%d}", f"{ends:%Y%m%d}", int(cancel)))

    def _start(self) -> date:
        if self.kind == "promo":
            return self._later(PROMO_FROM, 0, 150)
        early = self.rng.random() < 0.45
        return self._later(FIRST, 0, 30) if early else self._later(FIRST, 30, (LAST - FIRST).days - 30)

    def _live(self) -> None:
        rng, price = self.rng, PLANS[self.plan][0]
        day = self._start()
        self.registered = self._later(day, -900, 1)
        periods = strikes = 0
        while day <= LAST:
            free = self.kind == "promo" and periods < 2
            ends = day + timedelta(days=self.plan)
            self._book(day, ends, 0 if free else price)
            periods += 1
            for m in range(self._month(day), self._month(ends) + 1):
                self.heard[m] = 1.0
            if ends > LAST:
                return
            due = self._month(ends)
            risk = PROMO_PAYS if self.kind == "promo" and periods == 3 else LEAVES[self.kind] * 1.5**strikes * np.exp(-0.6 * self.keen[due])
            if rng.random() >= min(0.95, risk):
                day = self._later(ends, -1, 1) if self.kind != "manual" else self._later(ends, -8, 18)
                continue
            if self.kind != "promo":
                self.heard[due] = 0.3
            if self.kind == "automatic" and rng.random() < 0.8:
                self._book(self._later(ends, -18, 0), ends, 0, cancel=True)
            if rng.random() >= 0.25:
                return
            strikes += 1
            day = self._later(ends, 50, 280)

    def profile(self) -> tuple:
        rng = self.rng
        city = int(rng.choice([1, 4, 5, 13, 22, 8], p=[0.4, 0.15, 0.15, 0.1, 0.1, 0.1]))
        age = int(rng.integers(14, 65)) if rng.random() < 0.5 else 0
        return city, age, ("", "male", "female")[int(rng.integers(3))], (3, 4, 7, 9)[int(rng.integers(4))], f"{self.registered:%Y%m%d}"

    def listening(self) -> Iterator[tuple]:
        rng = self.rng
        for m, share in sorted(self.heard.items()):
            end = self.months[m]
            days = np.flatnonzero(rng.random(end.day) < share * 0.55 / (1 + np.exp(-self.keen[m]))) + 1
            for d in days.tolist():
                songs = 1 + int(rng.poisson(18 * np.exp(0.3 * self.keen[m])))
                whole, *parts = rng.multinomial(songs, [0.6, 0.2, 0.1, 0.1]).tolist()
                yield f"{end:%Y%m}{d:02d}", *parts, 0, whole, max(1, songs * 9 // 10), round(songs * float(rng.uniform(170, 250)), 3)


def _lives(seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 200):
                rows = []
                for number in batch["id"].iloc[lo : lo + 200]:
                    c = Customer(int(number), seed)
                    rows += [("tx", c.msno, *x) for x in c.tx]
                    rows.append(("member", c.msno, *c.profile(), None, None, None))
                    rows += [("log", c.msno, *x) for x in c.listening()]
                yield pd.DataFrame([[None if x is None else str(x) for x in r] for r in rows], columns=["kind", "msno", *"abcdefgh"])

    return run


def generate(spark: SparkSession, users: int = 8000, seed: int = 7) -> dict[str, DataFrame]:
    """Raw text tables by file name.  Customers are independent, so any number of tasks can draw them."""
    rows = spark.range(users).mapInPandas(_lives(seed), _ROWS)
    of = lambda kind, columns: rows.filter(rows.kind == kind).select(*(rows[c].alias(name) for c, name in zip(["msno", *"abcdefgh"], columns, strict=False)))
    return {"transactions.csv": of("tx", _TX), "members_v3.csv": of("member", _MEMBERS), "user_logs.csv": of("log", _LOGS)}


def write_sample(spark: SparkSession, raw: str, users: int = 8000, seed: int = 7) -> None:
    for name, df in generate(spark, users, seed).items():
        df.write.mode("overwrite").csv(f"{raw}/{name}", header=True)

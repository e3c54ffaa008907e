"""Month-end calendar: Column expressions for tables, and the same rules for single dates on the driver."""

from __future__ import annotations

import calendar as _calendar
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days after a membership's month in which a renewal still counts.
GRACE_DAYS = 30


def month_end(d: Column) -> Column:
    return F.last_day(d)


def shift_months(d: Column, months: Column | int) -> Column:
    """The month end `months` after d's month."""
    return F.last_day(F.add_months(F.last_day(d), months))


def label_known_on(cutoff: Column) -> Column:
    """The day from which a cut-off's labels are settled."""
    return F.date_add(shift_months(cutoff, 1), GRACE_DAYS)


def is_mature(cutoff: Column, now: Column) -> Column:
    return now >= label_known_on(cutoff)


def month_ends_between(first: Column, last: Column) -> Column:
    """Array of month ends from first's month to last's month."""
    return F.transform(F.sequence(F.trunc(first, "MM"), F.trunc(last, "MM"), F.expr("interval 1 month")), F.last_day)


def months_between_ends(later: Column, earlier: Column) -> Column:
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def as_number(d: Column) -> Column:
    """A date as the number yyyymmdd."""
    return F.year(d) * 10000 + F.month(d) * 100 + F.day(d)


def end_of(d: date) -> date:
    return d.replace(day=_calendar.monthrange(d.year, d.month)[1])


def shifted(d: date, months: int) -> date:
    at = d.year * 12 + d.month - 1 + months
    return end_of(date(at // 12, at % 12 + 1, 1))


def known_on(cutoff: date) -> date:
    return shifted(cutoff, 1) + timedelta(days=GRACE_DAYS)


def mature(cutoff: date, now: date) -> bool:
    return now >= known_on(cutoff)


def ends_between(first: date, last: date) -> list[date]:
    out, at = [], end_of(first)
    while at <= end_of(last):
        out.append(at)
        at = shifted(at, 1)
    return out

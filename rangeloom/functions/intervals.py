"""Calendar intervals: text to (months, days, microseconds), sums, ages; for Python values and for columns."""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY = 86_400_000_000
#: Units by their singular, as (months, days, microseconds).
_UNITS = {"year": (12, 0, 0), "mon": (1, 0, 0), "month": (1, 0, 0), "week": (0, 7, 0), "day": (0, 1, 0), "hour": (0, 0, 3_600_000_000), "minute": (0, 0, 60_000_000), "min": (0, 0, 60_000_000), "second": (0, 0, 1_000_000), "sec": (0, 0, 1_000_000)}
_PART = re.compile(r"([+-]?\d+(?:\.\d+)?)\s*([a-z]+)|([+-]?)(\d+):(\d\d)(?::(\d\d(?:\.\d+)?))?")


@dataclass(frozen=True)
class Interval:
    months: int = 0
    days: int = 0
    micros: int = 0

    @classmethod
    def parse(cls, text: str) -> Interval:
        left, total, i = text.strip().lower(), [0, 0, 0], 0
        while i < len(left):
            m = _PART.match(left, i)
            if not m:
                raise ValueError(f"not an interval: {text!r}")
            if m[2]:
                unit = _UNITS.get(m[2]) or _UNITS.get(m[2].removesuffix("s"))
                if not unit or ("." in m[1] and not unit[2]):
                    raise ValueError(f"not an interval: {text!r}")
                total = [t + int(float(m[1]) * u) for t, u in zip(total, unit, strict=True)]
            else:
                clock = int(m[4]) * 3_600_000_000 + int(m[5]) * 60_000_000 + round(float(m[6] or 0) * 1_000_000)
                total[2] += -clock if m[3] == "-" else clock
            i = m.end()
            while i < len(left) and left[i] in " ,":
                i += 1
        if not left:
            raise ValueError("an empty interval")
        return cls(*total)

    @property
    def length(self) -> int:
        """Microseconds, a month as 30 days: how intervals of several units compare."""
        return (self.months * 30 + self.days) * _DAY + self.micros

    def __neg__(self) -> Interval:
        return Interval(-self.months, -self.days, -self.micros)


def plus(at: datetime, step: Interval) -> datetime:
    """Months first, to the last day of a shorter month; then days and time."""
    month = at.year * 12 + at.month - 1 + step.months
    year, month = divmod(month, 12)
    day = min(at.day, calendar.monthrange(year, month + 1)[1])
    return at.replace(year=year, month=month + 1, day=day) + timedelta(days=step.days, microseconds=step.micros)


def age(upper: date, lower: date) -> Interval:
    """Whole months and days from lower to upper (lower <= upper)."""
    months = (upper.year - lower.year) * 12 + upper.month - lower.month
    days = upper.day - lower.day
    if days < 0:
        months, days = months - 1, days + calendar.monthrange(lower.year, lower.month)[1]
    return Interval(months, days)


def age_months(lower: Column, upper: Column) -> Column:
    return F.year(upper) * 12 + F.month(upper) - F.year(lower) * 12 - F.month(lower) - F.when(F.day(upper) < F.day(lower), 1).otherwise(0)


def age_days(lower: Column, upper: Column) -> Column:
    return F.day(upper) - F.day(lower) + F.when(F.day(upper) < F.day(lower), F.day(F.last_day(lower))).otherwise(0)


def next_upper(lower: Column, upper: Column) -> Column:
    """The upper bound of the partition after [lower, upper): one such step on."""
    return (upper + F.make_interval(F.lit(0), age_months(lower, upper), F.lit(0), age_days(lower, upper))).cast("timestamp_ntz")

"""Small helpers that turn filter values into pushable predicates."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


class Match:
    """Text comparison, exact or ignoring case on both sides."""

    def __init__(self, ignore_case: bool = False):
        self.ignore_case = ignore_case

    def _both(self, column: Column, *values: str) -> tuple[Column, list[str]]:
        if self.ignore_case:
            return F.lower(column), [v.lower() for v in values]
        return column, list(values)

    def eq(self, column: Column, value: str) -> Column:
        c, (v,) = self._both(column, value)
        return c == v

    def isin(self, column: Column, values: list[str]) -> Column:
        c, vs = self._both(column, *values)
        return c.isin(vs)

    def contains(self, column: Column, value: str) -> Column:
        """Literal substring: ``%`` and ``_`` have no special meaning."""
        c, (v,) = self._both(column, value)
        return c.contains(v)

    def startswith(self, column: Column, value: str) -> Column:
        c, (v,) = self._both(column, value)
        return c.startswith(v)


def moment(text: str) -> Column:
    """A wall-clock timestamp literal."""
    return F.to_timestamp_ntz(F.lit(text))


def now(as_of: str | datetime | None) -> Column:
    """``as_of`` as a literal, else the current wall-clock time."""
    return F.localtimestamp() if as_of is None else moment(str(as_of))


def ago(as_of: str | datetime | None, days: int = 0, hours: int = 0) -> Column:
    return now(as_of) - F.make_dt_interval(days=F.lit(days), hours=F.lit(hours))


def number(value: float) -> Column:
    """A bound as an exact literal, which both decimal and double scans accept."""
    return F.lit(Decimal(repr(value)))


def filled(column: Column) -> Column:
    return column.isNotNull() & (column != "")


def day_range(column: Column, first: str | None, last: str | None) -> list[Column]:
    """From the start of ``first`` to the end of ``last``, its last fraction of a second included.

    The last day of the calendar, 9999-12-31, bounds nothing: no moment lies after it.
    """
    out = []
    if first is not None:
        out.append(column >= moment(f"{first} 00:00:00"))
    if last is not None and date.fromisoformat(last) < date.max:
        following = date.fromisoformat(last) + timedelta(days=1)
        out.append(column < moment(f"{following} 00:00:00"))
    return out


def between(column: Column, low, high) -> list[Column]:
    out = []
    if low is not None:
        out.append(column >= (number(low) if isinstance(low, float) else F.lit(low)))
    if high is not None:
        out.append(column <= (number(high) if isinstance(high, float) else F.lit(high)))
    return out

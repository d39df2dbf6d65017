"""Calendar arithmetic that counts boundaries, not elapsed units."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

Bounds = Callable[[Column, Column], Column]
"""A window around an index date: ``bounds(event, index) -> predicate``."""


@dataclass(frozen=True)
class Reach:
    """Bounds that also say how many days from the index date an event can lie, at least and at most (None: any)."""

    holds: Bounds
    first: int | None = None
    last: int | None = None

    def __call__(self, event: Column, index: Column) -> Column:
        return self.holds(event, index)


def years_between(start: Column, end: Column) -> Column:
    """Calendar-year boundaries crossed (31 Dec -> 1 Jan is one year)."""
    return F.year(end) - F.year(start)


def months_between_calendar(start: Column, end: Column) -> Column:
    """Month boundaries crossed."""
    return years_between(start, end) * 12 + F.month(end) - F.month(start)


def days_between(start: Column, end: Column) -> Column:
    """Midnights crossed; a time of day does not matter."""
    return F.datediff(end, start)


def shift_months(column: Column, months: int) -> Column:
    """Clamps to the month's last day: 31 Aug - 6 months is 28/29 Feb."""
    return column + F.make_ym_interval(F.lit(0), F.lit(months))


def shift_days(column: Column, days: int) -> Column:
    return column.cast("timestamp_ntz") + F.make_dt_interval(F.lit(days))


def as_day(column: Column) -> Column:
    return F.to_date(column)


def as_datetime(column: Column) -> Column:
    return column.cast("timestamp_ntz")


def parse_date(column: Column, *formats: str) -> Column:
    """First format that fits wins; text that fits none becomes NULL."""
    tries = [F.to_date(F.try_to_timestamp(column, F.lit(f))) for f in formats]
    return F.coalesce(*tries)


# --- windows around the index date ------------------------------------------

def after(days: int) -> Reach:
    """Strictly after the index moment, at most ``days`` midnights later."""
    return Reach(lambda event, index: (event > index) & (days_between(index, event) <= days), 0, days)


def before(days: int) -> Reach:
    """Strictly before the index moment, at most ``days`` midnights earlier."""
    return Reach(lambda event, index: (event < index) & (days_between(event, index) <= days), -days, 0)


def ever_before() -> Reach:
    return Reach(lambda event, index: event < index, None, 0)


def ever_after() -> Reach:
    return Reach(lambda event, index: event > index, 0, None)


def years_before(years: int) -> Reach:
    """Before the index moment and at most ``years`` calendar years back."""
    return Reach(lambda event, index: (event < index) & (years_between(event, index) <= years), -366 * (years + 1), 0)


def around(days: int) -> Reach:
    """Within ``days`` either side, both ends included."""
    return Reach(lambda event, index: event.between(shift_days(index, -days), shift_days(index, days)), -days - 1, days + 1)


def month_range(first: int, last: int) -> Reach:
    """Between two month offsets (negative = before), both ends included."""
    # a month has 28 to 31 days, and the last day of a month is shifted by up to three more
    return Reach(lambda event, index: event.between(shift_months(index, first), shift_months(index, last)),
                 (28 if first >= 0 else 31) * first - 4, (31 if last >= 0 else 28) * last + 4)

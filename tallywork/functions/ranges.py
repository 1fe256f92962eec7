"""Calendar ranges as plain dates."""

from __future__ import annotations

import datetime as dt


def month_shift(day: dt.date, months: int) -> dt.date:
    """First day of the month that lies months away."""
    n = day.year * 12 + day.month - 1 + months
    return dt.date(n // 12, n % 12 + 1, 1)


def default_range(today: dt.date) -> tuple[dt.date, dt.date]:
    """From the first of the month five months back to today."""
    return month_shift(today, -5), today


def previous_range(start: dt.date, end: dt.date) -> tuple[dt.date, dt.date]:
    """As many days, ending the day before start."""
    last = start - dt.timedelta(1)
    return last - (end - start), last


def month_range(today: dt.date) -> tuple[dt.date, dt.date]:
    return month_shift(today, 0), month_shift(today, 1) - dt.timedelta(1)


def checked_range(start, end, compare_start=None, compare_end=None):
    """Dates of a request; ValueError for text that is no date, a compare range with one end, or an end before its start."""
    days = [x if isinstance(x, dt.date) or x is None else dt.date.fromisoformat(x) for x in (start, end, compare_start, compare_end)]
    if days[0] is None or days[1] is None or (days[2] is None) != (days[3] is None):
        raise ValueError("a range needs both ends")
    if days[1] < days[0] or days[2] and days[3] < days[2]:
        raise ValueError("a range ends before it starts")
    return days


def checked_page(page: int = 1, size: int = 50) -> tuple[int, int]:
    if page < 1 or not 1 <= size <= 100:
        raise ValueError("page is at least 1, its size 1 to 100")
    return page, size

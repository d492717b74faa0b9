"""Partial dates (YYYY, YYYY-MM, YYYY-MM-DD) as intervals, months and years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ymd(c: Column) -> tuple[Column, Column, Column]:
    text = F.trim(F.coalesce(c, F.lit("")))
    pattern = r"^(\d{4})(?:-(\d{2})(?:-(\d{2}))?)?"
    return tuple(F.regexp_extract(text, pattern, k) for k in (1, 2, 3))


def lower_bound(c: Column) -> Column:
    """First day that a partial date may mean; null if it is none."""
    y, m, d = _ymd(c)
    day = F.try_to_date(F.concat_ws("-", y, F.when(m == "", "01").otherwise(m), F.when(d == "", "01").otherwise(d)), "yyyy-MM-dd")
    return F.when((y != "") & (y != "0000"), day)


def upper_bound(c: Column) -> Column:
    """Last day that a partial date may mean."""
    y, m, d = _ymd(c)
    low = lower_bound(c)
    return F.when(d != "", low).when(m != "", F.last_day(low)).otherwise(F.last_day(F.add_months(low, 11)))


def overlaps(c: Column, begin: Column, end: Column) -> Column:
    """The interval of a partial date meets [begin, end]; none does if there is no date."""
    return F.coalesce((upper_bound(c) >= begin) & (lower_bound(c) <= end), F.lit(False))


def month(c: Column) -> Column:
    return F.trunc(c, "month")


def month_in(c: Column, begin: Column, end: Column) -> Column:
    """Month-grain window; reversed bounds are swapped."""
    return F.trunc(c, "month").between(F.trunc(F.least(begin, end), "month"), F.trunc(F.greatest(begin, end), "month"))


def day_in(day: Column, begin: Column, end: Column) -> Column:
    """Window on the day itself, bounds as they are: reversed ones hold nothing."""
    return F.coalesce((day >= begin) & (day <= end), F.lit(False))


def year_anywhere(c: Column) -> Column:
    """The first year from 1800 to 2199 that stands alone among digits."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"(?<!\d)((?:18|19|20|21)\d{2})(?!\d)", 1)


def leading_year(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"^(\d{4})", 1)


def months(begin: Column, end: Column) -> Column:
    """First days of the months from one date to another; reversed bounds are swapped."""
    return F.sequence(F.trunc(F.least(begin, end), "month"), F.trunc(F.greatest(begin, end), "month"), F.expr("interval 1 month"))

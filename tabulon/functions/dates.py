"""Months as 'yyyy-MM' strings, strict dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def first_day(month: Column) -> Column:
    return F.to_date(F.concat(month, F.lit("-01")))


def add_months(month: Column, n: Column | int) -> Column:
    return F.date_format(F.add_months(first_day(month), n), "yyyy-MM")


def months_between(a: Column, b: Column) -> Column:
    """All months from a to b."""
    return F.transform(F.sequence(first_day(a), first_day(b), F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyy-MM"))


def strict_date(text: Column) -> Column:
    """yyyy-MM-dd, yyyy.MM.dd. or an ISO time to a date; NULL if it is none or not in the calendar."""
    iso = F.regexp_replace(F.regexp_extract(text, r"^(\d{4}[-.]\d{2}[-.]\d{2})(?:\.?|T[0-9:.Z+-]*)\z", 1), r"\.", "-")
    return F.when(iso != "", F.try_to_date(iso, "yyyy-MM-dd"))

"""Date rules. Every parse yields NULL on bad input; nothing raises under ANSI."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_of_column(as_of: dt.date | Column | str) -> Column:
    """A declared run date: a literal, or a column when rows carry their own."""
    if isinstance(as_of, Column):
        return as_of
    return F.lit(as_of).cast("date")


def strip(text: Column) -> Column:
    """Without white space at either end. A character trim: no pattern runs per row."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def iso_date(text: Column) -> Column:
    """The first ten characters as an ISO day, else NULL."""
    head = F.substring(text, 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


def deed_date(text: Column, as_of) -> Column:
    """YYMMDD or an exact ISO day.

    The century turns at the run year plus one: a two-digit year up to that is
    in the 2000s, anything above is in the 1900s.
    """
    raw = strip(text)
    short = raw.rlike(r"^\d{6}$")
    pivot = F.year(as_of_column(as_of)) % 100 + 1
    two_digit = F.when(short, F.substring(raw, 1, 2).try_cast("int"))
    century = F.when(two_digit <= pivot, F.lit("20")).otherwise(F.lit("19"))
    return (
        F.when(short, F.try_to_date(F.concat(century, raw), "yyyyMMdd"))
        .when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(raw, "yyyy-MM-dd"))
    )


def us_date(text: Column) -> Column:
    """M/d/yyyy with one or two digits for month and day."""
    raw = strip(text)
    return F.when(raw.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(raw, "M/d/yyyy"))


def whole_years(start: Column, end: Column) -> Column:
    """Completed calendar years from `start` to `end`."""
    not_yet = (F.month(end) * 100 + F.dayofmonth(end)) < (F.month(start) * 100 + F.dayofmonth(start))
    return F.year(end) - F.year(start) - F.when(not_yet, 1).otherwise(0)


def years_back(day: Column, years: int) -> Column:
    """The same day `years` earlier; 29 February becomes 28 February."""
    return F.add_months(day, -12 * years)


def within_days(day: Column, as_of, days: int) -> Column:
    """Inclusive at both ends; NULL days are outside."""
    end = as_of_column(as_of)
    return F.coalesce(day.between(F.date_sub(end, days), end), F.lit(False))

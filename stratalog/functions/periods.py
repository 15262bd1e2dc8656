"""Calendar keys over string dates (``YYYY-MM-DD``)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stratalog.functions.text import col


def as_date(c: str | Column) -> Column:
    """The date, or null for anything that is not exactly ``YYYY-MM-DD``."""
    s = col(c)
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(s, F.lit("yyyy-MM-dd"))
                  .cast("date"))


def date_text(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")


def epoch_day(c: str | Column) -> Column:
    return F.unix_date(as_date(c)).cast("long")


def iso_week_key(c: str | Column) -> Column:
    d = as_date(c)
    week = F.lpad(F.weekofyear(d).cast("string"), 2, "0")
    return F.concat(F.date_part(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-W"), week)


def week_monday(c: str | Column) -> Column:
    return date_text(F.date_trunc("week", as_date(c)))


def month_key(c: str | Column) -> Column:
    return F.substring(col(c), 1, 7)


def year_key(c: str | Column) -> Column:
    return F.substring(col(c), 1, 4)


def store_month(date: str = "date") -> Column:
    """The month partition of an entry; what is no date goes to one partition, ``other``."""
    return F.when(F.col(date).rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])"), month_key(date)).otherwise(F.lit("other"))

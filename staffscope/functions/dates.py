"""Dates with three outcomes, closed intervals and calendar-month gaps."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, functions as F

from ..schema import DAYS_PER_MONTH
from .text import trim_unicode

ABSENT, INVALID, VALUE = "absent", "invalid", "value"
_DAY = r"^\d{4}[-/]\d{2}[-/]\d{2}(?:[ T].*)?$"


def parse_date(col: Column) -> Column:
    """struct<value date, state string>: a missing date, an unreadable one and a day are kept apart."""
    text = F.coalesce(trim_unicode(col), F.lit(""))
    day = F.replace(F.substring(text, 1, 10), F.lit("/"), F.lit("-"))
    readable = text.rlike(_DAY) & (F.substring(text, 1, 4) >= "0100")
    value = F.when(readable, day.try_cast("date"))
    state = F.when(text == "", ABSENT).when(value.isNull(), INVALID).otherwise(VALUE)
    return F.struct(value.alias("value"), state.alias("state"))


def duration_months(start: Column, end: Column) -> Column:
    """Months of a closed interval, both ends included, at least one."""
    days = F.date_diff(end, start) + 1
    return F.greatest(F.lit(1), F.round(days / F.lit(DAYS_PER_MONTH)).cast("int"))


def month_number(col: Column) -> Column:
    return F.year(col) * 12 + F.month(col)


def gap_months(end: Column, now: date) -> Column:
    """Calendar months since `end`; an open interval has none."""
    months = F.lit(now.year * 12 + now.month) - month_number(end)
    return F.when(end.isNull(), 0).otherwise(F.greatest(F.lit(0), months))

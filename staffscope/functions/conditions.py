"""Forms for expressions whose usual spelling differs in Spark, for use inside conditions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def between_symmetric(col: Column, a: Column, b: Column) -> Column:
    return (col >= F.least(a, b)) & (col <= F.greatest(a, b))


def is_distinct(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def int_div(a: Column, b: Column) -> Column:
    """Integer division that truncates."""
    return ((a - a % b) / b).cast("long")


def days_between(a: Column, b: Column) -> Column:
    return F.date_diff(a, b)


def concat_present(*parts: Column) -> Column:
    """Concatenate, leaving NULL parts out."""
    return F.concat_ws("", *parts)


def contains_all(whole: Column, part: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0


def contained_in(part: Column, whole: Column) -> Column:
    return contains_all(whole, part)


def share_any(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)


def any_equals(col: Column, values: Column) -> Column:
    return F.array_contains(values, col)


def none_equals(col: Column, values: Column) -> Column:
    return ~F.array_contains(values, col)


def position_or_null(values: Column, value) -> Column:
    return F.nullif(F.array_position(values, value), F.lit(0))


def periods_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Whether two periods share a moment. Reversed ends are swapped; equal starts always overlap."""
    ordered = lambda s, e: (F.when(e < s, e).otherwise(s), F.when(e < s, s).otherwise(e))
    (s1, e1), (s2, e2) = ordered(s1, e1), ordered(s2, e2)
    return (s1 == s2) | ((s1 < e2) & (s2 < e1))


def age_months(a: Column, b: Column) -> Column:
    """Whole months from `b` to `a`."""
    return F.floor(F.months_between(a, b)).cast("int")


def string_agg(col: Column, separator: str, *order: Column) -> Column:
    """The texts that are there, by `order` or else by themselves."""
    if not order:
        return F.array_join(F.array_sort(F.collect_list(col)), separator)
    keyed = F.struct(*[part.alias(f"by{at}") for at, part in enumerate(order)], col.alias("text"))
    listed = F.sort_array(F.collect_list(F.when(col.isNotNull(), keyed)))
    return F.array_join(F.transform(listed, lambda row: row["text"]), separator)


def regex_ci(col: Column, pattern: str) -> Column:
    return col.rlike("(?iu)" + pattern)

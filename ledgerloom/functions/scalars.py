"""Scalar expressions shared by the staging, feature and summary layers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def money(value: Column | str) -> Column:
    """Dollar text such as ``$-1,234.50`` as an exact decimal; NULL when malformed."""
    return F.regexp_replace(col(value), "[$,]", "").try_cast(MONEY)


def dollars(value: Column | str) -> Column:
    """Dollar text as a double; NULL when malformed."""
    return F.regexp_replace(col(value), "[$,]", "").try_cast("double")


def flag(condition: Column) -> Column:
    """1 where the condition is true, else 0 (also for NULL)."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def blank_to_null(value: Column | str) -> Column:
    return F.nullif(F.trim(col(value)), F.lit(""))


def clean_zip(value: Column | str) -> Column:
    """``58523.0`` -> ``58523``; NULL when not a number."""
    return col(value).try_cast("double").try_cast("bigint").cast("string")


def mentions(value: Column | str, phrase: str) -> Column:
    """Case-insensitive containment that is false for NULL."""
    return F.lower(F.coalesce(col(value), F.lit(""))).contains(phrase.lower())


def part(value: Column | str, position: int) -> Column:
    """The 1-based ``/``-separated part as an integer, NULL when absent or not a number."""
    return F.try_element_at(F.split(col(value), "/"), F.lit(position)).try_cast("int")


def first_of_month(month_year: Column | str) -> Column:
    """``MM/YYYY`` -> date of the first of that month, NULL when malformed."""
    month, year = part(month_year, 1), part(month_year, 2)
    return F.when(month.between(1, 12) & year.between(1, 9999), F.make_date(year, month, F.lit(1)))


def epoch_seconds(timestamp: Column | str) -> Column:
    """Whole seconds since 1970 (UTC session), sub-seconds floored."""
    return F.unix_seconds(col(timestamp).cast("timestamp"))


def ratio(numerator: Column, denominator: Column, default: float = 0.0) -> Column:
    """numerator / denominator where the denominator is positive, else the default."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(default))


def at_least(value: Column, floor: float) -> Column:
    """Clip from below, keeping NULL (``greatest`` would turn NULL into the floor)."""
    return F.when(value < floor, F.lit(floor)).otherwise(value)


def sigmoid(raw: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-raw))


def as_currency(value: Column) -> Column:
    return F.format_string("$%,.2f", F.abs(value).cast("double"))


def as_percent(value: Column) -> Column:
    return F.format_string("%.1f%%", value.cast("double"))


def week_ending_sunday(timestamp: Column) -> Column:
    """The Sunday on or after the day."""
    return F.next_day(F.date_sub(timestamp.cast("date"), 1), "SU")


def exact_mean(total: Column, count: Column) -> Column:
    """Mean from an exact total, so the result does not depend on summation order."""
    return F.when(count > 0, total.cast("double") / count)

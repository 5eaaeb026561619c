"""Metric expressions: pure ``Column -> Column`` functions over built-ins.

Ratios divide two exact integers once, as doubles. IEEE division is correctly
rounded, so a ratio that is exactly a threshold compares equal to it, no
decimal object is allocated per row and the expression stays in generated code.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

AsOf = dt.date | str | Column


def as_of_date(as_of: AsOf) -> Column:
    """The reporting date as a date column."""
    if isinstance(as_of, Column):
        return as_of.cast("date")
    return F.lit(str(as_of)).cast("date")


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` as double, null unless the denominator is positive."""
    return F.when(
        denominator > 0, numerator.cast("double") / denominator.cast("double")
    )


def ctr_fraction(clicks: Column, impressions: Column) -> Column:
    """Clicks per impression, null without impressions."""
    return safe_ratio(clicks, impressions)


def ctr_percent(clicks: Column, impressions: Column) -> Column:
    """Clicks per hundred impressions, null without impressions."""
    return safe_ratio(clicks * 100, impressions)


def ctr_percent_rounded(clicks: Column, impressions: Column) -> Column:
    """Percent CTR as ``decimal(10,4)``, rounded half-up, 0 without impressions."""
    zero = F.lit(0).cast("decimal(10,4)")
    percent = (clicks * 100).cast("decimal(20,0)") / impressions.cast("decimal(18,0)")
    return F.when(impressions > 0, F.round(percent, 4).cast("decimal(10,4)")).otherwise(zero)


def window_days(start: Column, end: Column) -> Column:
    """Inclusive length of the schedule window; null if a date is null."""
    return F.datediff(end, start) + 1


def schedule_days(start: Column, end: Column) -> Column:
    """Inclusive schedule length, only where the end lies after the start."""
    return F.when(end > start, window_days(start, end))


def days_elapsed(start: Column, end: Column, as_of: AsOf) -> Column:
    """Schedule days passed by ``as_of``: at least 0, at most up to the end date."""
    reached = F.least(as_of_date(as_of), end)
    return F.when(
        start.isNotNull() & end.isNotNull(),
        F.greatest(F.lit(0), window_days(start, reached)),
    )


def per_day(amount: Column, start: Column, end: Column) -> Column:
    """``amount`` spread over the window by truncating integer division."""
    days = window_days(start, end)
    return F.when(
        days > 0,
        F.call_function("div", F.coalesce(amount, F.lit(0)).cast("bigint"), days),
    )


def schedule_pct_elapsed(elapsed: Column, days: Column) -> Column:
    """Fraction of the schedule that has passed."""
    return safe_ratio(elapsed, days)


def pct_of_goal(impressions: Column, goal: Column) -> Column:
    """Delivered impressions over the goal; missing delivery counts as 0."""
    return safe_ratio(F.coalesce(impressions, F.lit(0)), goal)


def pacing_index(
    actual_per_day: Column,
    target_per_day: Column,
    elapsed: Column,
    days: Column,
    goal: Column,
) -> Column:
    """Delivery pace over schedule pace; 0 wherever it is undefined.

    ``(actual / target) / (elapsed / days)`` is evaluated as the single
    division ``(actual * days) / (target * elapsed)``.
    """
    defined = (goal > 0) & (target_per_day > 0) & (elapsed > 0) & (days > 0)
    index = (actual_per_day.cast("double") * days) / (
        target_per_day.cast("double") * elapsed
    )
    return F.coalesce(F.when(defined, index), F.lit(0.0))


def half_even(value: Column, digits: int) -> Column:
    """Round a double half-even, scaling first, as numpy does."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def is_finite(value: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    infinite = F.abs(value) == F.lit(float("inf"))
    return F.coalesce(~F.isnan(value) & ~infinite, F.lit(False)) & value.isNotNull()

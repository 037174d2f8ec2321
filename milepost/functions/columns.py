"""Computed columns. Each takes and returns Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_CURRENCY = "N/A"


def profile_type(profile_class: Column, personal_class: str) -> Column:
    """Personal or Business; an unknown or missing class counts as Business."""
    return F.when(profile_class == personal_class, "Personal").otherwise("Business")


def cohort_month(created: Column) -> Column:
    return F.trunc(created, "month").cast("timestamp_ntz")


def cohort_week(created: Column) -> Column:
    """Monday of the week. ``trunc`` works on dates, so no time zone is involved."""
    return F.trunc(created, "week").cast("timestamp_ntz")


def event_id_text(identifier: Column) -> Column:
    return identifier.cast("string")


def suffixed_id(identifier: Column) -> Column:
    """The id followed by 9999, which keeps it apart from the same id in a sibling stage."""
    return F.concat(identifier.cast("string"), F.lit("9999"))


def time_text(moment: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss.SSS``, free of the session time zone."""
    text = moment.cast("string")
    return F.rpad(F.concat(F.substring(text, 1, 19), F.lit("."), F.substring(text, 21, 3)), 23, "0")


def id_with_time(identifier: Column, moment: Column) -> Column:
    """Null if either part is null."""
    return F.concat(identifier.cast("string"), time_text(moment))


def id_with_time_and_days(identifier: Column, moment: Column, days: Column) -> Column:
    """Null if any part is null; such an event is a row but is not counted in reports."""
    return F.concat(identifier.cast("string"), time_text(moment), days.cast("string"))


def verified_time(completed: Column, initiated: Column) -> Column:
    return F.coalesce(completed, initiated)


def days_after(moment: Column, days: int | Column) -> Column:
    """``moment`` plus a constant or a per-row number of days."""
    return F.timestamp_add("DAY", F.lit(days) if isinstance(days, int) else days, moment)

"""Conversion report of a funnel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from milepost.operators.stages import PROFILE_CREATED


def of_event(funnel: DataFrame, event: str) -> DataFrame:
    """The rows of one stage. Of a table published by event, only that event's files are read."""
    return funnel.where(F.col("event") == event)


def event_counts(funnel: DataFrame) -> DataFrame:
    """Non-null event ids per event."""
    return funnel.groupBy("event").agg(F.count("event_id").alias("event_count"))


def profile_base(funnel: DataFrame) -> DataFrame:
    """Non-null event ids of the first step. Any rows with those of the first step will do: a funnel, or that stage alone."""
    return (
        of_event(funnel, PROFILE_CREATED)
        .agg(F.count("event_id").alias("event_count"))
        .select(F.lit(PROFILE_CREATED).alias("event"), "event_count")
    )


def percent_of_base(counts: DataFrame) -> DataFrame:
    """Counts as a percentage of the first step's; null where that is absent or zero.

    The base is taken from the counts themselves, one row per event label, so
    the funnel is read once and the window has a handful of rows.
    """
    is_base = F.col("event") == PROFILE_CREATED
    base = F.max(F.when(is_base, F.col("event_count"))).over(Window.partitionBy())
    percent = F.lit(100.0) * F.col("event_count") / F.nullif(base, F.lit(0))
    return counts.select("event", "event_count", F.round(percent, 4).alias("pct_of_profiles"))


def conversion(funnel: DataFrame) -> DataFrame:
    """Count and share of the first step per event, ordered by event."""
    return percent_of_base(event_counts(funnel)).orderBy("event")

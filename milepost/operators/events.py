"""Events in a fact table, and the first of them per key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True, eq=False)
class Event:
    """Which rows of a fact table are events, and where their parts are. Some events have no currency."""

    date: Column
    event_id: Column
    currency: Column | None = None
    when: Column | None = None

    def counts(self) -> Column:
        """The row is an event with a known date."""
        dated = self.date.isNotNull()
        return dated if self.when is None else self.when & dated

    def value(self) -> Column:
        """Struct that sorts by date, then id, then currency."""
        parts = [self.date.alias("date"), self.event_id.alias("event_id")]
        if self.currency is not None:
            parts.append(self.currency.alias("currency"))
        return F.struct(*parts)


def _values(events: Mapping[str, Event]) -> dict[str, Column]:
    """The events' structs for rows that have at least one of them, null where a row lacks one."""
    if len(events) == 1:
        return {name: event.value() for name, event in events.items()}
    return {name: F.when(event.counts(), event.value()) for name, event in events.items()}


def _any(events: Mapping[str, Event]) -> Column:
    return reduce(or_, [event.counts() for event in events.values()])


def all_events(facts: DataFrame, keys: Sequence[str], events: Mapping[str, Event]) -> DataFrame:
    """Every fact row with an event, one struct column per named event."""
    return facts.where(_any(events)).select(*keys, *[value.alias(name) for name, value in _values(events).items()])


def first_events(facts: DataFrame, keys: Sequence[str], events: Mapping[str, Event]) -> DataFrame:
    """One row per key, one struct column per named event holding its earliest occurrence.

    The minimum of a struct combines on the map side: what is shuffled is at
    most one row per key and map task, however many rows a key has, and all
    named events of the table come out of the same scan and shuffle.
    """
    return (
        facts.where(_any(events))
        .groupBy(*keys)
        .agg(*[F.min(value).alias(name) for name, value in _values(events).items()])
    )


def earliest(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """First events of a coarser key, from first events already found for a finer one."""
    return df.groupBy(*keys).agg(*[F.min(name).alias(name) for name in names])

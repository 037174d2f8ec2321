"""Small source tables and row comparison."""

from __future__ import annotations

from collections import Counter
from datetime import datetime
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from milepost.config import PERSONAL_CLASS, PRIMARY_ADDRESS_TYPE
from milepost.schemas import SOURCE_SCHEMAS
from milepost.sources import Sources

P = 1
ACCOUNT = 100


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def profile(created: str = "2020-02-01", identifier: int = P, kind: str | None = PERSONAL_CLASS) -> tuple:
    return (identifier, at(created), kind)


def address(identifier: int = P, country: str = "GB", kind: str = PRIMARY_ADDRESS_TYPE) -> tuple:
    return (identifier, kind, country)


def order(
    identifier: int,
    started: str | None,
    completed: str | None = None,
    issued: str | None = None,
    status: str = "DONE",
    currency: str = "GBP",
    profile_id: int = P,
) -> tuple:
    times = [None if text is None else at(text) for text in (started, completed, issued)]
    return (identifier, profile_id, currency, times[0], times[1], status, issued is not None, times[2])


def action(identifier: int, source: str, target: str, day: str = "2020-02-05", ok: int = 1, flag: int = 1) -> tuple:
    return (identifier, P, at(day), source, target, ok, "BALANCE", flag)


def make_sources(spark: SparkSession, **tables: list[tuple]) -> Sources:
    """Sources with the given rows. Without any, there is profile P with one primary address and an account."""
    rows = {"user_profile": [profile()], "address": [address()], "account": [(ACCOUNT, P)], **tables}
    return Sources.of(
        {name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in SOURCE_SCHEMAS.items()}
    )


def bag(df: DataFrame) -> Counter:
    columns = sorted(df.columns)
    return Counter(tuple(row[name] for name in columns) for row in df.collect())


@lru_cache(maxsize=4)
def _collected(df: DataFrame) -> list:
    return df.collect()


def at_stage(df: DataFrame, prefix: str) -> list[dict]:
    """Rows of the events whose label starts with ``prefix``, by date and id."""
    rows = [row.asDict() for row in _collected(df) if row.event.startswith(prefix)]
    return sorted(rows, key=lambda row: (row["date"], str(row["event_id"]), row["currency"]))

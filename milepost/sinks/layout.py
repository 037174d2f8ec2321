"""Source tables laid out by the keys the funnels aggregate and join on."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from milepost.operators.hot_keys import hot_keys
from milepost.sinks.publish import publish_replace
from milepost.sources import Sources

#: What each table is bucketed by: tables on profiles by the profile, tables on accounts by the account.
BUCKETED_BY = {
    "user_profile": "id",
    "address": "user_profile_id",
    "account": "id",
    "balance": "account_id",
    "balance_transaction": "account_id",
    "bank_details_order_status": "profile_id",
    "action_step": "user_profile_id",
    "receive_transactions": "profile_id",
    "card_issuance_summary": "user_id",
}


def spreads(df: DataFrame, key: str, buckets: int) -> bool:
    """No key, and no null, holds more than a bucket's share of the rows."""
    nulls, rows = df.agg(F.count_if(F.col(key).isNull()), F.count("*")).first()
    return nulls * buckets <= max(rows, buckets) and hot_keys(df, key, buckets).isEmpty()


def bucketed(sources: Sources, schema: str, buckets: int, prefix: str = "by_key") -> Sources:
    """The tables written as ``<schema>.<prefix>_<table>`` in buckets by BUCKETED_BY, and opened again.

    A first event per profile or account is then found without a shuffle, as its rows are in one bucket, and joins of such
    results meet without one. One task reads a bucket, so a table where a key holds more than a bucket's share is written
    without buckets; its plan shuffles first events, at most one row for each key and task, as ever. ``buckets`` is best about
    the largest table's size over that of a partition, and the same for all tables, as only equal numbers meet.

    Each table is replaced in one step, as by ``publish_replace``; a query that has begun goes on reading the earlier version.
    """
    opened = {}
    for field in fields(Sources):
        df, key = getattr(sources, field.name), BUCKETED_BY[field.name]
        layout = (key, buckets) if spreads(df, key, buckets) else None
        opened[field.name] = publish_replace(df, schema, f"{prefix}_{field.name}", bucket_by=layout)
    return Sources.of(opened)

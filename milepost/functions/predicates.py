"""Row conditions. Each returns a boolean Spark column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from milepost.functions.columns import days_after

# States, types and flags as the source tables spell them.
COMPLETED = "COMPLETED"
DEPOSIT = "DEPOSIT"
VERIFICATION_DONE = "DONE"
BALANCE_PRODUCT = "BALANCE"


def created_since(created: Column, start_date: str) -> Column:
    return created >= F.lit(start_date).cast("timestamp_ntz")


def is_primary(address_type: Column, primary_type: str) -> Column:
    return address_type == primary_type


def supported_currency(currency: Column, supported: Sequence[str]) -> Column:
    return currency.isin(*supported)


def is_verified(status: Column) -> Column:
    return status == VERIFICATION_DONE


def details_issued(issued: Column) -> Column:
    return issued


def completed_deposit(state: Column, kind: Column) -> Column:
    return (state == COMPLETED) & (kind == DEPOSIT)


def completed_non_deposit(state: Column, kind: Column) -> Column:
    """A missing type is neither a deposit nor a non-deposit."""
    return (state == COMPLETED) & (kind != DEPOSIT)


def successful_balance_action(successful: Column, product: Column) -> Column:
    return (successful == 1) & product.isin(BALANCE_PRODUCT)


def crosses_currency(source: Column, target: Column, flag: Column) -> Column:
    return (source != target) & (flag == 1)


def within_days(date: Column, created: Column, until: int | None, after: int | None = None) -> Column:
    """``date`` is known and strictly inside the window.

    There is no lower bound unless ``after`` is given: an event older than the
    profile counts.
    """
    inside = date.isNotNull()
    if after is not None:
        inside = inside & (date > days_after(created, after))
    if until is not None:
        inside = inside & (date < days_after(created, until))
    return inside

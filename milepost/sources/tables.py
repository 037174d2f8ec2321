"""The nine input tables of the funnels."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from milepost.schemas import SOURCE_SCHEMAS, conform

# The catalog names under which the inputs are kept.
CATALOG_NAMES = {
    "user_profile": "profile.user_profile",
    "address": "profile.address",
    "account": "balance.account",
    "balance": "balance.balance",
    "balance_transaction": "balance.transaction",
    "bank_details_order_status": "reports.report_fc_bank_details_order_status",
    "action_step": "reports.report_action_step",
    "receive_transactions": "reports.receive_transactions",
    "card_issuance_summary": "reports.profile_card_issuance_summary",
}


@dataclass(frozen=True)
class Sources:
    """Input tables, each cut to the columns the funnels use."""

    user_profile: DataFrame
    address: DataFrame
    account: DataFrame
    balance: DataFrame
    balance_transaction: DataFrame
    bank_details_order_status: DataFrame
    action_step: DataFrame
    receive_transactions: DataFrame
    card_issuance_summary: DataFrame

    @classmethod
    def of(cls, tables: Mapping[str, DataFrame]) -> Sources:
        """Check the given tables against their contracts."""
        names = [field.name for field in fields(cls)]
        missing = [name for name in names if name not in tables]
        if missing:
            raise ValueError(f"missing source tables: {', '.join(missing)}")
        return cls(**{name: conform(tables[name], SOURCE_SCHEMAS[name], name) for name in names})

    @classmethod
    def from_catalog(cls, spark: SparkSession, names: Mapping[str, str] | None = None) -> Sources:
        """Read the tables from the session's catalog; ``names`` overrides single entries."""
        return cls.of({key: spark.table(name) for key, name in {**CATALOG_NAMES, **(names or {})}.items()})

    @classmethod
    def from_parquet(cls, spark: SparkSession, paths: Mapping[str, str]) -> Sources:
        """Read the tables from parquet files or folders."""
        return cls.of({key: spark.read.parquet(path) for key, path in paths.items()})

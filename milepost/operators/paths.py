"""Joins from the cohort to each fact table.

Where the cohort's keys are few they can be given, and facts of others are left out where they are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from milepost.config import FunnelConfig
from milepost.functions.predicates import successful_balance_action
from milepost.operators.cohort import cohort, of_keys
from milepost.operators.hot_keys import join_many_to_one, join_split
from milepost.sources import Sources


def accounts(sources: Sources) -> DataFrame:
    return sources.account.select(F.col("id").alias("account_id"), "profile_id")


def balances(sources: Sources) -> DataFrame:
    return sources.balance.withColumnRenamed("id", "balance_id")


def transactions(sources: Sources) -> DataFrame:
    return sources.balance_transaction.withColumnRenamed("id", "transaction_id")


def account_currency(sources: Sources) -> DataFrame:
    """One row per account that has a balance, with its smallest currency.

    A transaction belongs to an account, not to a balance. Joining it to all
    balances of the account would multiply it only for one row to be kept.
    """
    return sources.balance.groupBy("account_id").agg(F.min("currency").alias("currency"))


def account_holders(sources: Sources, cfg: FunnelConfig) -> DataFrame:
    """Cohort rows with their accounts."""
    return join_split(accounts(sources), cohort(sources, cfg), "profile_id")


def balance_path(sources: Sources, cfg: FunnelConfig, of_accounts: DataFrame | None = None) -> DataFrame:
    """Cohort, account, balance."""
    return account_holders(sources, cfg).join(of_keys(balances(sources), "account_id", of_accounts), "account_id")


def transaction_path(sources: Sources, cfg: FunnelConfig) -> DataFrame:
    """Cohort, account, transaction, with the account's smallest currency."""
    holders = account_holders(sources, cfg).join(account_currency(sources), "account_id")
    return join_split(transactions(sources), holders, "account_id")


def order_path(sources: Sources, cfg: FunnelConfig, of_profiles: DataFrame | None = None) -> DataFrame:
    """Cohort, bank-detail order."""
    return join_split(of_keys(sources.bank_details_order_status, "profile_id", of_profiles), cohort(sources, cfg), "profile_id")


def receipt_path(sources: Sources, cfg: FunnelConfig) -> DataFrame:
    """Cohort, incoming transfer."""
    return join_split(sources.receive_transactions, cohort(sources, cfg), "profile_id")


def card_path(sources: Sources, cfg: FunnelConfig, of_profiles: DataFrame | None = None) -> DataFrame:
    """Cohort, card summary.

    Cards are found by user id. The summary's own profile id differs from it
    and only goes into event ids.
    """
    cards = sources.card_issuance_summary.withColumnsRenamed({"profile_id": "card_profile_id", "user_id": "profile_id"})
    return join_split(of_keys(cards, "profile_id", of_profiles), cohort(sources, cfg), "profile_id")


def action_path(sources: Sources, cfg: FunnelConfig) -> DataFrame:
    """Cohort, account, and the account holder's successful balance actions or a null where there are none.

    A left join whose right side may be skewed, so hot profiles' actions are dealt over several parts.
    """
    actions = sources.action_step.where(
        successful_balance_action(F.col("successful_action"), F.col("product_type"))
    ).withColumnRenamed("user_profile_id", "profile_id")
    return join_many_to_one(actions, account_holders(sources, cfg), "profile_id", "action_id", unmatched=True)

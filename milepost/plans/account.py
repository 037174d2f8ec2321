"""The account funnel: from sign-up to money received on own bank details."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from milepost.config import ACCOUNT_DEFAULTS, FunnelConfig
from milepost.functions.columns import suffixed_id, verified_time
from milepost.functions.predicates import (
    crosses_currency,
    details_issued,
    is_verified,
    successful_balance_action,
    supported_currency,
)
from milepost.operators.cohort import account_keys, cohort, cohort_keys, cohort_profiles, of_keys
from milepost.operators.events import Event, all_events, earliest, first_events
from milepost.operators.paths import accounts, balances
from milepost.operators.stages import Stage, stage_rows, start_rows, union_stages
from milepost.schemas import ACCOUNT_FUNNEL_SCHEMA
from milepost.sources import Sources


def stages(cfg: FunnelConfig) -> dict[str, Stage]:
    """Stages after the first, by key. Labels are fixed values."""
    days = cfg.window_days
    return {
        "account_2_balance_opened": Stage("2. BALANCE_OPENED", "opened", days),
        "account_3_balance_opened_ccy": Stage(
            "3. BALANCE_OPENED_CCY_WITH_ACC_DETAILS", "opened_supported", days, id_text=suffixed_id
        ),
        "account_4_bank_detail_requested": Stage("4. BANK_DETAIL_REQUESTED", "requested", days),
        "account_5_verified": Stage("5. VERIFIED", "verified", days),
        "account_6_bank_details_issued": Stage("6. BANK DETAILS ISSUED", "issued", days, id_text=suffixed_id),
        "account_7_cross_ccy_tx": Stage("7. PERFORMED_CROSS_CCY_TX", "exchanged", days),
        "account_8_received_to_details": Stage("8. RECEIVED_TO_DETAILS", "received", days),
    }


def balance_events(cfg: FunnelConfig) -> dict[str, Event]:
    opened = Event(F.col("creation_time"), F.col("balance_id"), F.col("currency"))
    supported = supported_currency(F.col("currency"), cfg.supported_currencies)
    return {
        "opened": opened,
        "opened_supported": Event(opened.date, opened.event_id, opened.currency, supported),
    }


def order_events(cfg: FunnelConfig) -> dict[str, Event]:
    order, currency = F.col("order_id"), F.col("currency")
    started = F.col("bankdetail_initiation_time")
    supported = supported_currency(currency, cfg.supported_currencies)
    return {
        "requested": Event(started, order, currency, supported),
        "verified": Event(
            verified_time(F.col("verification_completion_time"), started),
            order,
            currency,
            supported & is_verified(F.col("verification_status")),
        ),
        "issued": Event(
            F.col("bankdetail_issuance_time"),
            order,
            currency,
            supported & details_issued(F.col("bank_details_issued")),
        ),
    }


def action_events(cfg: FunnelConfig) -> dict[str, Event]:
    """Filtered on the source currency, reported with the target currency."""
    source, target = F.col("source_currency"), F.col("target_currency")
    return {
        "exchanged": Event(
            F.col("action_completion_time"),
            F.col("action_id"),
            target,
            successful_balance_action(F.col("successful_action"), F.col("product_type"))
            & crosses_currency(source, target, F.col("flag_for_aggregations"))
            & supported_currency(source, cfg.supported_currencies),
        )
    }


def receipt_events(cfg: FunnelConfig) -> dict[str, Event]:
    currency = F.col("bank_detail_currency")
    return {
        "received": Event(
            F.col("receival_date"),
            F.col("request_id"),
            currency,
            supported_currency(currency, cfg.supported_currencies),
        )
    }


# Each takes the keys of the profiles or accounts that are asked for, if they are few; facts of others are not read further.


def first_balances(sources: Sources, cfg: FunnelConfig, of_accounts: DataFrame | None = None) -> DataFrame:
    """First balances of a profile: per account first, then over its accounts."""
    events = balance_events(cfg)
    per_account = first_events(of_keys(balances(sources), "account_id", of_accounts), ["account_id"], events)
    return earliest(accounts(sources).join(per_account, "account_id"), ["profile_id"], list(events))


def first_orders(sources: Sources, cfg: FunnelConfig, of_profiles: DataFrame | None = None) -> DataFrame:
    orders = of_keys(sources.bank_details_order_status, "profile_id", of_profiles)
    return first_events(orders, ["profile_id"], order_events(cfg))


def first_actions(sources: Sources, cfg: FunnelConfig, of_profiles: DataFrame | None = None) -> DataFrame:
    """First currency exchange of a profile that has an account.

    Actions and accounts go through one aggregation, where accounts only leave a mark.
    """
    actions = sources.action_step.withColumnRenamed("user_profile_id", "profile_id")
    found = all_events(of_keys(actions, "profile_id", of_profiles), ["profile_id"], action_events(cfg))
    holders = of_keys(accounts(sources).select("profile_id"), "profile_id", of_profiles)
    marked = found.withColumn("has_account", F.lit(False)).unionByName(
        holders.withColumn("has_account", F.lit(True)), allowMissingColumns=True
    )
    per_profile = marked.groupBy("profile_id").agg(F.min("exchanged").alias("exchanged"), F.max("has_account").alias("has_account"))
    return per_profile.where("has_account AND exchanged IS NOT NULL").drop("has_account")


def first_receipts(sources: Sources, cfg: FunnelConfig, of_profiles: DataFrame | None = None) -> DataFrame:
    """First receipt of a profile in each currency."""
    keys = ["profile_id", "bank_detail_currency"]
    return first_events(of_keys(sources.receive_transactions, "profile_id", of_profiles), keys, receipt_events(cfg))


# Facts with one row per profile; receipts have one per profile and currency.
_PER_PROFILE = {
    "opened": first_balances,
    "opened_supported": first_balances,
    "requested": first_orders,
    "verified": first_orders,
    "issued": first_orders,
    "exchanged": first_actions,
}


def account_stage(key: str, sources: Sources, cfg: FunnelConfig = ACCOUNT_DEFAULTS) -> DataFrame:
    """The rows of one stage."""
    if key == "account_1_profile_created":
        return start_rows(cohort(sources, cfg), ACCOUNT_FUNNEL_SCHEMA, cfg)
    stage = stages(cfg)[key]
    firsts = _PER_PROFILE.get(stage.event, first_receipts)(sources, cfg)
    joined = cohort_profiles(sources, cfg).join(firsts, "profile_id")
    return stage_rows(joined, [stage], ACCOUNT_FUNNEL_SCHEMA, cfg)


def account_funnel(sources: Sources, cfg: FunnelConfig = ACCOUNT_DEFAULTS) -> DataFrame:
    """All eight stages. Each fact table is scanned and shuffled once; of a small cohort only its facts are shuffled."""
    profiles = cohort_profiles(sources, cfg)
    few = cohort_keys(sources, cfg)
    per_profile = [stage for stage in stages(cfg).values() if stage.event in _PER_PROFILE]
    per_currency = [stage for stage in stages(cfg).values() if stage.event not in _PER_PROFILE]
    wide = (
        profiles.join(first_balances(sources, cfg, account_keys(sources, few)), "profile_id", "left")
        .join(first_orders(sources, cfg, few), "profile_id", "left")
        .join(first_actions(sources, cfg, few), "profile_id", "left")
    )
    return union_stages(
        [
            start_rows(cohort(sources, cfg), ACCOUNT_FUNNEL_SCHEMA, cfg),
            stage_rows(wide, per_profile, ACCOUNT_FUNNEL_SCHEMA, cfg),
            stage_rows(
                profiles.join(first_receipts(sources, cfg, few), "profile_id"), per_currency, ACCOUNT_FUNNEL_SCHEMA, cfg
            ),
        ]
    )

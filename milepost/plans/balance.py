"""The balance funnel: opening, topping up and using balances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from milepost.config import BALANCE_DEFAULTS, FunnelConfig
from milepost.functions.columns import verified_time
from milepost.functions.predicates import completed_deposit, completed_non_deposit, is_verified
from milepost.operators.cohort import COHORT_COLUMNS, account_keys, cohort, cohort_keys, cohort_profiles, of_keys
from milepost.operators.events import Event, all_events, earliest, first_events
from milepost.operators.paths import accounts, balance_path, balances, order_path, transactions
from milepost.operators.stages import Stage, stage_rows, start_rows, union_stages
from milepost.schemas import COHORT_FUNNEL_SCHEMA
from milepost.sources import Sources


def stages(cfg: FunnelConfig) -> dict[str, Stage]:
    """Stages after the first, by key. Labels are fixed values."""
    days = cfg.window_days
    after, until = cfg.late_window
    return {
        "balance_2_balance_opened": Stage("2. BALANCE_OPENED", "opened", days),
        "balance_3_topped_up": Stage("3. TOPPED UP", "deposited", days),
        "balance_4_verified": Stage("4. VERIFIED", "verified", days),
        "balance_4_ccy_tx_30d": Stage("4. CCY TX WITHIN 30 DAYS", "used", days),
        "balance_5_ccy_tx_90d": Stage("5. CCY TX WITHIN 90 DAYS (EXCL DEPOSIT)", "used", until, after),
    }


def opened_balances(sources: Sources, cfg: FunnelConfig, of_accounts: DataFrame | None = None) -> DataFrame:
    """Every balance of a cohort row; this stage keeps them all."""
    opened = Event(F.col("creation_time"), F.col("balance_id"), F.col("currency"))
    return all_events(balance_path(sources, cfg, of_accounts), COHORT_COLUMNS, {"opened": opened})


def verified_orders(sources: Sources, cfg: FunnelConfig, of_profiles: DataFrame | None = None) -> DataFrame:
    """Every verified order of a cohort row, in any currency; this stage keeps them all."""
    verified = Event(
        verified_time(F.col("verification_completion_time"), F.col("bankdetail_initiation_time")),
        F.col("order_id"),
        F.col("currency"),
        is_verified(F.col("verification_status")),
    )
    return all_events(order_path(sources, cfg, of_profiles), COHORT_COLUMNS, {"verified": verified})


def transaction_events() -> dict[str, Event]:
    date, identifier = F.col("creation_time"), F.col("transaction_id")
    state, kind = F.col("state"), F.col("type")
    return {
        "deposited": Event(date, identifier, when=completed_deposit(state, kind)),
        "used": Event(date, identifier, when=completed_non_deposit(state, kind)),
    }


def account_facts(sources: Sources, of_accounts: DataFrame | None = None) -> DataFrame:
    """One row per account that has a balance: its smallest currency, first deposit and first other transaction.

    Balances and transactions go through one aggregation.
    """
    events = transaction_events()
    found = all_events(of_keys(transactions(sources), "account_id", of_accounts), ["account_id"], events)
    opened = of_keys(balances(sources), "account_id", of_accounts).select("account_id", "currency", F.lit(True).alias("has_balance"))
    per_account = opened.unionByName(found.withColumn("has_balance", F.lit(False)), allowMissingColumns=True).groupBy("account_id")
    columns = [F.min("currency").alias("currency"), *[F.min(name).alias(name) for name in events]]
    return per_account.agg(*columns, F.max("has_balance").alias("has_balance")).where("has_balance").drop("has_balance")


def first_transactions(sources: Sources, cfg: FunnelConfig, of_accounts: DataFrame | None = None) -> DataFrame:
    """First deposit and first other transaction of a profile, shown in the account's currency.

    Reduced per account before anything is joined, so the joins see one row per account.
    """
    names = list(transaction_events())
    used = account_facts(sources, of_accounts).where(" OR ".join(f"{name} IS NOT NULL" for name in names))
    per_account = used.join(accounts(sources), "account_id")
    shown = [
        F.when(
            F.col(name).isNotNull(),
            Event(F.col(f"{name}.date"), F.col(f"{name}.event_id"), F.col("currency")).value(),
        ).alias(name)
        for name in names
    ]
    return earliest(per_account.select("profile_id", *shown), ["profile_id"], names)


def balance_stage(key: str, sources: Sources, cfg: FunnelConfig = BALANCE_DEFAULTS) -> DataFrame:
    """The rows of one stage."""
    if key == "balance_1_profile_created":
        return start_rows(cohort(sources, cfg), COHORT_FUNNEL_SCHEMA, cfg)
    stage = stages(cfg)[key]
    if stage.event == "opened":
        joined = opened_balances(sources, cfg)
    elif stage.event == "verified":
        joined = verified_orders(sources, cfg)
    else:
        joined = cohort_profiles(sources, cfg).join(first_transactions(sources, cfg), "profile_id")
    return stage_rows(joined, [stage], COHORT_FUNNEL_SCHEMA, cfg)


def balance_funnel(sources: Sources, cfg: FunnelConfig = BALANCE_DEFAULTS) -> DataFrame:
    """All six stages; the three on transactions share one scan and one ranking."""
    by_key = stages(cfg)
    few = cohort_keys(sources, cfg)
    of_accounts = account_keys(sources, few)
    on_transactions = [stage for stage in by_key.values() if stage.event in ("deposited", "used")]
    ranked = cohort_profiles(sources, cfg).join(first_transactions(sources, cfg, of_accounts), "profile_id")
    return union_stages(
        [
            start_rows(cohort(sources, cfg), COHORT_FUNNEL_SCHEMA, cfg),
            stage_rows(opened_balances(sources, cfg, of_accounts), [by_key["balance_2_balance_opened"]], COHORT_FUNNEL_SCHEMA, cfg),
            stage_rows(verified_orders(sources, cfg, few), [by_key["balance_4_verified"]], COHORT_FUNNEL_SCHEMA, cfg),
            stage_rows(ranked, on_transactions, COHORT_FUNNEL_SCHEMA, cfg),
        ]
    )

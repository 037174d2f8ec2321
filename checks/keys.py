"""One query per inventory key, on the sample tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from milepost.config import FunnelConfig
from milepost.functions import columns as C
from milepost.functions import predicates as P
from milepost.operators import paths
from milepost.operators.cohort import cohort, cohort_profiles, new_profiles, primary_addresses
from milepost.operators.stages import PROFILE_CREATED, union_stages
from milepost.plans import account, balance, card
from milepost.plans.conversion import conversion, event_counts, of_event, percent_of_base, profile_base
from milepost.sinks.publish import publish_replace, publish_staged_swap
from milepost.sources import Sources
from milepost.sources.star_adapter import START_DATE, star_sources

Query = Callable[[SparkSession, str], DataFrame]
Build = Callable[[Sources], DataFrame]

CONFIG = FunnelConfig(start_date=START_DATE)


def _on_sources(build: Build, fan_out: bool = False) -> Query:
    return lambda spark, directory: build(star_sources(spark, directory, fan_out))


def _scans() -> dict[str, Build]:
    keys = {
        "src_user_profile": "user_profile",
        "src_address": "address",
        "src_account": "account",
        "src_balance": "balance",
        "src_transaction": "balance_transaction",
        "src_bank_details_order": "bank_details_order_status",
        "src_action_step": "action_step",
        "src_receive_txn": "receive_transactions",
        "src_card_summary": "card_issuance_summary",
    }
    assert set(keys.values()) == {field.name for field in fields(Sources)}
    return {key: (lambda s, name=name: getattr(s, name)) for key, name in keys.items()}


def _column(table: str, identifier: str, key: str, value: Callable[[], Column]) -> Build:
    return lambda s: getattr(s, table).select(identifier, value().alias(key))


def _projections() -> dict[str, Build]:
    created = lambda: F.col("date_created")
    activated = lambda: F.col("first_activation_time")
    days = lambda: F.col("days_first_card_creation_to_five_transaction")
    profile, orders, cards = "user_profile", "bank_details_order_status", "card_issuance_summary"
    return {
        "proj_rename": lambda s: cohort(s, CONFIG).select(
            "profile_id",
            "country_code",
            "profile_date_created",
            F.col("profile_date_created").alias("date"),
        ),
        "proj_event_label": _column(profile, "id", "event_label", lambda: F.lit(PROFILE_CREATED)),
        "proj_na_currency": _column(profile, "id", "na_currency", lambda: F.lit(C.NO_CURRENCY)),
        "proj_profile_type": _column(
            profile, "id", "profile_type", lambda: C.profile_type(F.col("class"), CONFIG.personal_class)
        ),
        "proj_cohort_month": _column(profile, "id", "cohort_month", lambda: C.cohort_month(created())),
        "proj_cohort_week": _column(profile, "id", "cohort_week", lambda: C.cohort_week(created())),
        "proj_event_id_cast": _column("balance", "id", "event_id_cast", lambda: C.event_id_text(F.col("id"))),
        "proj_id_suffix": _column("balance", "id", "id_suffix", lambda: C.suffixed_id(F.col("id"))),
        "proj_id_with_time": _column(
            cards, "user_id", "id_with_time", lambda: C.id_with_time(F.col("profile_id"), F.col("first_card_order_time"))
        ),
        "proj_id_time_days": _column(
            cards,
            "user_id",
            "id_time_days",
            lambda: C.id_with_time_and_days(F.col("profile_id"), activated(), days()),
        ),
        "proj_verified_time": _column(
            orders,
            "order_id",
            "verified_time",
            lambda: C.verified_time(F.col("verification_completion_time"), F.col("bankdetail_initiation_time")),
        ),
        "proj_window_end": _column(
            profile, "id", "window_end", lambda: C.days_after(created(), CONFIG.window_days)
        ),
        "proj_five_tx_date": lambda s: paths.card_path(s, CONFIG).select(
            "profile_id", C.days_after(F.col("profile_date_created"), days()).alias("five_tx_date")
        ),
    }


def _filters() -> dict[str, Build]:
    created = lambda: F.col("profile_date_created")
    started = lambda: F.col("bankdetail_initiation_time")
    kind = lambda: (F.col("state"), F.col("type"))
    after, until = CONFIG.late_window
    return {
        "filter_cohort_start": lambda s: new_profiles(s, CONFIG).select("profile_id"),
        "filter_primary_address": lambda s: primary_addresses(s, CONFIG).select("profile_id"),
        "filter_supported_ccy": lambda s: s.balance.where(
            P.supported_currency(F.col("currency"), CONFIG.supported_currencies)
        ).select("id"),
        "filter_verified": lambda s: s.bank_details_order_status.where(
            P.is_verified(F.col("verification_status"))
        ).select("order_id"),
        "filter_details_issued": lambda s: s.bank_details_order_status.where(
            P.details_issued(F.col("bank_details_issued"))
        ).select("order_id"),
        "filter_txn_deposit": lambda s: s.balance_transaction.where(P.completed_deposit(*kind())).select("id"),
        "filter_txn_non_deposit": lambda s: s.balance_transaction.where(P.completed_non_deposit(*kind())).select("id"),
        "filter_successful_balance_action": lambda s: s.action_step.where(
            P.successful_balance_action(F.col("successful_action"), F.col("product_type"))
        ).select("action_id"),
        "filter_cross_ccy": lambda s: s.action_step.where(
            P.crosses_currency(F.col("source_currency"), F.col("target_currency"), F.col("flag_for_aggregations"))
        ).select("action_id"),
        "filter_event_date_present": lambda s: paths.order_path(s, CONFIG)
        .where(P.within_days(started(), created(), None))
        .select("profile_id", "order_id"),
        "filter_within_days": lambda s: paths.order_path(s, CONFIG)
        .where(P.within_days(started(), created(), CONFIG.window_days))
        .select("profile_id", "order_id"),
        "filter_between_days_exclusive": lambda s: paths.transaction_path(s, CONFIG)
        .where(P.within_days(F.col("creation_time"), created(), until, after))
        .select("profile_id", "transaction_id"),
    }


def _joins() -> dict[str, Build]:
    return {
        "join_cohort": lambda s: cohort(s, CONFIG).select("profile_id", "country_code"),
        "join_balance_path": lambda s: paths.balance_path(s, CONFIG).select("profile_id", "account_id", "balance_id"),
        "join_txn_path": lambda s: paths.transaction_path(s, CONFIG).select("profile_id", "transaction_id", "currency"),
        "join_bank_orders": lambda s: paths.order_path(s, CONFIG).select("profile_id", "order_id"),
        "join_action_left": lambda s: paths.action_path(s, CONFIG).select("profile_id", "account_id", "action_id"),
        "join_receipts": lambda s: paths.receipt_path(s, CONFIG).select("profile_id", "request_id"),
        "join_card_summary": lambda s: paths.card_path(s, CONFIG).select("profile_id", "card_profile_id"),
    }


def _firsts(
    find: Callable[[Sources, FunnelConfig], DataFrame],
    event: str,
    id_text: Callable[[Column], Column] = C.event_id_text,
) -> Build:
    return lambda s: (
        cohort_profiles(s, CONFIG)
        .join(find(s, CONFIG), "profile_id")
        .where(F.col(event).isNotNull())
        .select(
            "profile_id",
            F.col(f"{event}.date").alias("date"),
            id_text(F.col(f"{event}.event_id")).alias("event_id"),
            F.col(f"{event}.currency").alias("currency"),
        )
    )


def _rankings() -> dict[str, Build]:
    return {
        "first_balance": _firsts(account.first_balances, "opened"),
        "first_supported_balance": _firsts(account.first_balances, "opened_supported", C.suffixed_id),
        "first_bank_request": _firsts(account.first_orders, "requested"),
        "first_verified": _firsts(account.first_orders, "verified"),
        "first_issued": _firsts(account.first_orders, "issued", C.suffixed_id),
        "first_cross_ccy": _firsts(account.first_actions, "exchanged"),
        "first_receipt_per_ccy": _firsts(account.first_receipts, "received"),
        "first_deposit": _firsts(balance.first_transactions, "deposited"),
        "first_non_deposit": _firsts(balance.first_transactions, "used"),
    }


def _reports() -> dict[str, Build]:
    def funnel(s: Sources) -> DataFrame:
        return account.account_funnel(s, CONFIG)

    return {
        "agg_profile_base": lambda s: profile_base(account.account_stage("account_1_profile_created", s, CONFIG)),
        "agg_event_counts": lambda s: event_counts(funnel(s)),
        "agg_pct_of_base": lambda s: percent_of_base(event_counts(funnel(s))),
        "report_order": lambda s: conversion(funnel(s)),
        "account_conversion": lambda s: conversion(funnel(s)),
        "card_conversion": lambda s: conversion(card.card_funnel(s, CONFIG)),
    }


ACCOUNT_STAGES = (
    "account_1_profile_created",
    "account_2_balance_opened",
    "account_3_balance_opened_ccy",
    "account_4_bank_detail_requested",
    "account_5_verified",
    "account_6_bank_details_issued",
    "account_7_cross_ccy_tx",
    "account_8_received_to_details",
)
BALANCE_STAGES = (
    "balance_1_profile_created",
    "balance_2_balance_opened",
    "balance_3_topped_up",
    "balance_4_verified",
    "balance_4_ccy_tx_30d",
    "balance_5_ccy_tx_90d",
)
CARD_STAGES = (
    "card_1_profile_created",
    "card_2_ordered_30d",
    "card_3_issued_30d",
    "card_4_activated_60d",
    "card_5_five_tx_90d",
)


def _funnels() -> dict[str, Build]:
    single: dict[str, Build] = {}
    for names, build in (
        (ACCOUNT_STAGES, account.account_stage),
        (BALANCE_STAGES, balance.balance_stage),
        (CARD_STAGES, card.card_stage),
    ):
        single |= {key: (lambda s, key=key, build=build: build(key, s, CONFIG)) for key in names}
    return {
        **single,
        "union_stages": lambda s: union_stages(
            [account.account_stage(key, s, CONFIG).select("event", "event_id") for key in ACCOUNT_STAGES]
        ),
        "account_funnel": lambda s: account.account_funnel(s, CONFIG),
        "balance_funnel": lambda s: balance.balance_funnel(s, CONFIG),
        "card_funnel": lambda s: card.card_funnel(s, CONFIG),
    }


Write = Callable[[DataFrame, str, str], DataFrame]


def _replaced(df: DataFrame, schema: str, name: str) -> DataFrame:
    return publish_replace(df, schema, name, keep=0)


def _replaced_by_event(df: DataFrame, schema: str, name: str) -> DataFrame:
    return publish_replace(df, schema, name, partition_by=["event"], keep=0)


def _publish(key: str, write: Write, build: Build, then: Callable | None = None) -> Query:
    """Publishes a funnel and returns the table read back, or what `then` makes of it. One table for each key and folder,
    which the next call replaces.

    A swap renames to the table's own folder. Where the catalog ends with the session and the warehouse does not, that of an
    earlier session would be in the way, so tables that are swapped are also named after the session.
    """

    def query(spark: SparkSession, directory: str) -> DataFrame:
        session = spark.sparkContext.applicationId if write is publish_staged_swap else ""
        name = f"published_{key}_{zlib.crc32((directory + session).encode()):08x}"
        table = write(build(star_sources(spark, directory)), spark.catalog.currentDatabase(), name)
        return then(table) if then else table

    return query


def _sinks() -> dict[str, Query]:
    built = _funnels()
    return {
        "publish_replace": _publish("account", _replaced, built["account_funnel"]),
        "publish_balance_funnel": _publish("balance", _replaced, built["balance_funnel"]),
        "publish_staged_swap": _publish("card", publish_staged_swap, built["card_funnel"]),
        "published_account_conversion": _publish("account_report", _replaced_by_event, built["account_funnel"], conversion),
        "published_card_conversion": _publish("card_report", publish_staged_swap, built["card_funnel"], conversion),
        "published_profile_base": _publish("account_base", _replaced_by_event, built["account_funnel"], profile_base),
        "published_stage": _publish(
            "account_stage", _replaced_by_event, built["account_funnel"], lambda t: of_event(t, "6. BANK DETAILS ISSUED")
        ),
    }


#: Keys that are also asked with several accounts, addresses and cards per customer, as `fan_<key>`.
FAN_OUT_KEYS = (
    *("join_cohort", "join_balance_path", "join_txn_path", "join_action_left", "join_bank_orders", "join_card_summary"),
    *("first_balance", "first_supported_balance", "first_cross_ccy", "first_deposit", "first_non_deposit"),
    *("account_funnel", "balance_funnel", "card_funnel"),
)


def all_queries() -> dict[str, Query]:
    builds = {**_scans(), **_projections(), **_filters(), **_joins(), **_rankings(), **_reports(), **_funnels()}
    fans = {f"fan_{key}": _on_sources(builds[key], fan_out=True) for key in FAN_OUT_KEYS}
    return {**{key: _on_sources(build) for key, build in builds.items()}, **fans, **_sinks()}

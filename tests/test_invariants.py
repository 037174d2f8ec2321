"""Properties of the results that hold on any data."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from checks.keys import ACCOUNT_STAGES, BALANCE_STAGES, CARD_STAGES
from milepost.plans import account, balance, card
from milepost.plans.conversion import conversion
from milepost.schemas import ACCOUNT_FUNNEL_SCHEMA, COHORT_FUNNEL_SCHEMA, CONVERSION_SCHEMA

# Rows per event at scale 0.01: all rows, non-null ids, profiles.
EXPECTED = {
    "account": {
        "1. PROFILE_CREATED": (915, 915, 915),
        "2. BALANCE_OPENED": (167, 167, 167),
        "3. BALANCE_OPENED_CCY_WITH_ACC_DETAILS": (139, 139, 139),
        "4. BANK_DETAIL_REQUESTED": (220, 220, 220),
        "5. VERIFIED": (152, 152, 152),
        "6. BANK DETAILS ISSUED": (66, 66, 66),
        "7. PERFORMED_CROSS_CCY_TX": (111, 111, 111),
        "8. RECEIVED_TO_DETAILS": (270, 270, 168),
    },
    "balance": {
        "1. PROFILE_CREATED": (915, 915, 915),
        "2. BALANCE_OPENED": (173, 173, 167),
        "3. TOPPED UP": (71, 71, 71),
        "4. VERIFIED": (189, 189, 184),
        "4. CCY TX WITHIN 30 DAYS": (106, 106, 106),
        "5. CCY TX WITHIN 90 DAYS (EXCL DEPOSIT)": (206, 206, 206),
    },
    "card": {
        "1. PROFILE_CREATED": (915, 915, 915),
        "2. CARD ORDERED 30D": (243, 243, 243),
        "3. CARD ISSUED 30D": (179, 179, 179),
        "4. CARD ACTIVATED 60D": (260, 260, 260),
        "5. FIVE TX 90D": (577, 505, 577),
    },
}


@pytest.fixture(scope="module")
def funnels(sources_small, config):
    return {
        "account": account.account_funnel(sources_small, config),
        "balance": balance.balance_funnel(sources_small, config),
        "card": card.card_funnel(sources_small, config),
    }


@pytest.mark.parametrize("name", EXPECTED)
def test_counts_per_event(funnels, name):
    counted = funnels[name].groupBy("event").agg(F.count("*"), F.count("event_id"), F.countDistinct("profile_id"))
    assert {row[0]: tuple(row[1:]) for row in counted.collect()} == EXPECTED[name]


def test_layouts(funnels, spark):
    def layout(schema):
        return [(field.name, field.dataType) for field in schema.fields]

    assert layout(funnels["account"].schema) == layout(ACCOUNT_FUNNEL_SCHEMA)
    assert layout(funnels["balance"].schema) == layout(COHORT_FUNNEL_SCHEMA)
    assert layout(funnels["card"].schema) == layout(COHORT_FUNNEL_SCHEMA)
    assert layout(conversion(funnels["card"]).schema) == layout(CONVERSION_SCHEMA)


def test_dates_are_strictly_inside_the_window(funnels):
    late = F.col("event").startswith("5. CCY")
    until = F.when(late | (F.col("event") == "5. FIVE TX 90D"), 90).when(F.col("event").contains("60D"), 60).otherwise(30)
    for funnel in funnels.values():
        end = F.timestamp_add("DAY", until, F.col("profile_date_created"))
        start = F.timestamp_add("DAY", F.lit(30), F.col("profile_date_created"))
        steps = funnel.where("event <> '1. PROFILE_CREATED'")
        assert steps.where((F.col("date") >= end) | F.col("date").isNull()).count() == 0
        assert steps.where(late & (F.col("date") <= start)).count() == 0


def test_early_and_late_transactions_share_no_profile(funnels):
    counts = (
        funnels["balance"]
        .where(F.col("event").isin("4. CCY TX WITHIN 30 DAYS", "5. CCY TX WITHIN 90 DAYS (EXCL DEPOSIT)"))
        .groupBy("profile_id")
        .count()
    )
    assert counts.where("count > 1").count() == 0


def test_receipts_are_unique_per_profile_and_currency(funnels):
    counts = funnels["account"].where("event = '8. RECEIVED_TO_DETAILS'").groupBy("profile_id", "currency").count()
    assert counts.where("count > 1").count() == 0


@pytest.mark.parametrize(
    "name, stages, build",
    [
        ("account", ACCOUNT_STAGES, account.account_stage),
        ("balance", BALANCE_STAGES, balance.balance_stage),
        ("card", CARD_STAGES, card.card_stage),
    ],
)
def test_funnel_is_the_sum_of_its_stages(funnels, sources_small, config, name, stages, build):
    total = sum(build(key, sources_small, config).count() for key in stages)
    assert total == funnels[name].count()


def test_report_percentages(funnels):
    report = [row.pct_of_profiles for row in conversion(funnels["account"]).collect()]
    assert report == [100.0, 18.2514, 15.1913, 24.0437, 16.612, 7.2131, 12.1311, 29.5082]
    report = [row.pct_of_profiles for row in conversion(funnels["card"]).collect()]
    assert report == [100.0, 26.5574, 19.5628, 28.4153, 55.1913]

"""A few rows per rule, with the expected outcome written out."""

from __future__ import annotations

from milepost.plans.account import account_funnel
from milepost.plans.balance import balance_funnel
from milepost.plans.card import card_funnel
from milepost.plans.conversion import conversion
from tests.helpers import ACCOUNT, P, action, address, at, at_stage, make_sources, order, profile


def balance(identifier: int, created: str, currency: str = "GBP") -> tuple:
    return (identifier, ACCOUNT, currency, at(created))


def transaction(identifier: int, created: str, kind: str | None = "CONVERSION", state: str = "COMPLETED") -> tuple:
    return (identifier, ACCOUNT, state, kind, at(created))


def card(days: int | None = None, activated: str | None = None, ordered: str | None = None, issued: str | None = None):
    times = [None if text is None else at(text) for text in (ordered, issued, activated)]
    return (P, 77, *times, days)


def test_unknown_date_does_not_rank_first(spark):
    sources = make_sources(spark, bank_details_order_status=[order(1, None), order(2, "2020-02-10")])
    assert [row["date"] for row in at_stage(account_funnel(sources), "4.")] == [at("2020-02-10")]


def test_currency_filter_comes_before_the_rank(spark):
    sources = make_sources(spark, balance=[balance(1, "2020-02-20", "JPY"), balance(2, "2020-02-25", "GBP")])
    funnel = account_funnel(sources)
    assert [row["currency"] for row in at_stage(funnel, "2.")] == ["JPY"]
    assert [row["currency"] for row in at_stage(funnel, "3.")] == ["GBP"]


def test_late_stage_needs_the_first_transaction_to_be_late(spark):
    sources = make_sources(
        spark,
        balance=[balance(1, "2020-02-01")],
        balance_transaction=[transaction(1, "2020-02-05"), transaction(2, "2020-03-20")],
    )
    funnel = balance_funnel(sources)
    assert [row["event_id"] for row in at_stage(funnel, "4. CCY")] == ["1"]
    assert at_stage(funnel, "5.") == []


def test_late_first_transaction(spark):
    sources = make_sources(
        spark, balance=[balance(1, "2020-02-01")], balance_transaction=[transaction(2, "2020-03-20")]
    )
    funnel = balance_funnel(sources)
    assert at_stage(funnel, "4. CCY") == []
    assert [row["event_id"] for row in at_stage(funnel, "5.")] == ["2"]


def test_exactly_thirty_days_is_in_neither_window(spark):
    sources = make_sources(
        spark, balance=[balance(1, "2020-02-01")], balance_transaction=[transaction(1, "2020-03-02")]
    )
    funnel = balance_funnel(sources)
    assert at_stage(funnel, "4. CCY") == []
    assert at_stage(funnel, "5.") == []


def test_first_event_outside_the_window_is_not_replaced(spark):
    sources = make_sources(spark, balance=[balance(1, "2020-03-02"), balance(2, "2020-03-05")])
    assert at_stage(account_funnel(sources), "2.") == []


def test_event_before_profile_creation_counts(spark):
    sources = make_sources(spark, balance=[balance(1, "2020-01-15")])
    assert len(at_stage(account_funnel(sources), "2.")) == 1


def test_smaller_id_wins_a_tie(spark):
    sources = make_sources(spark, balance=[balance(7, "2020-02-10"), balance(10, "2020-02-10"), balance(9, "2020-02-10")])
    assert [row["event_id"] for row in at_stage(account_funnel(sources), "2.")] == ["7"]


def test_deposit_shows_the_smallest_currency_of_its_account(spark):
    sources = make_sources(
        spark,
        balance=[balance(1, "2020-02-01", "EUR"), balance(2, "2020-02-01", "AUD")],
        balance_transaction=[transaction(5, "2020-02-10", "DEPOSIT")],
    )
    rows = at_stage(balance_funnel(sources), "3.")
    assert [(row["event_id"], row["currency"]) for row in rows] == [("5", "AUD")]


def test_transactions_of_an_account_without_balance_are_left_out(spark):
    sources = make_sources(spark, balance_transaction=[transaction(5, "2020-02-10", "DEPOSIT")])
    assert at_stage(balance_funnel(sources), "3.") == []


def test_missing_type_is_neither_deposit_nor_other(spark):
    sources = make_sources(
        spark, balance=[balance(1, "2020-02-01")], balance_transaction=[transaction(5, "2020-02-10", None)]
    )
    funnel = balance_funnel(sources)
    assert at_stage(funnel, "3.") == at_stage(funnel, "4.") == at_stage(funnel, "5.") == []


def test_balance_funnel_keeps_every_balance(spark):
    sources = make_sources(spark, balance=[balance(1, "2020-02-10"), balance(2, "2020-02-11")])
    assert len(at_stage(balance_funnel(sources), "2.")) == 2
    assert len(at_stage(account_funnel(sources), "2.")) == 1


def test_balance_funnel_keeps_every_verified_order_in_any_currency(spark):
    orders = [order(1, "2020-02-10"), order(2, "2020-02-11", currency="JPY"), order(3, "2020-02-12", status="PENDING")]
    sources = make_sources(spark, bank_details_order_status=orders)
    assert [row["event_id"] for row in at_stage(balance_funnel(sources), "4. VERIFIED")] == ["1", "2"]
    assert [row["event_id"] for row in at_stage(account_funnel(sources), "5.")] == ["1"]


def test_verified_time_falls_back_to_initiation(spark):
    orders = [order(1, "2020-02-10", completed="2020-02-20"), order(2, "2020-02-15")]
    rows = at_stage(account_funnel(make_sources(spark, bank_details_order_status=orders)), "5.")
    assert [(row["event_id"], row["date"]) for row in rows] == [("2", at("2020-02-15"))]


def test_first_receipt_per_currency(spark):
    receipts = [(1, P, "GBP", at("2020-02-03")), (2, P, "GBP", at("2020-02-02")), (3, P, "EUR", at("2020-02-04"))]
    rows = at_stage(account_funnel(make_sources(spark, receive_transactions=receipts)), "8.")
    assert [(row["event_id"], row["currency"]) for row in rows] == [("2", "GBP"), ("3", "EUR")]


def test_exchange_is_filtered_on_source_and_reported_with_target(spark):
    rows = at_stage(account_funnel(make_sources(spark, action_step=[action(1, "GBP", "JPY")])), "7.")
    assert [(row["event_id"], row["currency"]) for row in rows] == [("1", "JPY")]


def test_unsupported_source_or_equal_currencies_or_flags_are_no_exchange(spark):
    actions = [action(1, "JPY", "GBP"), action(2, "GBP", "GBP"), action(3, "GBP", "EUR", ok=0)]
    actions.append(action(4, "GBP", "EUR", flag=0))
    assert at_stage(account_funnel(make_sources(spark, action_step=actions)), "7.") == []


def test_exchange_needs_an_account(spark):
    sources = make_sources(spark, account=[(5, 99)], action_step=[action(1, "GBP", "JPY")])
    assert at_stage(account_funnel(sources), "7.") == []


def test_two_accounts_do_not_double_an_exchange(spark):
    sources = make_sources(spark, account=[(5, P), (6, P)], action_step=[action(1, "GBP", "JPY")])
    assert len(at_stage(account_funnel(sources), "7.")) == 1


def test_card_is_found_by_user_and_named_by_profile(spark):
    sources = make_sources(spark, card_issuance_summary=[card(ordered="2020-02-10 01:02:03.500")])
    rows = at_stage(card_funnel(sources), "2.")
    assert [(row["profile_id"], row["event_id"]) for row in rows] == [(P, "772020-02-10 01:02:03.500")]


def test_five_transactions_date_and_id(spark):
    rows = at_stage(card_funnel(make_sources(spark, card_issuance_summary=[card(89)])), "5.")
    assert [(row["date"], row["event_id"]) for row in rows] == [(at("2020-04-30"), None)]
    assert at_stage(card_funnel(make_sources(spark, card_issuance_summary=[card(90)])), "5.") == []
    named = at_stage(card_funnel(make_sources(spark, card_issuance_summary=[card(3, "2020-02-03")])), "5.")
    assert [row["event_id"] for row in named] == ["772020-02-03 00:00:00.0003"]


def test_every_summary_row_counts(spark):
    sources = make_sources(spark, card_issuance_summary=[card(ordered="2020-02-10"), card(ordered="2020-02-11")])
    assert len(at_stage(card_funnel(sources), "2.")) == 2


def test_card_windows(spark):
    summary = card(ordered="2020-03-02", issued="2020-03-01 23:59:59", activated="2020-04-01 00:00:00")
    funnel = card_funnel(make_sources(spark, card_issuance_summary=[summary]))
    assert at_stage(funnel, "2.") == []
    assert len(at_stage(funnel, "3.")) == 1
    assert at_stage(funnel, "4.") == []


def test_missing_class_is_business(spark):
    sources = make_sources(spark, user_profile=[profile(kind=None)])
    assert [row["profile_type"] for row in at_stage(card_funnel(sources), "1.")] == ["Business"]


def test_two_primary_addresses_double_unranked_stages_only(spark):
    sources = make_sources(
        spark,
        address=[address(country="SE"), address(country="FR")],
        balance=[balance(1, "2020-02-10")],
        balance_transaction=[transaction(1, "2020-02-11")],
    )
    funnel = balance_funnel(sources)
    assert sorted(row["country_code"] for row in at_stage(funnel, "1.")) == ["FR", "SE"]
    assert sorted(row["country_code"] for row in at_stage(funnel, "2.")) == ["FR", "SE"]
    assert [row["country_code"] for row in at_stage(funnel, "4. CCY")] == ["FR"]
    assert len(at_stage(account_funnel(sources), "2.")) == 1


def test_no_primary_address_means_no_rows(spark):
    sources = make_sources(spark, address=[address(kind="SECONDARY_ADDRESS")], balance=[balance(1, "2020-02-10")])
    assert account_funnel(sources).count() == 0
    assert balance_funnel(sources).count() == 0


def test_cohort_week_starts_on_monday(spark):
    sources = make_sources(spark, user_profile=[profile("2020-02-02 15:00:00")])
    row = at_stage(card_funnel(sources), "1.")[0]
    assert (row["cohort_week"], row["cohort_month"]) == (at("2020-01-27"), at("2020-02-01"))


def test_id_suffix(spark):
    sources = make_sources(
        spark,
        balance=[balance(1, "2020-02-10")],
        bank_details_order_status=[order(8, "2020-02-10", issued="2020-02-12")],
    )
    funnel = account_funnel(sources)
    assert [at_stage(funnel, stage)[0]["event_id"] for stage in ("2.", "3.", "4.", "6.")] == ["1", "19999", "8", "89999"]


def test_start_date_is_inclusive(spark):
    sources = make_sources(
        spark,
        user_profile=[profile("2019-12-31 23:59:59", 1), profile("2020-01-01", 2)],
        address=[address(1), address(2)],
    )
    assert [row["profile_id"] for row in at_stage(account_funnel(sources), "1.")] == [2]
    assert [row["profile_id"] for row in at_stage(balance_funnel(sources), "1.")] == [1, 2]


def test_report(spark):
    sources = make_sources(
        spark,
        user_profile=[profile(identifier=number) for number in range(1, 5)],
        address=[address(number) for number in range(1, 5)],
        balance=[balance(1, "2020-02-10", "JPY")],
    )
    rows = [tuple(row) for row in conversion(account_funnel(sources)).collect()]
    assert rows == [("1. PROFILE_CREATED", 4, 100.0), ("2. BALANCE_OPENED", 1, 25.0)]


def test_report_without_first_step(spark):
    funnel = spark.createDataFrame([("2. X", "a"), ("2. X", None)], "event string, event_id string")
    assert [tuple(row) for row in conversion(funnel).collect()] == [("2. X", 1, None)]
    uncounted = spark.createDataFrame([("1. PROFILE_CREATED", None), ("2. X", "a")], "event string, event_id string")
    assert [row.pct_of_profiles for row in conversion(uncounted).collect()] == [None, None]
    assert conversion(funnel.limit(0)).collect() == []

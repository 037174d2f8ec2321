"""The same results in DuckDB SQL: every stage on its own, ranked with a window, over the raw tables."""

from __future__ import annotations

# Fixed values, written out so that a change of the library's own shows up here: classes and address type in the source data,
# the currencies that count, those in the sample data, and the sample's start date.
PERSONAL_CLASS = "com.transferwise.fx.user.PersonalUserProfile"
BUSINESS_CLASS = "business"
PRIMARY_ADDRESS_TYPE = "PRIMARY_USER_PROFILE_ADDRESS"
SUPPORTED_CURRENCIES = ("GBP", "EUR", "USD", "AUD", "NZD", "SGD", "RON", "CAD", "HUF", "TRY")
CURRENCIES = ("GBP", "EUR", "USD", "AUD", "NZD", "SGD", "RON", "CAD", "HUF", "TRY", "JPY", "INR")
START_DATE = "1995-03-01"


def _names(values) -> str:
    return ", ".join(f"'{value}'" for value in values)


def _ccy(number: str) -> str:
    return f"([{_names(CURRENCIES)}])[1 + ({number}) % {len(CURRENCIES)}]"


def _stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%g')"


SUPPORTED = f"({_names(SUPPORTED_CURRENCIES)})"

TABLES = {
    "placed": """
        SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, o_orderpriority AS pr,
               o_orderdate + to_seconds(o_orderkey % 86400) AS t
        FROM orders""",
    "lines": "SELECT l_orderkey, l_linenumber, l_returnflag, c, t FROM lineitem JOIN placed ON l_orderkey = k",
    "user_profile": f"""
        SELECT c_custkey AS id,
               coalesce(t0, TIMESTAMP '1995-06-01 00:00:00') - to_days(CAST(c_custkey % 120 AS INTEGER)) AS date_created,
               CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN '{BUSINESS_CLASS}'
                    WHEN c_custkey % 23 = 0 THEN NULL
                    ELSE '{PERSONAL_CLASS}' END AS class
        FROM customer LEFT JOIN (SELECT c, min(t) AS t0 FROM placed GROUP BY c) ON c = c_custkey""",
    "address": f"""
        SELECT c_custkey AS user_profile_id, '{PRIMARY_ADDRESS_TYPE}' AS address_type, n_name AS country_code
        FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 50 <> 7
        UNION ALL
        SELECT c_custkey, 'SECONDARY_ADDRESS', 'ZZ' FROM customer WHERE c_custkey % 3 = 0""",
    "account": "SELECT 1000000 + c_custkey AS id, c_custkey AS profile_id FROM customer WHERE c_custkey % 10 <> 9",
    "balance": f"""
        SELECT k AS id, 1000000 + c AS account_id, {_ccy('k')} AS currency, t AS creation_time
        FROM placed WHERE pr IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""",
    "balance_transaction": """
        SELECT k AS id, 1000000 + c AS account_id,
               CASE st WHEN 'O' THEN 'PENDING' ELSE 'COMPLETED' END AS state,
               CASE WHEN pr IN ('1-URGENT', '2-HIGH') THEN 'DEPOSIT' ELSE 'CONVERSION' END AS type,
               t AS creation_time
        FROM placed""",
    "bank_orders": f"""
        SELECT k AS order_id, c AS profile_id, {_ccy('k')} AS currency,
               CASE WHEN k % 11 = 0 THEN NULL ELSE t END AS bankdetail_initiation_time,
               CASE WHEN k % 3 = 0 THEN NULL ELSE t + to_days(2) END AS verification_completion_time,
               CASE st WHEN 'O' THEN 'PENDING' ELSE 'DONE' END AS verification_status,
               st = 'F' AS bank_details_issued,
               CASE WHEN k % 13 = 0 THEN NULL ELSE t + to_days(5) END AS bankdetail_issuance_time
        FROM placed""",
    "action_step": f"""
        SELECT l_orderkey * 10 + l_linenumber AS action_id, c AS user_profile_id,
               t + to_days(CAST(l_linenumber AS INTEGER)) AS action_completion_time,
               {_ccy('l_orderkey')} AS source_currency,
               {_ccy('l_orderkey // 12 + l_linenumber')} AS target_currency,
               CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE 1 END AS successful_action,
               CASE WHEN l_orderkey % 4 = 0 THEN 'SEND' ELSE 'BALANCE' END AS product_type,
               CASE WHEN l_linenumber % 7 = 0 THEN 0 ELSE 1 END AS flag_for_aggregations
        FROM lines""",
    "receipts": f"""
        SELECT l_orderkey * 10 + l_linenumber AS request_id, c AS profile_id,
               {_ccy('l_orderkey + l_linenumber')} AS bank_detail_currency,
               t + to_days(CAST(l_linenumber AS INTEGER)) AS receival_date
        FROM lines WHERE l_returnflag = 'R'""",
    "cards": """
        SELECT c AS user_id, c + 500000 AS profile_id, t0 AS first_card_order_time,
               CASE WHEN c % 8 = 0 THEN NULL ELSE t0 + to_days(4) END AS first_card_creation_time,
               CASE WHEN c % 6 = 0 THEN NULL ELSE t0 + to_days(CAST(c % 40 AS INTEGER)) END AS first_activation_time,
               CASE WHEN c % 9 = 0 THEN NULL ELSE CAST(c % 130 AS INTEGER) END
                   AS days_first_card_creation_to_five_transaction
        FROM (SELECT c, min(t) AS t0 FROM placed WHERE pr <> '5-LOW' GROUP BY c)""",
    "cohort": f"""
        SELECT p.id AS profile_id, p.date_created AS profile_date_created, a.country_code,
               CASE WHEN p.class = '{PERSONAL_CLASS}' THEN 'Personal' ELSE 'Business' END AS profile_type,
               date_trunc('month', p.date_created) AS cohort_month,
               date_trunc('week', p.date_created) AS cohort_week
        FROM user_profile p JOIN address a ON a.user_profile_id = p.id
        WHERE a.address_type = '{PRIMARY_ADDRESS_TYPE}' AND p.date_created >= TIMESTAMP '{START_DATE}'""",
    "holders": "SELECT cohort.*, account.id AS account_id FROM cohort JOIN account USING (profile_id)",
    "with_balance": """
        SELECT holders.*, b.id AS fact_id, b.currency, b.creation_time AS date
        FROM holders JOIN balance b USING (account_id)""",
    "with_transaction": """
        SELECT holders.*, x.id AS fact_id, b.currency, x.creation_time AS date, x.state, x.type
        FROM holders JOIN balance b USING (account_id) JOIN balance_transaction x USING (account_id)""",
    "with_order": """
        SELECT cohort.*, o.* EXCLUDE (profile_id, order_id), o.order_id AS fact_id,
               coalesce(o.verification_completion_time, o.bankdetail_initiation_time) AS verified_at
        FROM cohort JOIN bank_orders o USING (profile_id)""",
    "with_action": """
        SELECT holders.*, s.* EXCLUDE (user_profile_id, action_id), s.action_id AS fact_id
        FROM holders LEFT JOIN action_step s
          ON s.user_profile_id = holders.profile_id AND s.successful_action = 1 AND s.product_type = 'BALANCE'""",
    "with_receipt": """
        SELECT cohort.*, r.request_id AS fact_id, r.bank_detail_currency AS currency, r.receival_date AS date
        FROM cohort JOIN receipts r USING (profile_id)""",
    "with_card": """
        SELECT cohort.*, s.* EXCLUDE (user_id, profile_id), s.profile_id AS card_profile_id
        FROM cohort JOIN cards s ON s.user_id = cohort.profile_id""",
}

ACCOUNT_COLUMNS = "profile_id, currency, profile_date_created, date, event, event_id"
COHORT_COLUMNS = (
    "profile_id, profile_type, country_code, currency, cohort_month, cohort_week, "
    "profile_date_created, date, event, event_id"
)


_FAN_ACCOUNT = "CASE WHEN c % 7 = 3 AND k % 4 = 1 THEN 2000000 ELSE 1000000 END + c AS account_id"

#: Some customers have a second account, to which a quarter of their orders belong, a second primary address and a second card.
FAN_OUT = {
    **TABLES,
    "address": f"""
        {TABLES["address"]}
        UNION ALL
        SELECT c_custkey, '{PRIMARY_ADDRESS_TYPE}', n_name
        FROM customer JOIN nation ON n_nationkey = (c_nationkey + 1) % 25 WHERE c_custkey % 11 = 4""",
    "account": f"""
        {TABLES["account"]} UNION ALL SELECT 2000000 + c_custkey, c_custkey FROM customer WHERE c_custkey % 7 = 3""",
    "balance": TABLES["balance"].replace("1000000 + c AS account_id", _FAN_ACCOUNT),
    "balance_transaction": TABLES["balance_transaction"].replace("1000000 + c AS account_id", _FAN_ACCOUNT),
    "cards": f"""
        {TABLES["cards"]}
        UNION ALL
        SELECT c, c + 700000, t0 + to_days(1), t0 + to_days(6), t0 + to_days(CAST(c % 50 AS INTEGER)), CAST(c % 100 AS INTEGER)
        FROM (SELECT c, min(t) AS t0 FROM placed WHERE pr <> '5-LOW' GROUP BY c) WHERE c % 13 = 5""",
}


def _query(body: str, named: dict[str, str] = TABLES) -> str:
    tables = ",\n".join(f"{name} AS ({sql})" for name, sql in named.items())
    return f"WITH {tables}\n{body}"


def _ranked(rows: str, date: str, where: str, id_text: str, currency: str = "currency", keys: str = "profile_id") -> str:
    """First row per key; the missing dates rank last."""
    return f"""
        SELECT * EXCLUDE (place) FROM (
            SELECT profile_id, profile_type, country_code, cohort_month, cohort_week, profile_date_created,
                   {date} AS date, {id_text} AS event_id, {currency} AS currency,
                   row_number() OVER (PARTITION BY {keys} ORDER BY {date} NULLS LAST, fact_id,
                                      {currency} NULLS FIRST, country_code NULLS LAST) AS place
            FROM {rows} WHERE {where})
        WHERE place = 1 AND date IS NOT NULL"""


def _every(rows: str, date: str, where: str, id_text: str, currency: str = "currency") -> str:
    return f"""
        SELECT profile_id, profile_type, country_code, cohort_month, cohort_week, profile_date_created,
               {date} AS date, {id_text} AS event_id, {currency} AS currency
        FROM {rows} WHERE {where} AND {date} IS NOT NULL"""


PLAIN_ID = "CAST(fact_id AS VARCHAR)"
LONG_ID = "CAST(fact_id AS VARCHAR) || '9999'"
DEPOSITS = "state = 'COMPLETED' AND type = 'DEPOSIT'"
OTHERS = "state = 'COMPLETED' AND type <> 'DEPOSIT'"
EXCHANGES = f"source_currency <> target_currency AND flag_for_aggregations = 1 AND source_currency IN {SUPPORTED}"

FIRSTS = {
    "first_balance": _ranked("with_balance", "date", "true", PLAIN_ID),
    "first_supported_balance": _ranked("with_balance", "date", f"currency IN {SUPPORTED}", LONG_ID),
    "first_bank_request": _ranked("with_order", "bankdetail_initiation_time", f"currency IN {SUPPORTED}", PLAIN_ID),
    "first_verified": _ranked(
        "with_order", "verified_at", f"currency IN {SUPPORTED} AND verification_status = 'DONE'", PLAIN_ID
    ),
    "first_issued": _ranked(
        "with_order", "bankdetail_issuance_time", f"currency IN {SUPPORTED} AND bank_details_issued", LONG_ID
    ),
    "first_cross_ccy": _ranked("with_action", "action_completion_time", EXCHANGES, PLAIN_ID, "target_currency"),
    "first_receipt_per_ccy": _ranked(
        "with_receipt", "date", f"currency IN {SUPPORTED}", PLAIN_ID, keys="profile_id, currency"
    ),
    "first_deposit": _ranked("with_transaction", "date", DEPOSITS, PLAIN_ID),
    "first_non_deposit": _ranked("with_transaction", "date", OTHERS, PLAIN_ID),
}


def _card_id(*parts: str) -> str:
    return " || ".join(["CAST(card_profile_id AS VARCHAR)", *parts])


CARD_DAYS = "days_first_card_creation_to_five_transaction"
FIVE_TX = f"(profile_date_created + to_days({CARD_DAYS}))"
START = """
        SELECT profile_id, profile_type, country_code, cohort_month, cohort_week, profile_date_created,
               profile_date_created AS date, CAST(profile_id AS VARCHAR) AS event_id, 'N/A' AS currency
        FROM cohort"""


def _card(column: str) -> str:
    return _every("with_card", column, "true", _card_id(_stamp(column)), "'N/A'")


def _stage(label: str, rows: str, until: int | None, columns: str, after: int | None = None) -> str:
    tests = ["true"]
    if until is not None:
        tests.append(f"date < profile_date_created + to_days({until})")
    if after is not None:
        tests.append(f"date > profile_date_created + to_days({after})")
    return f"SELECT {columns} FROM (SELECT *, '{label}' AS event FROM ({rows}) WHERE {' AND '.join(tests)})"


def _account(label: str, rows: str, until: int | None = 30) -> str:
    return _stage(label, rows, until, ACCOUNT_COLUMNS)


def _cohort(label: str, rows: str, until: int | None = 30, after: int | None = None) -> str:
    return _stage(label, rows, until, COHORT_COLUMNS, after)


ACCOUNT = {
    "account_1_profile_created": _account("1. PROFILE_CREATED", START, None),
    "account_2_balance_opened": _account("2. BALANCE_OPENED", FIRSTS["first_balance"]),
    "account_3_balance_opened_ccy": _account(
        "3. BALANCE_OPENED_CCY_WITH_ACC_DETAILS", FIRSTS["first_supported_balance"]
    ),
    "account_4_bank_detail_requested": _account("4. BANK_DETAIL_REQUESTED", FIRSTS["first_bank_request"]),
    "account_5_verified": _account("5. VERIFIED", FIRSTS["first_verified"]),
    "account_6_bank_details_issued": _account("6. BANK DETAILS ISSUED", FIRSTS["first_issued"]),
    "account_7_cross_ccy_tx": _account("7. PERFORMED_CROSS_CCY_TX", FIRSTS["first_cross_ccy"]),
    "account_8_received_to_details": _account("8. RECEIVED_TO_DETAILS", FIRSTS["first_receipt_per_ccy"]),
}
BALANCE = {
    "balance_1_profile_created": _cohort("1. PROFILE_CREATED", START, None),
    "balance_2_balance_opened": _cohort("2. BALANCE_OPENED", _every("with_balance", "date", "true", PLAIN_ID)),
    "balance_3_topped_up": _cohort("3. TOPPED UP", FIRSTS["first_deposit"]),
    "balance_4_verified": _cohort(
        "4. VERIFIED", _every("with_order", "verified_at", "verification_status = 'DONE'", PLAIN_ID)
    ),
    "balance_4_ccy_tx_30d": _cohort("4. CCY TX WITHIN 30 DAYS", FIRSTS["first_non_deposit"]),
    "balance_5_ccy_tx_90d": _cohort(
        "5. CCY TX WITHIN 90 DAYS (EXCL DEPOSIT)", FIRSTS["first_non_deposit"], 90, 30
    ),
}
CARD = {
    "card_1_profile_created": _cohort("1. PROFILE_CREATED", START, None),
    "card_2_ordered_30d": _cohort("2. CARD ORDERED 30D", _card("first_card_order_time")),
    "card_3_issued_30d": _cohort("3. CARD ISSUED 30D", _card("first_card_creation_time")),
    "card_4_activated_60d": _cohort("4. CARD ACTIVATED 60D", _card("first_activation_time"), 60),
    "card_5_five_tx_90d": _cohort(
        "5. FIVE TX 90D",
        _every(
            "with_card",
            FIVE_TX,
            "true",
            _card_id(_stamp("first_activation_time"), f"CAST({CARD_DAYS} AS VARCHAR)"),
            "'N/A'",
        ),
        90,
    ),
}


def _union(stages: dict[str, str]) -> str:
    return "\nUNION ALL\n".join(stages.values())


def _report(funnel: str) -> str:
    return f"""
        SELECT event, count(event_id) AS event_count,
               round(100.0::DOUBLE * count(event_id)
                     / nullif((SELECT count(event_id) FROM ({funnel}) WHERE event = '1. PROFILE_CREATED'), 0), 4)
                   AS pct_of_profiles
        FROM ({funnel}) GROUP BY event ORDER BY event"""


def _bodies() -> dict[str, str]:
    account, card = _union(ACCOUNT), _union(CARD)
    report = _report(account)
    cards = "first_activation_time"
    return {
        "src_user_profile": "SELECT * FROM user_profile",
        "src_address": "SELECT * FROM address",
        "src_account": "SELECT * FROM account",
        "src_balance": "SELECT * FROM balance",
        "src_transaction": "SELECT * FROM balance_transaction",
        "src_bank_details_order": "SELECT * FROM bank_orders",
        "src_action_step": "SELECT * FROM action_step",
        "src_receive_txn": "SELECT * FROM receipts",
        "src_card_summary": "SELECT * FROM cards",
        "proj_rename": "SELECT profile_id, country_code, profile_date_created, profile_date_created AS date FROM cohort",
        "proj_event_label": "SELECT id, '1. PROFILE_CREATED' AS event_label FROM user_profile",
        "proj_na_currency": "SELECT id, 'N/A' AS na_currency FROM user_profile",
        "proj_profile_type": f"""
            SELECT id, CASE WHEN class = '{PERSONAL_CLASS}' THEN 'Personal' ELSE 'Business' END AS profile_type
            FROM user_profile""",
        "proj_cohort_month": "SELECT id, date_trunc('month', date_created) AS cohort_month FROM user_profile",
        "proj_cohort_week": "SELECT id, date_trunc('week', date_created) AS cohort_week FROM user_profile",
        "proj_event_id_cast": "SELECT id, CAST(id AS VARCHAR) AS event_id_cast FROM balance",
        "proj_id_suffix": "SELECT id, CAST(id AS VARCHAR) || '9999' AS id_suffix FROM balance",
        "proj_id_with_time": f"""
            SELECT user_id, CAST(profile_id AS VARCHAR) || {_stamp('first_card_order_time')} AS id_with_time
            FROM cards""",
        "proj_id_time_days": f"""
            SELECT user_id, CAST(profile_id AS VARCHAR) || {_stamp(cards)} || CAST({CARD_DAYS} AS VARCHAR)
                AS id_time_days FROM cards""",
        "proj_verified_time": """
            SELECT order_id, coalesce(verification_completion_time, bankdetail_initiation_time) AS verified_time
            FROM bank_orders""",
        "proj_window_end": "SELECT id, date_created + to_days(30) AS window_end FROM user_profile",
        "proj_five_tx_date": f"SELECT profile_id, {FIVE_TX} AS five_tx_date FROM with_card",
        "filter_cohort_start": f"SELECT id AS profile_id FROM user_profile WHERE date_created >= TIMESTAMP '{START_DATE}'",
        "filter_primary_address": f"""
            SELECT user_profile_id AS profile_id FROM address WHERE address_type = '{PRIMARY_ADDRESS_TYPE}'""",
        "filter_supported_ccy": f"SELECT id FROM balance WHERE currency IN {SUPPORTED}",
        "filter_verified": "SELECT order_id FROM bank_orders WHERE verification_status = 'DONE'",
        "filter_details_issued": "SELECT order_id FROM bank_orders WHERE bank_details_issued",
        "filter_txn_deposit": f"SELECT id FROM balance_transaction WHERE {DEPOSITS}",
        "filter_txn_non_deposit": f"SELECT id FROM balance_transaction WHERE {OTHERS}",
        "filter_successful_balance_action": """
            SELECT action_id FROM action_step WHERE successful_action = 1 AND product_type = 'BALANCE'""",
        "filter_cross_ccy": """
            SELECT action_id FROM action_step WHERE source_currency <> target_currency AND flag_for_aggregations = 1""",
        "filter_event_date_present": """
            SELECT profile_id, fact_id AS order_id FROM with_order WHERE bankdetail_initiation_time IS NOT NULL""",
        "filter_within_days": """
            SELECT profile_id, fact_id AS order_id FROM with_order
            WHERE bankdetail_initiation_time < profile_date_created + to_days(30)""",
        "filter_between_days_exclusive": """
            SELECT profile_id, x.id AS transaction_id FROM holders JOIN balance_transaction x USING (account_id)
            WHERE account_id IN (SELECT account_id FROM balance)
              AND x.creation_time > profile_date_created + to_days(30)
              AND x.creation_time < profile_date_created + to_days(90)""",
        "join_cohort": "SELECT profile_id, country_code FROM cohort",
        "join_balance_path": "SELECT profile_id, account_id, fact_id AS balance_id FROM with_balance",
        "join_txn_path": """
            SELECT profile_id, x.id AS transaction_id, b.currency
            FROM holders JOIN balance_transaction x USING (account_id)
            JOIN (SELECT account_id, min(currency) AS currency FROM balance GROUP BY account_id) b USING (account_id)""",
        "join_bank_orders": "SELECT profile_id, fact_id AS order_id FROM with_order",
        "join_action_left": "SELECT profile_id, account_id, fact_id AS action_id FROM with_action",
        "join_receipts": "SELECT profile_id, fact_id AS request_id FROM with_receipt",
        "join_card_summary": "SELECT profile_id, card_profile_id FROM with_card",
        **{key: f"SELECT profile_id, date, event_id, currency FROM ({sql})" for key, sql in FIRSTS.items()},
        "agg_profile_base": f"""
            SELECT '1. PROFILE_CREATED' AS event, count(event_id) AS event_count
            FROM ({account}) WHERE event = '1. PROFILE_CREATED'""",
        "agg_event_counts": f"SELECT event, count(event_id) AS event_count FROM ({account}) GROUP BY event",
        "agg_pct_of_base": report,
        "report_order": report,
        "account_conversion": report,
        "card_conversion": _report(card),
        "union_stages": f"SELECT event, event_id FROM ({account})",
        **ACCOUNT,
        **BALANCE,
        **CARD,
        "account_funnel": account,
        "balance_funnel": _union(BALANCE),
        "card_funnel": card,
        "publish_replace": account,
        "publish_balance_funnel": _union(BALANCE),
        "published_account_conversion": report,
        "published_card_conversion": _report(card),
        "publish_staged_swap": card,
        "published_profile_base": f"""
            SELECT '1. PROFILE_CREATED' AS event, count(event_id) AS event_count
            FROM ({account}) WHERE event = '1. PROFILE_CREATED'""",
        "published_stage": ACCOUNT["account_6_bank_details_issued"],
    }


#: Keys that are also asked with several accounts, addresses and cards per customer, as `fan_<key>`.
FAN_OUT_KEYS = (
    "join_cohort",
    "join_balance_path",
    "join_txn_path",
    "join_action_left",
    "join_bank_orders",
    "join_card_summary",
    "first_balance",
    "first_supported_balance",
    "first_cross_ccy",
    "first_deposit",
    "first_non_deposit",
    "account_funnel",
    "balance_funnel",
    "card_funnel",
)


def all_sql() -> dict[str, str]:
    bodies = _bodies()
    fans = {f"fan_{key}": _query(bodies[key], FAN_OUT) for key in FAN_OUT_KEYS}
    return {**{key: _query(body) for key, body in bodies.items()}, **fans}

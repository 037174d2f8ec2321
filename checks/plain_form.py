"""The funnels written the long way: one branch per stage, ranked with a window over the full join.

Used to check the library's shorter plans for equal rows, and as the baseline of the benchmark. Conditions and computed
columns are written here anew, so that a fault in the library's own is not on both sides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from milepost.config import FunnelConfig
from milepost.schemas import ACCOUNT_FUNNEL_SCHEMA, COHORT_FUNNEL_SCHEMA
from milepost.sources import Sources


def _text(column: str) -> Column:
    return F.format_string("%d", F.col(column))


def _time(column: str) -> Column:
    """To the millisecond."""
    moment = F.col(column)
    parts = [F.date_format(F.to_date(moment), "yyyy-MM-dd")]
    seconds = F.extract(F.lit("SECOND"), moment)  # with six digits
    millis = F.floor(seconds * 1000).cast("int")
    clock = F.format_string(" %02d:%02d:%02d.%03d", F.hour(moment), F.minute(moment), (millis / 1000).cast("int"), millis % 1000)
    return F.when(moment.isNotNull(), F.concat(*parts, clock))


def _after(moment: Column, days: Column) -> Column:
    return moment + F.make_dt_interval(days=days)


def _inside(date: Column, created: Column, until: int | None, after: int | None) -> Column:
    conditions = [date.isNotNull()]
    if until is not None:
        conditions.append(date < _after(created, F.lit(until)))
    if after is not None:
        conditions.append(date > _after(created, F.lit(after)))
    return reduce(Column.__and__, conditions)


def _deposit(is_one: bool) -> Column:
    return F.expr(f"state = 'COMPLETED' AND type {'=' if is_one else '<>'} 'DEPOSIT'")


def _cohort(s: Sources, cfg: FunnelConfig) -> DataFrame:
    profiles, addresses = s.user_profile.alias("p"), s.address.alias("a")
    return profiles.join(
        addresses,
        (F.col("p.id") == F.col("a.user_profile_id")) & (F.col("a.address_type") == cfg.primary_address_type),
    ).where(F.col("p.date_created") >= F.lit(cfg.start_date).cast("timestamp_ntz")).select(
        F.col("p.id").alias("pid"),
        F.col("p.date_created").alias("created"),
        F.col("p.class").alias("class"),
        F.col("a.country_code").alias("country_code"),
    )


def _on_account(s: Sources, cfg: FunnelConfig) -> DataFrame:
    accounts = s.account.select(F.col("id").alias("aid"), "profile_id")
    return _cohort(s, cfg).join(accounts, F.col("pid") == F.col("profile_id")).drop("profile_id")


def _on_balance(s: Sources, cfg: FunnelConfig) -> DataFrame:
    balances = s.balance.select(F.col("id").alias("fact_id"), "account_id", "currency", F.col("creation_time").alias("at"))
    return _on_account(s, cfg).join(balances, F.col("aid") == F.col("account_id"))


def _on_transaction(s: Sources, cfg: FunnelConfig) -> DataFrame:
    balances = s.balance.select(F.col("account_id").alias("of_account"), "currency")
    transactions = s.balance_transaction.select(
        F.col("id").alias("fact_id"), "account_id", "state", "type", F.col("creation_time").alias("at")
    )
    return (
        _on_account(s, cfg)
        .join(balances, F.col("aid") == F.col("of_account"))
        .join(transactions, F.col("aid") == F.col("account_id"))
    )


def _on_order(s: Sources, cfg: FunnelConfig) -> DataFrame:
    orders = s.bank_details_order_status.withColumnRenamed("order_id", "fact_id")
    return _cohort(s, cfg).join(orders, F.col("pid") == F.col("profile_id"))


def _on_action(s: Sources, cfg: FunnelConfig) -> DataFrame:
    actions = s.action_step.withColumnRenamed("action_id", "fact_id")
    matches = (
        (F.col("user_profile_id") == F.col("pid")) & (F.col("successful_action") == 1) & F.col("product_type").isin("BALANCE")
    )
    return _on_account(s, cfg).join(actions, matches, "left")


def _on_receipt(s: Sources, cfg: FunnelConfig) -> DataFrame:
    receipts = s.receive_transactions.withColumnRenamed("request_id", "fact_id")
    return _cohort(s, cfg).join(receipts, F.col("pid") == F.col("profile_id"))


def _on_card(s: Sources, cfg: FunnelConfig) -> DataFrame:
    return _cohort(s, cfg).join(s.card_issuance_summary, F.col("pid") == F.col("user_id"))


def _branch(
    rows: DataFrame,
    cfg: FunnelConfig,
    schema: StructType,
    label: str,
    date: Column,
    event_id: Column,
    currency: Column,
    until: int | None,
    after: int | None = None,
    rank_by: list[Column] | None = None,
) -> DataFrame:
    rows = rows.select("*", date.alias("_date"), event_id.alias("_text"), currency.alias("_currency"))
    if rank_by is not None:
        order = Window.partitionBy(*rank_by).orderBy(
            F.col("_date").asc_nulls_last(),
            F.col("fact_id"),
            F.col("_currency"),
            F.col("country_code").asc_nulls_last(),
        )
        rows = rows.withColumn("_place", F.row_number().over(order)).where("_place = 1")
    created = F.col("created")
    columns = {
        "profile_id": F.col("pid"),
        "profile_type": F.coalesce(F.when(F.col("class") == cfg.personal_class, "Personal"), F.lit("Business")),
        "country_code": F.col("country_code"),
        "currency": F.col("_currency"),
        "cohort_month": F.make_timestamp_ntz(F.year(created), F.month(created), F.lit(1), F.lit(0), F.lit(0), F.lit(0)),
        "cohort_week": F.date_sub(F.to_date(created), F.weekday(created)).cast("timestamp_ntz"),
        "profile_date_created": created,
        "date": F.col("_date"),
        "event": F.lit(label),
        "event_id": F.col("_text"),
    }
    return rows.where(_inside(F.col("_date"), created, until, after)).select(
        *[columns[name].alias(name) for name in schema.names]
    )


def _union(branches: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, branches)


def _start(s: Sources, cfg: FunnelConfig, schema: StructType) -> DataFrame:
    text = _text("pid")
    return _branch(_cohort(s, cfg), cfg, schema, "1. PROFILE_CREATED", F.col("created"), text, F.lit("N/A"), None)


def account_funnel(s: Sources, cfg: FunnelConfig) -> DataFrame:
    schema, days = ACCOUNT_FUNNEL_SCHEMA, cfg.window_days
    plain, long = _text("fact_id"), F.format_string("%d9999", F.col("fact_id"))
    currency, per_profile = F.col("currency"), [F.col("pid")]
    supported = currency.isin(*cfg.supported_currencies)
    verified_at = F.coalesce("verification_completion_time", "bankdetail_initiation_time")
    exchanges = F.expr("source_currency <> target_currency AND flag_for_aggregations = 1")
    from_supported = F.col("source_currency").isin(*cfg.supported_currencies)

    def ranked(rows, label, date, text, shown=currency, keys=per_profile):
        return _branch(rows, cfg, schema, label, date, text, shown, days, rank_by=keys)

    received = _on_receipt(s, cfg).withColumnRenamed("bank_detail_currency", "currency")
    return _union(
        [
            _start(s, cfg, schema),
            ranked(_on_balance(s, cfg), "2. BALANCE_OPENED", F.col("at"), plain),
            ranked(
                _on_balance(s, cfg).where(supported), "3. BALANCE_OPENED_CCY_WITH_ACC_DETAILS", F.col("at"), long
            ),
            ranked(
                _on_order(s, cfg).where(supported),
                "4. BANK_DETAIL_REQUESTED",
                F.col("bankdetail_initiation_time"),
                plain,
            ),
            ranked(
                _on_order(s, cfg).where(supported & (F.col("verification_status") == "DONE")),
                "5. VERIFIED",
                verified_at,
                plain,
            ),
            ranked(
                _on_order(s, cfg).where(supported & F.col("bank_details_issued")),
                "6. BANK DETAILS ISSUED",
                F.col("bankdetail_issuance_time"),
                long,
            ),
            ranked(
                _on_action(s, cfg).where(exchanges & from_supported),
                "7. PERFORMED_CROSS_CCY_TX",
                F.col("action_completion_time"),
                plain,
                F.col("target_currency"),
            ),
            ranked(
                received.where(supported),
                "8. RECEIVED_TO_DETAILS",
                F.col("receival_date"),
                plain,
                keys=[F.col("pid"), currency],
            ),
        ]
    )


def balance_funnel(s: Sources, cfg: FunnelConfig) -> DataFrame:
    schema, days = COHORT_FUNNEL_SCHEMA, cfg.window_days
    after, until = cfg.late_window
    text, currency, keys = _text("fact_id"), F.col("currency"), [F.col("pid")]
    verified_at = F.coalesce("verification_completion_time", "bankdetail_initiation_time")
    deposits, others = _deposit(True), _deposit(False)
    used = _on_transaction(s, cfg).where(others)
    late = "5. CCY TX WITHIN 90 DAYS (EXCL DEPOSIT)"
    return _union(
        [
            _start(s, cfg, schema),
            _branch(_on_balance(s, cfg), cfg, schema, "2. BALANCE_OPENED", F.col("at"), text, currency, days),
            _branch(
                _on_transaction(s, cfg).where(deposits),
                cfg,
                schema,
                "3. TOPPED UP",
                F.col("at"),
                text,
                currency,
                days,
                rank_by=keys,
            ),
            _branch(
                _on_order(s, cfg).where(F.col("verification_status") == "DONE"),
                cfg,
                schema,
                "4. VERIFIED",
                verified_at,
                text,
                currency,
                days,
            ),
            _branch(used, cfg, schema, "4. CCY TX WITHIN 30 DAYS", F.col("at"), text, currency, days, rank_by=keys),
            _branch(used, cfg, schema, late, F.col("at"), text, currency, until, after, rank_by=keys),
        ]
    )


def card_funnel(s: Sources, cfg: FunnelConfig) -> DataFrame:
    schema, none, profile = COHORT_FUNNEL_SCHEMA, F.lit("N/A"), _text("profile_id")
    days = F.col("days_first_card_creation_to_five_transaction")

    def timed(label, column, until):
        at = F.col(column)
        return _branch(_on_card(s, cfg), cfg, schema, label, at, F.concat(profile, _time(column)), none, until)

    return _union(
        [
            _start(s, cfg, schema),
            timed("2. CARD ORDERED 30D", "first_card_order_time", cfg.card_issue_days),
            timed("3. CARD ISSUED 30D", "first_card_creation_time", cfg.card_issue_days),
            timed("4. CARD ACTIVATED 60D", "first_activation_time", cfg.card_activation_days),
            _branch(
                _on_card(s, cfg),
                cfg,
                schema,
                "5. FIVE TX 90D",
                _after(F.col("created"), days),
                F.concat(profile, _time("first_activation_time"), days.cast("string")),
                none,
                cfg.card_five_tx_days,
            ),
        ]
    )

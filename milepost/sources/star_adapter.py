"""The nine input tables derived from a customer / orders / lineitem star schema.

Integer arithmetic only, so that any engine gets the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from milepost.config import PERSONAL_CLASS, PRIMARY_ADDRESS_TYPE, SUPPORTED_CURRENCIES
from milepost.sources.tables import Sources

# All derived profiles are created in the nineties.
START_DATE = "1995-03-01"
BUSINESS_CLASS = "business"
CURRENCIES = (*SUPPORTED_CURRENCIES, "JPY", "INR")
_DAY_SECONDS = 86400

# The columns read. Given, so that opening a table costs no look into its files.
_COLUMNS = {
    "customer": "c_custkey long, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_linenumber int, l_returnflag string",
}


def _currency(number: str) -> Column:
    names = ", ".join(f"'{name}'" for name in CURRENCIES)
    return F.expr(f"element_at(array({names}), cast(({number}) % {len(CURRENCIES)} + 1 as int))")


def _add_seconds(moment: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, moment)


def _add_days(moment: Column, days: Column) -> Column:
    return F.timestamp_add("DAY", days, moment)


def star_sources(spark: SparkSession, directory: str, fan_out: bool = False) -> Sources:
    """The nine tables. With ``fan_out`` some customers have a second account, primary address and card summary."""

    def read(name: str) -> DataFrame:
        return spark.read.schema(_COLUMNS[name]).parquet(f"{directory}/{name}.parquet")

    own = F.col("c") + 1000000
    if fan_out:
        own = F.when((F.col("c") % 7 == 3) & (F.col("k") % 4 == 1), F.col("c") + 2000000).otherwise(own)
    customer, nation, lineitem = read("customer"), read("nation"), read("lineitem")
    order = read("orders").select(
        F.col("o_orderkey").alias("k"),
        F.col("o_custkey").alias("c"),
        F.col("o_orderstatus").alias("st"),
        F.col("o_orderpriority").alias("pr"),
        _add_seconds(F.col("o_orderdate"), F.col("o_orderkey") % _DAY_SECONDS).alias("t"),
    )
    line = lineitem.select("l_orderkey", "l_linenumber", "l_returnflag").join(order, F.col("l_orderkey") == F.col("k"))
    return Sources.of(
        {
            "user_profile": _user_profile(customer, order),
            "address": _address(customer, nation, fan_out),
            "account": _account(customer, fan_out),
            "balance": order.where(F.col("pr").isin("1-URGENT", "2-HIGH", "3-MEDIUM")).select(
                F.col("k").alias("id"),
                own.alias("account_id"),
                _currency("k").alias("currency"),
                F.col("t").alias("creation_time"),
            ),
            "balance_transaction": order.select(
                F.col("k").alias("id"),
                own.alias("account_id"),
                F.when(F.col("st") == "O", "PENDING").otherwise("COMPLETED").alias("state"),
                F.when(F.col("pr").isin("1-URGENT", "2-HIGH"), "DEPOSIT").otherwise("CONVERSION").alias("type"),
                F.col("t").alias("creation_time"),
            ),
            "bank_details_order_status": _bank_details(order),
            "action_step": _actions(line),
            "receive_transactions": line.where("l_returnflag = 'R'").select(
                (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request_id"),
                F.col("c").alias("profile_id"),
                _currency("l_orderkey + l_linenumber").alias("bank_detail_currency"),
                _add_days(F.col("t"), F.col("l_linenumber")).alias("receival_date"),
            ),
            "card_issuance_summary": _cards(order, fan_out),
        }
    )


def _user_profile(customer: DataFrame, order: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    firsts = order.groupBy("c").agg(F.min("t").alias("t0"))
    started = F.coalesce("t0", F.lit("1995-06-01 00:00:00").cast("timestamp_ntz"))
    return customer.join(firsts, key == F.col("c"), "left").select(
        key.alias("id"),
        _add_days(started, (-(key % 120)).cast("int")).alias("date_created"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), BUSINESS_CLASS)
        .when(key % 23 != 0, PERSONAL_CLASS)
        .alias("class"),
    )


def _account(customer: DataFrame, fan_out: bool) -> DataFrame:
    def numbered(rows: DataFrame, offset: int) -> DataFrame:
        return rows.select((F.col("c_custkey") + offset).alias("id"), F.col("c_custkey").alias("profile_id"))

    first = numbered(customer.where("c_custkey % 10 <> 9"), 1000000)
    return first.unionByName(numbered(customer.where("c_custkey % 7 = 3"), 2000000)) if fan_out else first


def _address(customer: DataFrame, nation: DataFrame, fan_out: bool) -> DataFrame:
    def in_nation(rows: DataFrame, number: Column) -> DataFrame:
        return rows.join(nation, number == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("user_profile_id"),
            F.lit(PRIMARY_ADDRESS_TYPE).alias("address_type"),
            F.col("n_name").alias("country_code"),
        )

    primary = in_nation(customer.where("c_custkey % 50 <> 7"), F.col("c_nationkey"))
    if fan_out:
        primary = primary.unionByName(in_nation(customer.where("c_custkey % 11 = 4"), (F.col("c_nationkey") + 1) % 25))
    secondary = customer.where("c_custkey % 3 = 0").select(
        F.col("c_custkey").alias("user_profile_id"),
        F.lit("SECONDARY_ADDRESS").alias("address_type"),
        F.lit("ZZ").alias("country_code"),
    )
    return primary.unionByName(secondary)


def _bank_details(order: DataFrame) -> DataFrame:
    key, placed = F.col("k"), F.col("t")
    return order.select(
        key.alias("order_id"),
        F.col("c").alias("profile_id"),
        _currency("k").alias("currency"),
        F.when(key % 11 != 0, placed).alias("bankdetail_initiation_time"),
        F.when(key % 3 != 0, _add_days(placed, F.lit(2))).alias("verification_completion_time"),
        F.when(F.col("st") == "O", "PENDING").otherwise("DONE").alias("verification_status"),
        (F.col("st") == "F").alias("bank_details_issued"),
        F.when(key % 13 != 0, _add_days(placed, F.lit(5))).alias("bankdetail_issuance_time"),
    )


def _actions(line: DataFrame) -> DataFrame:
    key, number = F.col("l_orderkey"), F.col("l_linenumber")
    return line.select(
        (key * 10 + number).alias("action_id"),
        F.col("c").alias("user_profile_id"),
        _add_days(F.col("t"), number).alias("action_completion_time"),
        _currency("l_orderkey").alias("source_currency"),
        _currency("l_orderkey div 12 + l_linenumber").alias("target_currency"),
        F.when(key % 5 == 0, 0).otherwise(1).alias("successful_action"),
        F.when(key % 4 == 0, "SEND").otherwise("BALANCE").alias("product_type"),
        F.when(number % 7 == 0, 0).otherwise(1).alias("flag_for_aggregations"),
    )


def _cards(order: DataFrame, fan_out: bool) -> DataFrame:
    key, first = F.col("c"), F.col("t0")
    firsts = order.where("pr <> '5-LOW'").groupBy("c").agg(F.min("t").alias("t0"))
    cards = firsts.select(
        key.alias("user_id"),
        (key + 500000).alias("profile_id"),
        first.alias("first_card_order_time"),
        F.when(key % 8 != 0, _add_days(first, F.lit(4))).alias("first_card_creation_time"),
        F.when(key % 6 != 0, _add_days(first, (key % 40).cast("int"))).alias("first_activation_time"),
        F.when(key % 9 != 0, key % 130).cast("int").alias("days_first_card_creation_to_five_transaction"),
    )
    if not fan_out:
        return cards
    second = firsts.where("c % 13 = 5").select(
        key.alias("user_id"),
        (key + 700000).alias("profile_id"),
        _add_days(first, F.lit(1)).alias("first_card_order_time"),
        _add_days(first, F.lit(6)).alias("first_card_creation_time"),
        _add_days(first, (key % 50).cast("int")).alias("first_activation_time"),
        (key % 100).cast("int").alias("days_first_card_creation_to_five_transaction"),
    )
    return cards.unionByName(second)

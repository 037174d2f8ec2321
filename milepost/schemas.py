"""Column contracts of the nine source tables and the three outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DataType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

_LONG, _INT, _STR, _BOOL, _TS = LongType(), IntegerType(), StringType(), BooleanType(), TimestampNTZType()


def _schema(**columns: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


SOURCE_SCHEMAS: dict[str, StructType] = {
    "user_profile": _schema(**{"id": _LONG, "date_created": _TS, "class": _STR}),
    "address": _schema(user_profile_id=_LONG, address_type=_STR, country_code=_STR),
    "account": _schema(id=_LONG, profile_id=_LONG),
    "balance": _schema(id=_LONG, account_id=_LONG, currency=_STR, creation_time=_TS),
    "balance_transaction": _schema(id=_LONG, account_id=_LONG, state=_STR, type=_STR, creation_time=_TS),
    "bank_details_order_status": _schema(
        order_id=_LONG,
        profile_id=_LONG,
        currency=_STR,
        bankdetail_initiation_time=_TS,
        verification_completion_time=_TS,
        verification_status=_STR,
        bank_details_issued=_BOOL,
        bankdetail_issuance_time=_TS,
    ),
    "action_step": _schema(
        action_id=_LONG,
        user_profile_id=_LONG,
        action_completion_time=_TS,
        source_currency=_STR,
        target_currency=_STR,
        successful_action=_INT,
        product_type=_STR,
        flag_for_aggregations=_INT,
    ),
    "receive_transactions": _schema(request_id=_LONG, profile_id=_LONG, bank_detail_currency=_STR, receival_date=_TS),
    "card_issuance_summary": _schema(
        user_id=_LONG,
        profile_id=_LONG,
        first_card_order_time=_TS,
        first_card_creation_time=_TS,
        first_activation_time=_TS,
        days_first_card_creation_to_five_transaction=_INT,
    ),
}

ACCOUNT_FUNNEL_SCHEMA = _schema(
    profile_id=_LONG, currency=_STR, profile_date_created=_TS, date=_TS, event=_STR, event_id=_STR
)

# The balance and the card funnel share this layout.
COHORT_FUNNEL_SCHEMA = _schema(
    profile_id=_LONG,
    profile_type=_STR,
    country_code=_STR,
    currency=_STR,
    cohort_month=_TS,
    cohort_week=_TS,
    profile_date_created=_TS,
    date=_TS,
    event=_STR,
    event_id=_STR,
)

CONVERSION_SCHEMA = _schema(event=_STR, event_count=_LONG, pct_of_profiles=DoubleType())


def conform(df: DataFrame, schema: StructType, what: str) -> DataFrame:
    """``df`` cut to the columns of ``schema``, in its order.

    Numbers of another width are cast. A missing column, or one of another
    kind, is an error here rather than a wrong row later.
    """
    present = {field.name.lower(): field.dataType for field in df.schema.fields}
    columns: list[str | Column] = []
    faults = []
    for field in schema.fields:
        found = present.get(field.name.lower())
        if found is None:
            faults.append(f"{field.name} is missing")
        elif found == field.dataType:
            columns.append(field.name)
        elif _castable(found.simpleString(), field.dataType.simpleString()):
            columns.append(F.col(field.name).cast(field.dataType).alias(field.name))
        else:
            faults.append(f"{field.name} is {found.simpleString()}, expected {field.dataType.simpleString()}")
    if faults:
        raise ValueError(f"{what}: " + "; ".join(faults))
    return df.select(*columns)


def _castable(found: str, wanted: str) -> bool:
    whole = ("tinyint", "smallint", "int", "bigint")
    if wanted in whole:
        return found in whole or (found.startswith("decimal") and found.endswith(",0)"))
    if wanted == "timestamp_ntz":
        # Not "timestamp": which wall-clock time it stands for would depend on the session's zone.
        return found == "date"
    return wanted == "string" and found.startswith(("char", "varchar"))

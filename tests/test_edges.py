"""Sources, sinks and column functions at their edges."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from milepost.config import FunnelConfig
from milepost.functions.columns import cohort_month, cohort_week, id_with_time, time_text
from milepost.plans.account import account_funnel
from milepost.plans.card import card_funnel
from milepost.plans.conversion import conversion
from milepost.schemas import SOURCE_SCHEMAS, conform
from milepost.sinks.publish import publish_replace, publish_staged_swap
from milepost.sources import Sources
from tests.helpers import bag, make_sources


def test_replace_twice_and_report_from_the_table(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS reports")
    first = make_sources(spark)
    table = publish_replace(account_funnel(first), "reports", "account_funnel")
    assert table.count() == 1
    table = publish_replace(account_funnel(first).limit(0), "reports", "account_funnel")
    assert table.count() == 0
    table = publish_replace(account_funnel(first), "reports", "account_funnel")
    assert [tuple(row) for row in conversion(table).collect()] == [("1. PROFILE_CREATED", 1, 100.0)]


@pytest.mark.parametrize("publish", [publish_replace, publish_staged_swap])
def test_a_failing_query_leaves_the_old_table_whole(spark, publish):
    spark.sql("CREATE DATABASE IF NOT EXISTS reports")
    publish(spark.range(3), "reports", "kept")
    failing = spark.range(9).select(F.when(F.col("id") > 5, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        publish(failing, "reports", "kept")
    assert spark.table("reports.kept").count() == 3


def test_staged_swap_twice(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS reports")
    funnel = card_funnel(make_sources(spark))
    for rows in (funnel, funnel.limit(0), funnel):
        table = publish_staged_swap(rows, "reports", "card_funnel")
        assert bag(table) == bag(rows)
        assert not spark.catalog.tableExists("reports.card_funnel_load")


def test_staged_swap_replaces_a_left_over_staging_table(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS reports")
    funnel = card_funnel(make_sources(spark))
    publish_replace(spark.range(3), "reports", "left_over_load")
    assert bag(publish_staged_swap(funnel, "reports", "left_over")) == bag(funnel)


def test_sources_from_parquet_and_catalog(spark, tmp_path):
    tables = vars(make_sources(spark))
    paths = {name: str(tmp_path / name) for name in tables}
    for name, df in tables.items():
        df.write.parquet(paths[name])
    read = Sources.from_parquet(spark, paths)
    assert bag(account_funnel(read)) == bag(account_funnel(make_sources(spark)))
    spark.sql("CREATE DATABASE IF NOT EXISTS given")
    for name, df in tables.items():
        df.write.mode("overwrite").saveAsTable(f"given.{name}")
    read = Sources.from_catalog(spark, {name: f"given.{name}" for name in tables})
    assert bag(account_funnel(read)) == bag(account_funnel(make_sources(spark)))


def test_missing_table_and_column_and_wrong_type(spark):
    with pytest.raises(ValueError, match="missing source tables: user_profile"):
        Sources.of({})
    schema = SOURCE_SCHEMAS["account"]
    with pytest.raises(ValueError, match="account: profile_id is missing"):
        conform(spark.range(1), schema, "account")
    with pytest.raises(ValueError, match="id is string, expected bigint"):
        conform(spark.sql("SELECT 'a' AS id, 1 AS profile_id"), schema, "account")


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_zoned_times_are_refused_in_any_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        zoned = spark.sql("SELECT 1L AS id, timestamp'2020-01-01 00:00:00' AS date_created, 'x' AS class")
        with pytest.raises(ValueError, match="date_created is timestamp, expected timestamp_ntz"):
            conform(zoned, SOURCE_SCHEMAS["user_profile"], "user_profile")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_narrow_numbers_upper_case_names_and_extra_columns_are_accepted(spark):
    df = conform(spark.sql("SELECT 1 AS extra, 2 AS PROFILE_ID, 3BD AS ID"), SOURCE_SCHEMAS["account"], "account")
    assert [(field.name.lower(), field.dataType.simpleString()) for field in df.schema.fields] == [
        ("id", "bigint"),
        ("profile_id", "bigint"),
    ]


def test_config_is_checked():
    with pytest.raises(ValueError):
        FunnelConfig(start_date="soon")
    with pytest.raises(ValueError, match="late_window"):
        FunnelConfig(late_window=(90, 30))


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin", "America/New_York"])
def test_times_do_not_depend_on_the_session_time_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # 02:30 on these days does not exist in the two zones.
        moments = ["2021-03-28 02:30:00", "2021-03-14 02:30:00.12", "2021-03-14 02:30:00.123456"]
        df = spark.createDataFrame([(datetime.fromisoformat(text),) for text in moments], "at timestamp_ntz")
        row = [
            tuple(r) for r in df.select(time_text(F.col("at")), cohort_month(F.col("at")), cohort_week(F.col("at"))).collect()
        ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    month = datetime(2021, 3, 1)
    assert row == [
        ("2021-03-28 02:30:00.000", month, datetime(2021, 3, 22)),
        ("2021-03-14 02:30:00.120", month, datetime(2021, 3, 8)),
        ("2021-03-14 02:30:00.123", month, datetime(2021, 3, 8)),
    ]


def test_id_is_null_if_a_part_is(spark):
    df = spark.sql("SELECT 1L AS id, cast(null AS timestamp_ntz) AS at")
    assert df.select(id_with_time(F.col("id"), F.col("at"))).first()[0] is None

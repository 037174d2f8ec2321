"""The library's plans against the plain form, skewed input, and reordered input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from checks import plain_form
from milepost.operators.hot_keys import hot_keys, join_many_to_one
from milepost.operators.paths import action_path
from milepost.plans import account, balance, card
from milepost.sources import Sources
from milepost.sources.star_adapter import star_sources
from tests.helpers import action, bag, make_sources

FUNNELS = {
    "account": (account.account_funnel, plain_form.account_funnel),
    "balance": (balance.balance_funnel, plain_form.balance_funnel),
    "card": (card.card_funnel, plain_form.card_funnel),
}


@pytest.mark.parametrize("name", FUNNELS)
def test_same_as_plain_form(sources_small, config, name):
    built, plain = FUNNELS[name]
    assert bag(built(sources_small, config)) == bag(plain(sources_small, config))


@pytest.fixture(scope="module")
def skewed(spark, testdata) -> Sources:
    """A third and more of every fact table under one profile or account."""
    tables = dict(vars(star_sources(spark, f"{testdata}/sf0.001")))
    hot = F.col("order_id") % 3 == 0
    tables["bank_details_order_status"] = tables["bank_details_order_status"].withColumn(
        "profile_id", F.when(hot, 2).otherwise(F.col("profile_id"))
    )
    for name in ("balance", "balance_transaction"):
        tables[name] = tables[name].withColumn(
            "account_id", F.when(F.col("id") % 3 == 0, 1000002).otherwise(F.col("account_id"))
        )
    tables["account"] = tables["account"].withColumn(
        "profile_id", F.when(F.col("id") % 3 == 0, 2).otherwise(F.col("profile_id"))
    )
    tables["action_step"] = tables["action_step"].withColumn(
        "user_profile_id", F.when(F.col("action_id") % 3 == 0, 2).otherwise(F.col("user_profile_id"))
    )
    tables["receive_transactions"] = tables["receive_transactions"].withColumn(
        "profile_id", F.when(F.col("request_id") % 3 == 0, 2).otherwise(F.col("profile_id"))
    )
    tables["card_issuance_summary"] = tables["card_issuance_summary"].withColumn(
        "user_id", F.when(F.col("user_id") % 3 == 0, 2).otherwise(F.col("user_id"))
    )
    return Sources.of(tables)


@pytest.mark.parametrize("name", FUNNELS)
def test_same_as_plain_form_on_skewed_keys(skewed, config, name):
    built, plain = FUNNELS[name]
    assert bag(built(skewed, config)) == bag(plain(skewed, config))


@pytest.mark.parametrize("name", FUNNELS)
def test_input_order_does_not_matter(sources_small, config, name):
    shuffled = Sources(**{key: df.orderBy(F.rand(7)) for key, df in vars(sources_small).items()})
    built, _ = FUNNELS[name]
    assert bag(built(shuffled, config)) == bag(built(sources_small, config))


def test_hot_keys_are_found_with_their_share(spark):
    rows = spark.range(9000).select(F.when(F.col("id") < 3000, -1).otherwise(F.col("id")).alias("key"))
    assert [tuple(row) for row in hot_keys(rows, "key").collect()] == [(-1, 3)]
    assert hot_keys(spark.range(9000).withColumnRenamed("id", "key"), "key").collect() == []
    assert hot_keys(rows.limit(0), "key").collect() == []


def test_no_hot_key_is_left_out_however_many_there_are(spark):
    # 2000 keys of two partitions' worth each, if there are 4000 partitions.
    rows = spark.range(0, 400_000).select((F.col("id") % 2000).alias("key"))
    assert sorted(tuple(row) for row in hot_keys(rows, "key", 4000).collect()) == [(key, 2) for key in range(2000)]


def test_hot_key_rows_are_dealt_over_several_parts(spark):
    spread = spark.range(9000).select(F.when(F.col("id") < 3000, -1).otherwise(F.col("id")).alias("key"), "id")
    one = spark.range(-1, 9000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("value"))
    joined = join_many_to_one(spread, one, "key", "id")
    assert joined.columns == ["key", "id", "value"]
    assert bag(joined) == bag(spread.join(one, "key"))


def test_no_task_gets_a_whole_hot_group(spark):
    many = spark.range(9000).select(F.when(F.col("id") < 6000, -1).otherwise(F.col("id")).alias("key"), "id")
    one = spark.range(-1, 9000).select(F.col("id").alias("key"))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        joined = join_many_to_one(many, one, "key", "id").where("key = -1")
        sizes = [row["count"] for row in joined.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sum(sizes) == 6000
    assert max(sizes) <= 4000 and len(sizes) > 2


def test_join_drops_null_and_unmatched_keys(spark):
    many = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (3, "c")], "key long, name string")
    one = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "key long, value string")
    assert bag(join_many_to_one(many, one, "key", "name")) == bag(many.join(one, "key"))


def test_left_path_keeps_holders_without_actions(spark, config):
    sources = make_sources(
        spark, account=[(5, 1), (6, 1)], action_step=[action(1, "GBP", "JPY"), action(2, "GBP", "EUR", ok=0)]
    )
    found = sorted((row.account_id, row.action_id) for row in action_path(sources, config).collect())
    assert found == [(5, 1), (6, 1)]
    idle = make_sources(spark, account=[(5, 1)], action_step=[action(2, "GBP", "EUR", ok=0)])
    assert [(row.account_id, row.action_id) for row in action_path(idle, config).collect()] == [(5, None)]

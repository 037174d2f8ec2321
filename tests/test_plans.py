"""What the plans read, shuffle and split."""

from __future__ import annotations

import re
from collections import Counter
from contextlib import contextmanager
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from milepost.operators import paths
from milepost.operators.cohort import cohort_keys
from milepost.operators.events import first_events
from milepost.operators.hot_keys import join_many_to_one, join_split
from milepost.plans import account, balance, card
from milepost.sinks.layout import BUCKETED_BY, bucketed, spreads
from milepost.sources import Sources
from tests.helpers import at, bag, make_sources

FUNNELS = {"account": account.account_funnel, "balance": balance.balance_funnel, "card": card.card_funnel}


@contextmanager
def settings(spark, **values):
    named = {"spark.sql." + name.replace("__", "."): value for name, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in named}
    for name, value in named.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _nodes(plan):
    """The nodes of an executed plan, through adaptive stages."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from _nodes(plan.executedPlan())
    elif kind.endswith("QueryStageExec"):
        yield from _nodes(plan.plan())
    else:
        yield kind, plan
        children = plan.children()
        for k in range(children.size()):
            yield from _nodes(children.apply(k))


def shuffled_bytes(df) -> int:
    df.collect()
    exchanges = [plan for kind, plan in _nodes(df._jdf.queryExecution().executedPlan()) if kind == "ShuffleExchangeExec"]
    return sum(plan.metrics().get("dataSize").get().value() for plan in exchanges)


@pytest.fixture(scope="module")
def stored(spark, sources_small, tmp_path_factory) -> Sources:
    """The sources as files, as they are in production."""
    folder = tmp_path_factory.mktemp("sources")
    for name, df in vars(sources_small).items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return Sources.from_parquet(spark, {name: f"{folder}/{name}.parquet" for name in vars(sources_small)})


def _scans(df) -> Counter:
    """How often each table is read by the plan."""
    with settings(df.sparkSession, maxMetadataStringLength="1000"):
        return Counter(re.findall(r"FileScan parquet [^\n]*?Location: InMemoryFileIndex[^\n]*?/(\w+)\.parquet", _plan(df)))


def test_an_adaptive_join_splits_a_hot_key(spark):
    many = spark.range(0, 60_000, 1, 16).select(F.when(F.col("id") < 40_000, -1).otherwise(F.col("id")).alias("key"), "id")
    one = spark.range(-1, 60_000).repartition(3).select(F.col("id").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    small = {"advisoryPartitionSizeInBytes": "16k", "skewJoin__skewedPartitionThresholdInBytes": "16k", "skewJoin__skewedPartitionFactor": "1.5"}
    adaptive = {f"adaptive__{name}": value for name, value in small.items()}
    with settings(spark, autoBroadcastJoinThreshold="-1", adaptive__autoBroadcastJoinThreshold="-1", **adaptive):
        plain = many.join(one, "key")
        assert bag(plain).total() == 60_000 and "skew=true" not in _plan(plain)
        joined = join_split(many, one, "key")
        assert joined.columns == ["key", "id", "n"]
        assert bag(joined) == bag(plain) and "skew=true" in _plan(joined)
        tasks = Counter(r["task"] for r in joined.withColumn("task", F.spark_partition_id()).collect())
        assert max(tasks.values()) < 20_000


def test_an_outer_join_keeps_unmatched_rows_once(spark):
    many = spark.range(9000).select(F.when(F.col("id") < 3000, -1).otherwise(F.col("id")).alias("key"), "id")
    one = spark.range(-1, 12_000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("value"))
    one = one.unionByName(one.where("key < 0"))
    joined = join_many_to_one(many, one, "key", "id", unmatched=True)
    assert bag(joined) == bag(one.join(many, "key", "left"))


def test_each_fact_is_read_once_by_its_path(stored, config):
    for path, table in (
        (paths.order_path, "bank_details_order_status"),
        (paths.receipt_path, "receive_transactions"),
        (paths.card_path, "card_issuance_summary"),
        (paths.balance_path, "balance"),
        (paths.account_holders, "account"),
    ):
        assert _scans(path(stored, config))[table] == 1, table
    assert _scans(paths.action_path(stored, config))["account"] == 1
    assert _scans(account.first_actions(stored, config)) == {"action_step": 1, "account": 1}
    assert _scans(balance.account_facts(stored)) == {"balance": 1, "balance_transaction": 1}
    read = _scans(account.account_funnel(stored, config))
    assert all(read[name] == 1 for name in ("balance", "bank_details_order_status", "action_step", "receive_transactions"))
    assert _scans(balance.balance_funnel(stored, config))["balance_transaction"] == 1
    assert _scans(card.card_funnel(stored, config))["card_issuance_summary"] == 1


def test_an_account_whose_balance_has_no_currency_counts(spark):
    opened, used = at("2020-02-02"), at("2020-02-03")
    sources = make_sources(
        spark,
        account=[(100, 1), (101, 1)],
        balance=[(5, 100, None, opened)],
        balance_transaction=[(7, 100, "COMPLETED", "DEPOSIT", used), (8, 101, "COMPLETED", "DEPOSIT", at("2020-02-01"))],
    )
    rows = [r for r in balance.balance_funnel(sources).collect() if r["event"] == "3. TOPPED UP"]
    assert [(r["event_id"], r["currency"], r["date"]) for r in rows] == [("7", None, used)]


@pytest.fixture(scope="module")
def late(stored, config):
    """A start date that leaves about 3 % of the profiles."""
    created = [r[0] for r in stored.user_profile.select("date_created").orderBy("date_created").collect()]
    return replace(config, start_date=str(created[int(len(created) * 0.97)]))


@pytest.mark.parametrize("name", FUNNELS)
def test_a_small_cohort_is_filtered_before_the_shuffle(spark, stored, late, name, monkeypatch):
    keys = cohort_keys(stored, late)
    assert 0 < keys.count() <= 0.04 * stored.user_profile.count()
    with settings(spark, autoBroadcastJoinThreshold="-1", adaptive__autoBroadcastJoinThreshold="-1"):
        filtered = FUNNELS[name](stored, late)
        few = shuffled_bytes(filtered)
        module = {"account": account, "balance": balance, "card": card}[name]
        with monkeypatch.context() as patch:
            patch.setattr(module, "cohort_keys", lambda *_: None)
            whole = FUNNELS[name](stored, late)
            all_facts = shuffled_bytes(whole)
        assert bag(filtered) == bag(whole)
    assert bag(filtered).total() > 0
    # Addresses and accounts are shuffled either way.
    assert few < (0.5 if name == "card" else 0.35) * all_facts, (few, all_facts)


def test_a_large_cohort_is_not_sent_around(stored, config, monkeypatch, late):
    assert cohort_keys(stored, config) is None  # 61 % of the profiles
    monkeypatch.setattr("milepost.operators.cohort.BROADCAST_KEYS", 3)
    assert cohort_keys(stored, late) is None


@pytest.fixture(scope="module")
def laid_out(spark, stored) -> Sources:
    spark.sql("CREATE DATABASE IF NOT EXISTS layouts")
    return bucketed(stored, "layouts", 4)


def test_bucketed_sources_have_the_same_rows(laid_out, stored):
    assert set(BUCKETED_BY) == set(vars(stored))
    for name, df in vars(stored).items():
        assert bag(getattr(laid_out, name)) == bag(df)


def _exchanges(df) -> int:
    return _plan(df).count("Exchange hashpartitioning")


def test_first_events_of_bucketed_facts_are_found_without_a_shuffle(spark, laid_out, stored, config):
    transactions = first_events(paths.transactions(laid_out), ["account_id"], balance.transaction_events())
    firsts = {
        "orders (W3 to W5)": account.first_orders(laid_out, config),
        "receipts (W7)": account.first_receipts(laid_out, config),
        "balances (W1, W2)": first_events(paths.balances(laid_out), ["account_id"], account.balance_events(config)),
        "actions (W6)": first_events(
            laid_out.action_step.withColumnRenamed("user_profile_id", "profile_id"), ["profile_id"], account.action_events(config)
        ),
        "transactions (W8, W9)": transactions,
        "accounts (W8, W9)": balance.account_facts(laid_out),
    }
    for name, df in firsts.items():
        assert _exchanges(df) == 0 and "Bucketed: true" in _plan(df), name
    with settings(spark, autoBroadcastJoinThreshold="-1"):
        # From the account to its profile there is one.
        assert _exchanges(account.first_balances(laid_out, config)) == 1
        assert _exchanges(balance.first_transactions(laid_out, config)) == 1
        assert _exchanges(account.first_balances(stored, config)) >= 3
        # Orders meet the cohort where they are.
        assert _exchanges(account.account_stage("account_4_bank_detail_requested", laid_out, config)) == 0


@pytest.mark.parametrize("name", FUNNELS)
def test_funnels_of_bucketed_sources_are_the_same(laid_out, stored, config, name):
    assert bag(FUNNELS[name](laid_out, config)) == bag(FUNNELS[name](stored, config))


def test_a_table_with_a_hot_key_is_not_bucketed(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS hot_layouts")
    hot = [(k, 1 if k % 3 == 0 else k, "GBP", at("2020-02-02")) for k in range(300)]
    sources = make_sources(spark, balance=hot, user_profile=[(k, at("2020-02-01"), None) for k in range(300)])
    written = bucketed(sources, "hot_layouts", 4)
    assert "Bucketed: true" in _plan(written.user_profile.groupBy("id").count())
    assert "Bucketed: true" not in _plan(written.balance.groupBy("account_id").count())
    assert bag(written.balance) == bag(sources.balance)
    empty = spark.createDataFrame([], "k long")
    assert spreads(empty, "k", 4) and not spreads(spark.range(100).select(F.lit(None).cast("long").alias("k")), "k", 4)

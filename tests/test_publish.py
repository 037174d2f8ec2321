"""Publication: readers during a replacement, runs that die at any step, runs at the same time, and the layout by event."""

from __future__ import annotations

import re
import threading
import time

import pytest
from pyspark.sql import functions as F

from milepost.plans.account import account_funnel
from milepost.plans.conversion import conversion, of_event, profile_base
from milepost.sinks import catalog, publish
from milepost.sinks.catalog import Lease, PublicationInProgress
from milepost.sinks.publish import publish_replace, publish_staged_swap, recover, versions
from tests.helpers import bag

SCHEMA = "publications"


@pytest.fixture(autouse=True)
def schema(spark):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {SCHEMA}")


def _left(spark, name: str) -> set[str]:
    """Everything in the catalog that belongs to the table, but for its name."""
    names = {row["tableName"] for row in spark.sql(f"SHOW TABLES IN {SCHEMA}").collect()}
    return {re.sub("[0-9a-f]{12,}", "", found[len(name) :]) for found in names if found.startswith(name)}


def _rows(spark, value: int, n: int = 100):
    return spark.range(n).select(F.lit(value).alias("value"), "id")


def _value(spark, name: str) -> int:
    return spark.table(f"{SCHEMA}.{name}").select("value").distinct().collect()[0][0]


def test_a_polling_reader_never_misses_the_table(spark):
    publish_replace(_rows(spark, 0), SCHEMA, "polled", keep=2)
    seen, faults, done = [], [], threading.Event()

    def poll():
        while not done.is_set():
            try:
                row = spark.table(f"{SCHEMA}.polled").agg(F.min("value"), F.max("value"), F.count("*")).first()
                seen.append(tuple(row))
            except Exception as error:  # noqa: BLE001
                faults.append(error)

    readers = [threading.Thread(target=poll) for _ in range(3)]
    for reader in readers:
        reader.start()
    for value in range(1, 8):
        publish_replace(_rows(spark, value), SCHEMA, "polled", keep=2)
    done.set()
    for reader in readers:
        reader.join()
    assert not faults
    assert all(low == high and n == 100 for low, high, n in seen)
    assert len({low for low, _, _ in seen}) > 2
    assert len(versions(spark, SCHEMA, "polled")) == 3


def test_a_query_that_has_begun_reads_its_version(spark):
    first = publish_replace(_rows(spark, 1), SCHEMA, "pinned")
    second = publish_replace(_rows(spark, 2), SCHEMA, "pinned")
    assert {r["value"] for r in first.collect()} == {1} and {r["value"] for r in second.collect()} == {2}
    # And may read what it replaces, with other columns.
    third = publish_replace(spark.table(f"{SCHEMA}.pinned").withColumn("more", F.col("value") + 1), SCHEMA, "pinned", keep=0)
    assert third.columns == ["value", "id", "more"] and third.count() == 100
    assert _left(spark, "pinned") == {"", "_v"} and len(versions(spark, SCHEMA, "pinned")) == 1


def test_a_plain_table_becomes_the_first_version(spark):
    _rows(spark, 1).write.saveAsTable(f"{SCHEMA}.plain")
    assert publish_replace(_rows(spark, 2), SCHEMA, "plain").select("value").first()[0] == 2
    assert len(versions(spark, SCHEMA, "plain")) == 2
    assert publish_staged_swap(_rows(spark, 3), SCHEMA, "plain").select("value").first()[0] == 3
    assert _left(spark, "plain") == {""} and spark.catalog.getTable(f"{SCHEMA}.plain").tableType == "MANAGED"


@pytest.mark.parametrize("write", [publish_replace, publish_staged_swap])
@pytest.mark.parametrize("before", [True, False])
def test_a_failing_query_leaves_nothing(spark, write, before):
    name = f"failing_{write.__name__}_{before}".lower()
    if before:
        write(_rows(spark, 1), SCHEMA, name)
    found = _left(spark, name)
    failing = spark.range(9).select(F.when(F.col("id") > 5, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        write(failing, SCHEMA, name)
    assert _left(spark, name) == found
    assert not before or _value(spark, name) == 1


class Died(BaseException):
    pass


def _dies(monkeypatch, step: int, write, *args) -> int:
    """Runs a publication that dies at its step-th change of the catalog, with no time to clean up. Returns the changes made."""
    made = 0

    def counted(plain):
        def call(*given):
            nonlocal made
            if made == step:
                raise Died
            made += 1
            return plain(*given)

        return call

    def halted(self):
        self._stop.set()
        self._thread.join()

    with monkeypatch.context() as patch:
        for name in ("rename", "drop", "_point"):
            patch.setattr(publish, name, counted(getattr(publish, name)))
        patch.setattr(Lease, "give_back", halted)
        try:
            write(*args, lease_seconds=0.2)
        except Died:
            return made
        return -1


@pytest.mark.parametrize("write", [publish_replace, publish_staged_swap])
def test_what_a_dead_run_left_is_finished_or_undone(spark, monkeypatch, write):
    step = 0
    while True:
        name = f"died_{write.__name__}_{step}".lower()
        _rows(spark, 1).write.saveAsTable(f"{SCHEMA}.{name}")
        over = _dies(monkeypatch, step, write, _rows(spark, 2), SCHEMA, name) < 0
        time.sleep(0.3)
        if step % 2:
            assert recover(spark, SCHEMA, name).count() == 100
            assert _value(spark, name) in (1, 2)
        write(_rows(spark, 3), SCHEMA, name)
        assert _value(spark, name) == 3
        assert _left(spark, name) <= {"", "_v"} and len(versions(spark, SCHEMA, name)) <= 2
        if over:
            break
        step += 1
    assert step >= 4


def test_between_the_renames_the_new_rows_are_found_again(spark, monkeypatch):
    _rows(spark, 1).write.saveAsTable(f"{SCHEMA}.between")
    real = publish.rename

    def rename(spark, schema, old, new):
        if new == "between":
            raise Died
        real(spark, schema, old, new)

    with monkeypatch.context() as patch:
        patch.setattr(publish, "rename", rename)
        with pytest.raises(Died):
            publish_staged_swap(_rows(spark, 2), SCHEMA, "between")
    assert not spark.catalog.tableExists(f"{SCHEMA}.between")
    assert recover(spark, SCHEMA, "between").select("value").distinct().collect() == [(2,)]
    assert _left(spark, "between") == {""}
    assert recover(spark, SCHEMA, "never_there") is None


@pytest.mark.parametrize("write", [publish_replace, publish_staged_swap])
def test_two_runs_do_not_publish_at_once(spark, write):
    name = f"twice_{write.__name__}"
    with catalog.lease(spark, SCHEMA, name, 1.0) as first:
        time.sleep(1.5)  # longer than the lease, which its thread renews
        with pytest.raises(PublicationInProgress, match="held by another run"):
            write(_rows(spark, 1), SCHEMA, name)
        first.check()
    assert write(_rows(spark, 1), SCHEMA, name).count() == 100


def test_a_lapsed_lease_is_taken_over_and_its_holder_stops(spark):
    halted = Lease(spark, SCHEMA, "lapsed", 0.2)
    assert halted._create()  # never renewed
    time.sleep(0.3)
    with catalog.lease(spark, SCHEMA, "lapsed"):
        with pytest.raises(PublicationInProgress, match="another run took it"):
            halted.check()
    assert _left(spark, "lapsed") == set()


def test_racing_runs_leave_one_whole_table(spark):
    outcomes = []

    def run(value):
        try:
            outcomes.append((value, publish_replace(_rows(spark, value), SCHEMA, "raced").count()))
        except PublicationInProgress:
            outcomes.append((value, None))

    runs = [threading.Thread(target=run, args=(value,)) for value in range(4)]
    for one in runs:
        one.start()
    for one in runs:
        one.join()
    won = {value for value, n in outcomes if n == 100}
    assert len(outcomes) == 4 and won and _value(spark, "raced") in won
    assert _left(spark, "raced") == {"", "_v"}


def test_tables_of_another_catalog_are_replaced_there():
    calls = []

    class Writer:
        def partitionedBy(self, *columns):
            calls.append(columns)
            return self

        def createOrReplace(self):
            calls.append("createOrReplace")

    class Frame:
        class sparkSession:  # noqa: N801
            table = staticmethod(lambda name: name)

        def __getitem__(self, name):
            return f"column {name}"

        def writeTo(self, name):  # noqa: N802
            calls.append(name)
            return Writer()

    assert publish_replace(Frame(), "s", "t", partition_by=["event"], catalog="lake") == "`lake`.`s`.`t`"
    assert calls == ["`lake`.`s`.`t`", ("column event",), "createOrReplace"]


def _scan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_report_on_one_event_reads_its_files_only(spark, sources_small, config):
    funnel = account_funnel(sources_small, config)
    table = publish_replace(funnel, SCHEMA, "by_event", partition_by=["event"])
    assert bag(table) == bag(funnel)
    assert bag(conversion(table)) == bag(conversion(funnel))
    labels = [row["event"] for row in conversion(funnel).collect()]
    assert len(labels) == 8
    for label in labels:
        one = of_event(table, label)
        assert bag(one) == bag(of_event(funnel, label))
        assert re.search(r"PartitionFilters: \[isnotnull\(event#\d+\), \(event#\d+ = " + re.escape(label[:8]), _scan(one))
        assert {f.rsplit("event=", 1)[1].split("/")[0][:2] for f in one.inputFiles()} >= {label[:2]}
    base = profile_base(table)
    assert bag(base) == bag(profile_base(funnel))
    # Of the eight partitions one is read, and of its columns the one that is counted.
    assert "InMemoryFileIndex(1 paths)" in _scan(base) and "ReadSchema: struct<event_id:string>" in _scan(base)


def test_rows_of_an_event_are_gathered_into_few_files(spark):
    rows = spark.range(0, 8000, 1, 16).select((F.col("id") % 4).cast("string").alias("event"), "id")
    table = publish_replace(rows, SCHEMA, "gathered", partition_by=["event"])
    assert table.count() == 8000 and table.columns == ["event", "id"]
    files = table.select(F.input_file_name()).distinct().count()
    assert files <= 8  # 64 without

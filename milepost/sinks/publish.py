"""Writing a result as a table that readers always find whole.

Both sinks write beside the table, under a lease that keeps other runs from publishing it meanwhile, and first finish or undo
what a run that died in between has left.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from milepost.sinks.catalog import LEASE_SECONDS, drop, exists, is_view, lease, quoted, rename


def _write(
    df: DataFrame, schema: str, name: str, partition_by: Sequence[str] = (), bucket_by: tuple[str, int] | None = None
) -> None:
    """A new table with the rows of df. A failing query leaves nothing in the catalog.

    With partition columns, each one's rows are gathered into files of a good size, split where they are many. With buckets,
    (column, number), each bucket is one file, sorted by the column.
    """
    if bucket_by:
        column, buckets = bucket_by
        writer = df.repartition(buckets, column).write.partitionBy(*partition_by).bucketBy(buckets, column).sortBy(column)
    elif partition_by:
        writer = df.hint("rebalance", *partition_by).write.partitionBy(*partition_by)
    else:
        writer = df.write
    try:
        writer.saveAsTable(quoted(schema, name))
    except BaseException:
        drop(df.sparkSession, schema, name)
        raise


def _named(spark: SparkSession, schema: str, name: str, ending: str) -> list[str]:
    """Tables and views called `name` and an ending of this form, last first."""
    found = spark.sql(f"SHOW TABLES IN {quoted(schema)} LIKE '{name.replace('|', '?')}_*'").collect()
    form = re.compile(re.escape(name.lower()) + ending)
    return sorted((row["tableName"] for row in found if not row["isTemporary"] and form.fullmatch(row["tableName"].lower())), reverse=True)


def versions(spark: SparkSession, schema: str, name: str) -> list[str]:
    """Tables that hold a version of the table, newest first."""
    return _named(spark, schema, name, r"_v[0-9]{20}")


def _version_name(name: str) -> str:
    return f"{name}_v{datetime.now(timezone.utc):%Y%m%d%H%M%S%f}"


def _point(spark: SparkSession, schema: str, name: str, version: str, columns: Sequence[str]) -> None:
    """The view shows the version. One change of the catalog; replacing a view would be two, as Spark drops it first."""
    change = "ALTER" if exists(spark, schema, name) else "CREATE"
    spark.sql(f"{change} VIEW {quoted(schema, name)} AS SELECT {', '.join(map(quoted, columns))} FROM {quoted(schema, version)}")


def shown_version(spark: SparkSession, schema: str, name: str) -> str | None:
    """The version that the view shows, if there is one."""
    if not exists(spark, schema, name) or not is_view(spark, schema, name):
        return None
    details = spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(schema, name)}").where("col_name = 'View Text'").collect()
    ending = re.search(r"`([^`]+_v[0-9]{20})`$", details[0]["data_type"])
    return ending and ending[1]


def _settle(spark: SparkSession, schema: str, name: str) -> None:
    """Puts the table right after a run that died while it was put in place. Under the lease."""
    load, retired = f"{name}_load", f"{name}_retired"
    if exists(spark, schema, load):
        # It has this name only once it is whole.
        _swap(spark, schema, name)
    elif not exists(spark, schema, name):
        if exists(spark, schema, retired):
            rename(spark, schema, retired, name)
        elif found := versions(spark, schema, name):
            _point(spark, schema, name, found[0], spark.table(quoted(schema, found[0])).columns)
    drop(spark, schema, retired)
    for unfinished in _named(spark, schema, name, "_load_[0-9a-f]{12}"):
        drop(spark, schema, unfinished)


def _swap(spark: SparkSession, schema: str, name: str) -> None:
    """Puts `<name>_load` in the table's place. If it is cut off, _settle goes on from any step."""
    load, retired = f"{name}_load", f"{name}_retired"
    if exists(spark, schema, name):
        drop(spark, schema, retired)
        rename(spark, schema, name, retired)
    rename(spark, schema, load, name)
    drop(spark, schema, retired)
    for version in versions(spark, schema, name):
        drop(spark, schema, version)


def recover(spark: SparkSession, schema: str, name: str, lease_seconds: float = LEASE_SECONDS) -> DataFrame | None:
    """Finishes or undoes what a run that died has left, and returns the table, or None if there is none.

    The next publication does this as well. Raises PublicationInProgress as long as that run may still be alive.
    """
    with lease(spark, schema, name, lease_seconds):
        _settle(spark, schema, name)
    return spark.table(quoted(schema, name)) if exists(spark, schema, name) else None


def publish_replace(
    df: DataFrame,
    schema: str,
    name: str,
    partition_by: Sequence[str] = (),
    bucket_by: tuple[str, int] | None = None,
    keep: int = 1,
    catalog: str | None = None,
    lease_seconds: float = LEASE_SECONDS,
) -> DataFrame:
    """Replace the table with ``df`` in one step and return it as read back.

    Each call writes a table of its own, ``<name>_v<time>``, and then turns the view ``<name>`` to it, which is a single change
    of the catalog: a reader finds the old rows or the new ones, never none. A query that has begun goes on reading its
    version; the last ``keep`` earlier ones stay for that. The query may read the table it replaces, and one that fails leaves
    it as it was and nothing beside it. A plain table of this name becomes the first version; only then it is absent between
    two changes of the catalog.

    ``partition_by`` and ``bucket_by``, (column, number of buckets), lay the table out; the columns keep their order.

    With ``catalog``, a catalog of tables that replaces them by itself, the table is replaced there; whether in one step is
    that catalog's matter.
    """
    spark = df.sparkSession
    if catalog:
        writer = df.writeTo(quoted(catalog, schema, name))
        layout = [df[column] for column in partition_by]
        if bucket_by:
            layout.append(F.partitioning.bucket(bucket_by[1], bucket_by[0]))
        (writer.partitionedBy(*layout) if layout else writer).createOrReplace()
        return spark.table(quoted(catalog, schema, name))
    with lease(spark, schema, name, lease_seconds) as own:
        _settle(spark, schema, name)
        version = _version_name(name)
        _write(df, schema, version, partition_by, bucket_by)
        own.check()
        if exists(spark, schema, name) and not is_view(spark, schema, name):
            first = _version_name(name)
            columns = spark.table(quoted(schema, name)).columns
            rename(spark, schema, name, first)
            _point(spark, schema, name, first, columns)
        shown = shown_version(spark, schema, name)
        _point(spark, schema, name, version, df.columns)
        # The shown version and those before it stay, as many as wanted. Later ones are of runs that died before they were shown.
        others = [other for other in versions(spark, schema, name) if other.lower() != version.lower()]
        before = [other for other in others if shown and other.lower() <= shown.lower()]
        for other in set(others) - set(before[:keep]):
            drop(spark, schema, other)
    return spark.table(quoted(schema, name))


def publish_staged_swap(df: DataFrame, schema: str, name: str, lease_seconds: float = LEASE_SECONDS) -> DataFrame:
    """Build ``<name>_load`` beside the table, then put it in the table's place.

    The long part happens while the old table is still there. It is absent only between two renames, which touch the catalog
    alone: the old table goes aside, the new one comes in, and the old one is dropped at the end, so a run that dies in
    between has lost neither. The next call, or `recover`, goes on from there.
    """
    spark = df.sparkSession
    with lease(spark, schema, name, lease_seconds) as own:
        _settle(spark, schema, name)
        # Under a name of its own first: files of a run that died while writing are never in the way.
        staging = f"{name}_load_{uuid.uuid4().hex[:12]}"
        _write(df, schema, staging)
        own.check()
        rename(spark, schema, staging, f"{name}_load")
        _swap(spark, schema, name)
    return spark.table(quoted(schema, name))

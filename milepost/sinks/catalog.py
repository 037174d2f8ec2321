"""Catalog operations on tables and views, and a lease that lets one run at a time publish a table."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

#: A lease that was not renewed for so long belongs to a run that died. It is renewed four times in that time.
LEASE_SECONDS = 120.0
_HOLDER, _UNTIL = "milepost.holder", "milepost.until"


class PublicationInProgress(RuntimeError):
    """Another run publishes the table."""


def quoted(*parts: str) -> str:
    return ".".join("`" + part.replace("`", "``") + "`" for part in parts)


def exists(spark: SparkSession, schema: str, name: str) -> bool:
    return spark.catalog.tableExists(quoted(schema, name))


def is_view(spark: SparkSession, schema: str, name: str) -> bool:
    return spark.catalog.getTable(quoted(schema, name)).tableType == "VIEW"


def rename(spark: SparkSession, schema: str, old: str, new: str) -> None:
    kind = "VIEW" if is_view(spark, schema, old) else "TABLE"
    spark.sql(f"ALTER {kind} {quoted(schema, old)} RENAME TO {quoted(schema, new)}")
    spark.catalog.refreshTable(quoted(schema, new))


def drop(spark: SparkSession, schema: str, name: str) -> None:
    """Nothing happens if it is not there."""
    if exists(spark, schema, name):
        kind = "VIEW" if is_view(spark, schema, name) else "TABLE"
        spark.sql(f"DROP {kind} IF EXISTS {quoted(schema, name)}")


def properties(spark: SparkSession, schema: str, name: str) -> dict[str, str]:
    """Of a table or view; empty if it is not there."""
    try:
        return {row["key"]: row["value"] for row in spark.sql(f"SHOW TBLPROPERTIES {quoted(schema, name)}").collect()}
    except AnalysisException:
        if exists(spark, schema, name):
            raise
        return {}


class Lease:
    """The right to publish a table, as an entry `<name>_lease` of the catalog, which only one run can create.

    The entry is a view, so it has no files. It says until when it counts; a thread moves that time on while the run lives.
    """

    def __init__(self, spark: SparkSession, schema: str, name: str, seconds: float = LEASE_SECONDS) -> None:
        self.spark, self.schema, self.name, self.seconds = spark, schema, f"{name}_lease", seconds
        self.holder = uuid.uuid4().hex
        self._stop = threading.Event()
        self._thread = threading.Thread(target=self._renew, daemon=True)

    def _create(self) -> bool:
        try:
            self.spark.sql(
                f"CREATE VIEW {quoted(self.schema, self.name)} "
                f"TBLPROPERTIES ('{_HOLDER}' = '{self.holder}', '{_UNTIL}' = '{time.time() + self.seconds}') AS SELECT 1 AS held"
            )
        except AnalysisException as error:
            if error.getCondition() != "TABLE_OR_VIEW_ALREADY_EXISTS":
                raise
            return False
        return True

    def take(self) -> None:
        """Raises PublicationInProgress while another run's lease counts. One that has lapsed is removed."""
        while not self._create():
            found = properties(self.spark, self.schema, self.name)
            left = float(found.get(_UNTIL, 0)) - time.time()
            if left > 0:
                raise PublicationInProgress(f"{self.schema}.{self.name}: held by another run for at least {left:.0f} more seconds")
            aside = f"{self.name}_{self.holder}"
            try:
                rename(self.spark, self.schema, self.name, aside)
            except AnalysisException:
                if exists(self.spark, self.schema, aside):
                    raise
                continue  # another run was faster
            if found and properties(self.spark, self.schema, aside).get(_HOLDER) != found.get(_HOLDER):
                # It lapsed, was removed by another run and taken anew since it was read: put back.
                rename(self.spark, self.schema, aside, self.name)
                raise PublicationInProgress(f"{self.schema}.{self.name}: just taken by another run")
            drop(self.spark, self.schema, aside)
        self._thread.start()

    def _renew(self) -> None:
        while not self._stop.wait(self.seconds / 4):
            if self.held():
                self.spark.sql(
                    f"ALTER VIEW {quoted(self.schema, self.name)} SET TBLPROPERTIES ('{_UNTIL}' = '{time.time() + self.seconds}')"
                )

    def held(self) -> bool:
        return properties(self.spark, self.schema, self.name).get(_HOLDER) == self.holder

    def check(self) -> None:
        """To be called before a step that others must not disturb: a run that was halted may have lost its lease."""
        if not self.held():
            raise PublicationInProgress(f"{self.schema}.{self.name}: the lease lapsed and another run took it")

    def give_back(self) -> None:
        self._stop.set()
        self._thread.join()
        if self.held():
            drop(self.spark, self.schema, self.name)


@contextmanager
def lease(spark: SparkSession, schema: str, name: str, seconds: float = LEASE_SECONDS) -> Iterator[Lease]:
    taken = Lease(spark, schema, name, seconds)
    taken.take()
    try:
        yield taken
    finally:
        taken.give_back()

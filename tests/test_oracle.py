"""Every registered query against its DuckDB counterpart."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from checks.keys import all_queries
from checks.oracle import all_sql
from tests.helpers import bag

SCALE = "sf0.001"


@pytest.fixture(scope="module")
def duck(testdata):
    connection = duckdb.connect()
    for path in Path(f"{testdata}/{SCALE}").glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_a_counterpart():
    assert set(all_queries()) == set(all_sql())


@pytest.mark.parametrize("key", sorted(all_queries()))
def test_same_rows(spark, duck, testdata, key):
    df = all_queries()[key](spark, f"{testdata}/{SCALE}")
    result = duck.execute(all_sql()[key])
    names = [column[0] for column in result.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(name) for name in sorted(names)]
    assert bag(df) == Counter(tuple(row[index] for index in order) for row in result.fetchall())

"""The registered queries against DuckDB, and the pipeline as a whole."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from milepost.llm.queries import all_queries, all_sql
from tests.helpers import bag

SCALE = "sf0.001"


@pytest.mark.parametrize("key", sorted(all_sql()))
def test_same_rows(spark, testdata, key):
    duck = duckdb.connect()
    for path in Path(f"{testdata}/{SCALE}").glob("*.parquet"):
        duck.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = all_queries()[key](spark, f"{testdata}/{SCALE}")
    result = duck.execute(all_sql()[key])
    names = [column[0] for column in result.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(name) for name in sorted(names)]
    assert bag(df) == Counter(tuple(row[index] for index in order) for row in result.fetchall())


def test_pipeline(spark, testdata):
    directory = f"{testdata}/{SCALE}"
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "benchmark", "personal_data", "tokens"]
    rows = corpus_pipeline.run(spark, directory).collect()
    docs = spark.read.parquet(f"{directory}/documents.parquet")
    assert 0.8 * docs.count() < len(rows) < docs.count()
    assert all(r["round_trip"] and r["n_ids"] == len(r["ids"]) for r in rows)
    bad = {r["doc_id"] for r in all_queries()["op6_spaced_seeds"](spark, directory).collect()}
    assert bad and not bad & {r["doc_id"] for r in rows}

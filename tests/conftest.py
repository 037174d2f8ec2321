from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    scratch = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(scratch / "warehouse"))
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def testdata() -> str:
    return os.environ.get("TESTDATA_DIR", "/root/testdata")


@pytest.fixture(scope="session")
def sources_small(spark, testdata):
    from milepost.sources.star_adapter import star_sources

    return star_sources(spark, f"{testdata}/sf0.01")


@pytest.fixture(scope="session")
def config():
    from checks.keys import CONFIG

    return CONFIG

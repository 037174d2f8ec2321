"""Seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS], one JSON line.

``queries`` are the library's plans, ``plain`` the same results with one branch
per stage (checks/plain_form.py). Each figure is the median of $BENCH_RUNS runs
after one warm-up, written to the noop sink.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from checks import plain_form
from milepost.config import FunnelConfig
from milepost.plans.account import account_funnel
from milepost.plans.balance import balance_funnel
from milepost.plans.card import card_funnel
from milepost.plans.conversion import conversion
from milepost.sources.star_adapter import START_DATE, star_sources

CONFIG = FunnelConfig(start_date=START_DATE)
QUERIES = {
    "account_funnel": lambda s: account_funnel(s, CONFIG),
    "balance_funnel": lambda s: balance_funnel(s, CONFIG),
    "card_funnel": lambda s: card_funnel(s, CONFIG),
    "account_conversion": lambda s: conversion(account_funnel(s, CONFIG)),
    "card_conversion": lambda s: conversion(card_funnel(s, CONFIG)),
}
PLAIN = {
    "account_funnel": lambda s: plain_form.account_funnel(s, CONFIG),
    "balance_funnel": lambda s: plain_form.balance_funnel(s, CONFIG),
    "card_funnel": lambda s: plain_form.card_funnel(s, CONFIG),
    "account_conversion": lambda s: conversion(plain_form.account_funnel(s, CONFIG)),
    "card_conversion": lambda s: conversion(plain_form.card_funnel(s, CONFIG)),
}


def _session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _once(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def _seconds(builds: list[Callable[[], DataFrame]], runs: int) -> list[float]:
    """Median seconds of each build. They take turns, so a slow spell of the machine hits all of them."""
    taken: list[list[float]] = [[] for _ in builds]
    for turn in range(runs + 1):
        for build, times in zip(builds, taken):
            started = time.perf_counter()
            _once(build())
            if turn:
                times.append(time.perf_counter() - started)
    return [round(statistics.median(times), 3) for times in taken]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "7"))
    spark = _session(os.environ.get("BENCH_CPUS", "8"))
    sources = star_sources(spark, directory)
    timed: dict[str, dict[str, float]] = {"queries": {}, "plain": {}}
    for name in QUERIES:
        timed["queries"][name], timed["plain"][name] = _seconds(
            [lambda: QUERIES[name](sources), lambda: PLAIN[name](sources)], runs
        )
    total = {form: round(sum(seconds.values()), 3) for form, seconds in timed.items()}
    print(
        json.dumps(
            {
                "metric": "three funnels and two conversion reports, total of medians",
                "value": total["queries"],
                "unit": "sec",
                "queries": timed["queries"],
                "sf": float(Path(directory).name.removeprefix("sf")),
                "plain": timed["plain"],
                "plain_value": total["plain"],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

"""Stages of a funnel as data, and the step that turns events into funnel rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from milepost.config import FunnelConfig
from milepost.functions.columns import NO_CURRENCY, cohort_month, cohort_week, event_id_text, profile_type
from milepost.functions.predicates import within_days
from milepost.operators.cohort import COHORT_COLUMNS


@dataclass(frozen=True)
class Stage:
    """One step of a funnel: an event that counts if it falls into a window after profile creation."""

    label: str
    event: str
    until: int | None = None
    after: int | None = None
    id_text: Callable[[Column], Column] = event_id_text


# Fixed value: the label of the first step in every funnel.
PROFILE_CREATED = "1. PROFILE_CREATED"


def start_rows(cohort: DataFrame, schema: StructType, cfg: FunnelConfig) -> DataFrame:
    """The first step: every cohort row, dated with its creation."""
    return _layout(
        cohort.select(
            "*",
            F.lit(NO_CURRENCY).alias("currency"),
            F.col("profile_date_created").alias("date"),
            F.lit(PROFILE_CREATED).alias("event"),
            event_id_text(F.col("profile_id")).alias("event_id"),
        ),
        schema,
        cfg,
    )


def stage_rows(df: DataFrame, stages: Sequence[Stage], schema: StructType, cfg: FunnelConfig) -> DataFrame:
    """Funnel rows of all ``stages`` in one pass over ``df``.

    ``df`` has the cohort's columns and one struct column per event. The window
    is tested on the event already chosen: a first event outside it is not
    replaced by a later one inside.
    """
    created = F.col("profile_date_created")

    def reached(stage: Stage) -> Column:
        return within_days(F.col(f"{stage.event}.date"), created, stage.until, stage.after)

    def row(stage: Stage) -> list[Column]:
        event = stage.event
        has_currency = "currency" in df.schema[event].dataType.names
        return [
            F.lit(stage.label).alias("event"),
            F.col(f"{event}.date").alias("date"),
            (F.col(f"{event}.currency") if has_currency else F.lit(NO_CURRENCY)).alias("currency"),
            stage.id_text(F.col(f"{event}.event_id")).alias("event_id"),
        ]

    # Most rows reach no stage; they go before anything is built for them.
    df = df.where(reduce(or_, [reached(stage) for stage in stages]))
    if len(stages) == 1:
        return _layout(df.select(*COHORT_COLUMNS, *row(stages[0])), schema, cfg)
    found = F.array(*[F.struct(*row(stage), reached(stage).alias("reached")) for stage in stages])
    return _layout(df.select(*COHORT_COLUMNS, F.inline(found)).where("reached"), schema, cfg)


def union_stages(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of all parts; equal rows stay."""
    return reduce(DataFrame.unionByName, parts)


def _layout(df: DataFrame, schema: StructType, cfg: FunnelConfig) -> DataFrame:
    created = F.col("profile_date_created")
    computed = {
        "profile_type": profile_type(F.col("class"), cfg.personal_class),
        "cohort_month": cohort_month(created),
        "cohort_week": cohort_week(created),
    }
    return df.select(*[computed.get(name, F.col(name)).alias(name) for name in schema.names])

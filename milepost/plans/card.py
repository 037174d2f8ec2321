"""The card funnel: ordering, receiving, activating and using a card."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from milepost.config import CARD_DEFAULTS, FunnelConfig
from milepost.functions.columns import days_after, id_with_time, id_with_time_and_days
from milepost.operators.cohort import COHORT_COLUMNS, cohort, cohort_keys
from milepost.operators.events import Event, all_events
from milepost.operators.paths import card_path
from milepost.operators.stages import Stage, stage_rows, start_rows, union_stages
from milepost.schemas import COHORT_FUNNEL_SCHEMA
from milepost.sources import Sources


def stages(cfg: FunnelConfig) -> dict[str, Stage]:
    """Stages after the first, by key. Labels are fixed values."""
    return {
        "card_2_ordered_30d": Stage("2. CARD ORDERED 30D", "ordered", cfg.card_issue_days),
        "card_3_issued_30d": Stage("3. CARD ISSUED 30D", "issued", cfg.card_issue_days),
        "card_4_activated_60d": Stage("4. CARD ACTIVATED 60D", "activated", cfg.card_activation_days),
        "card_5_five_tx_90d": Stage("5. FIVE TX 90D", "used_five_times", cfg.card_five_tx_days),
    }


def card_events() -> dict[str, Event]:
    """Four events of one summary row.

    The day count to the fifth transaction starts at card creation but is
    added to profile creation.
    """
    profile = F.col("card_profile_id")
    ordered, issued = F.col("first_card_order_time"), F.col("first_card_creation_time")
    activated, days = F.col("first_activation_time"), F.col("days_first_card_creation_to_five_transaction")
    return {
        "ordered": Event(ordered, id_with_time(profile, ordered)),
        "issued": Event(issued, id_with_time(profile, issued)),
        "activated": Event(activated, id_with_time(profile, activated)),
        "used_five_times": Event(
            days_after(F.col("profile_date_created"), days), id_with_time_and_days(profile, activated, days)
        ),
    }


def card_summaries(sources: Sources, cfg: FunnelConfig, of_profiles: DataFrame | None = None) -> DataFrame:
    """Every summary row of a cohort row; all are kept."""
    return all_events(card_path(sources, cfg, of_profiles), COHORT_COLUMNS, card_events())


def card_stage(key: str, sources: Sources, cfg: FunnelConfig = CARD_DEFAULTS) -> DataFrame:
    """The rows of one stage."""
    if key == "card_1_profile_created":
        return start_rows(cohort(sources, cfg), COHORT_FUNNEL_SCHEMA, cfg)
    return stage_rows(card_summaries(sources, cfg), [stages(cfg)[key]], COHORT_FUNNEL_SCHEMA, cfg)


def card_funnel(sources: Sources, cfg: FunnelConfig = CARD_DEFAULTS) -> DataFrame:
    """All five stages; the summary is scanned and joined once for the four that use it."""
    summaries = card_summaries(sources, cfg, cohort_keys(sources, cfg))
    return union_stages(
        [
            start_rows(cohort(sources, cfg), COHORT_FUNNEL_SCHEMA, cfg),
            stage_rows(summaries, list(stages(cfg).values()), COHORT_FUNNEL_SCHEMA, cfg),
        ]
    )

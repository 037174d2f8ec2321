"""The profiles a funnel follows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from milepost.config import FunnelConfig
from milepost.functions.predicates import created_since, is_primary
from milepost.sources import Sources

#: A cohort's keys are sent to the fact tables' scans if there are no more of them than this, some tens of megabytes.
BROADCAST_KEYS = 1 << 21
#: And if they are at most this share of all profiles; otherwise most facts would stay.
SELECTIVE = 0.25

COHORT_COLUMNS = ["profile_id", "profile_date_created", "class", "country_code"]


def new_profiles(sources: Sources, cfg: FunnelConfig) -> DataFrame:
    return sources.user_profile.where(created_since(F.col("date_created"), cfg.start_date)).select(
        F.col("id").alias("profile_id"), F.col("date_created").alias("profile_date_created"), "class"
    )


def primary_addresses(sources: Sources, cfg: FunnelConfig) -> DataFrame:
    return sources.address.where(is_primary(F.col("address_type"), cfg.primary_address_type)).select(
        F.col("user_profile_id").alias("profile_id"), "country_code"
    )


def cohort(sources: Sources, cfg: FunnelConfig) -> DataFrame:
    """New profiles, one row per primary address; none without one."""
    return new_profiles(sources, cfg).join(primary_addresses(sources, cfg), "profile_id")


def cohort_profiles(sources: Sources, cfg: FunnelConfig) -> DataFrame:
    """The cohort with one row per profile, for stages that keep one event of a profile.

    Of several primary addresses the smallest country code stays, which is the
    last tie-break of those stages. Addresses are reduced before the join.
    """
    countries = primary_addresses(sources, cfg).groupBy("profile_id").agg(F.min("country_code").alias("country_code"))
    return new_profiles(sources, cfg).join(countries, "profile_id")


def cohort_keys(sources: Sources, cfg: FunnelConfig) -> DataFrame | None:
    """The new profiles' ids if they are few enough to filter the fact tables' scans by, otherwise None.

    Counted by a job on one column of the profiles.
    """
    is_new = F.count_if(created_since(F.col("date_created"), cfg.start_date))
    new, known = sources.user_profile.agg(is_new, F.count("*")).first()
    if new > min(BROADCAST_KEYS, SELECTIVE * known):
        return None
    return new_profiles(sources, cfg).select("profile_id")


def account_keys(sources: Sources, profile_keys: DataFrame | None) -> DataFrame | None:
    """The ids of these profiles' accounts, if they are few enough, otherwise None. Counted by a job on the accounts."""
    if profile_keys is None:
        return None
    accounts = of_keys(sources.account, "profile_id", profile_keys).select(F.col("id").alias("account_id"))
    return accounts if accounts.count() <= BROADCAST_KEYS else None


def of_keys(facts: DataFrame, key: str, keys: DataFrame | None) -> DataFrame:
    """The facts whose ``key`` is among ``keys``, the only column there; all of them if that is None.

    The keys were counted, so they are broadcast: facts of others go where they are read, before anything is shuffled.
    """
    if keys is None:
        return facts
    return facts.join(F.broadcast(keys.toDF(key)), key, "left_semi")

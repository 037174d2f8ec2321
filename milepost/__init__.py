"""Onboarding funnels as Spark DataFrame plans."""

from milepost.config import FunnelConfig

__all__ = ["FunnelConfig"]

"""Parameters of the funnels."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

# They name things in the source data and must match it exactly.
PERSONAL_CLASS = "com.transferwise.fx.user.PersonalUserProfile"
PRIMARY_ADDRESS_TYPE = "PRIMARY_USER_PROFILE_ADDRESS"
SUPPORTED_CURRENCIES = ("GBP", "EUR", "USD", "AUD", "NZD", "SGD", "RON", "CAD", "HUF", "TRY")


@dataclass(frozen=True)
class FunnelConfig:
    """What a funnel run can vary. Day counts are relative to profile creation."""

    start_date: str = "2020-01-01"
    window_days: int = 30
    late_window: tuple[int, int] = (30, 90)
    card_issue_days: int = 30
    card_activation_days: int = 60
    card_five_tx_days: int = 90
    supported_currencies: tuple[str, ...] = SUPPORTED_CURRENCIES
    personal_class: str = PERSONAL_CLASS
    primary_address_type: str = PRIMARY_ADDRESS_TYPE

    def __post_init__(self) -> None:
        datetime.fromisoformat(self.start_date)
        after, until = self.late_window
        if after >= until:
            raise ValueError(f"late_window must be (after, until) with after < until, got {self.late_window}")


ACCOUNT_DEFAULTS = FunnelConfig()
BALANCE_DEFAULTS = FunnelConfig(start_date="2017-01-01")
CARD_DEFAULTS = FunnelConfig()

"""Validated settings of a run, from a mapping such as the environment."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation
from urllib.parse import urlsplit

# The only host orders may go to, and a contact as filing servers ask for it.
PAPER_HOST = "paper-api.alpaca.markets"
CONTACT = re.compile(r"\S.*\s\S+@\S+\.\S+")


class SettingsError(ValueError):
    """Names every setting that is missing or unusable."""


@dataclass(frozen=True)
class Settings:
    sec_user_agent: str
    store_root: str
    broker_url: str = f"https://{PAPER_HOST}"
    daily_spend_ceiling: Decimal = Decimal("4.00")
    per_run_token_ceiling: int = 250_000


def load_settings(values: Mapping[str, str]) -> Settings:
    wrong: list[str] = []

    def number(name: str, default: str) -> Decimal:
        try:
            found = Decimal(values.get(name, default))
        except InvalidOperation:
            found = Decimal(0)
        if not found.is_finite() or found <= 0:
            wrong.append(f"{name} must be a number above zero")
        return found

    contact, root = values.get("SEC_USER_AGENT", "").strip(), values.get("STORE_ROOT", "").strip()
    if not CONTACT.fullmatch(contact):
        wrong.append("SEC_USER_AGENT must be a name and an e-mail address")
    if not root:
        wrong.append("STORE_ROOT must name the folder of the store")
    broker = values.get("BROKER_URL", Settings.broker_url)
    if urlsplit(broker).hostname != PAPER_HOST:
        wrong.append("BROKER_URL must be the paper-trading endpoint")
    spend, tokens = number("DAILY_SPEND_CEILING", "4.00"), number("PER_RUN_TOKEN_CEILING", "250000")
    if wrong:
        raise SettingsError("; ".join(wrong))
    return Settings(contact, root, broker, spend, int(tokens))

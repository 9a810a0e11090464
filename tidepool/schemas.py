"""Enumerations and timeframes of the data model."""

from __future__ import annotations

# Codes stored in the tables.
VENUE_BINNED = 0
TIER_SCREENED, TIER_WATCHED = 0, 1
MEASURED, ESTIMATED = "A", "B"
LIQUIDITY_ADD, LIQUIDITY_REMOVE = 0, 1
INTENT_CREATED, INTENT_SUBMITTED, INTENT_CONFIRMED, INTENT_FAILED, INTENT_EXPIRED = range(5)
CASH_DEPOSIT, CASH_WITHDRAWAL, CASH_CLAIM = range(3)

#: Seconds of a bar and bars a day, by timeframe.
TIMEFRAMES = {"5m": 300, "10m": 600, "1h": 3600, "4h": 14400, "24h": 86400}


def bars_a_day(timeframe: str) -> int:
    return 86400 // TIMEFRAMES[timeframe]

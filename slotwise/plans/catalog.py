"""All registered queries and their SQL twins."""

from __future__ import annotations

from slotwise.plans import audits, growth, maps, profiles, rankings, stores, trends  # noqa: F401  (each registers its own)
from slotwise.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

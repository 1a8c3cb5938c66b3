"""All registered queries."""

from ledgerloom.plans import combining, extraction, learning, scalars, storage, streams  # noqa: F401
from ledgerloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

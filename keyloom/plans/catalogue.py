"""The registry of reference queries: name -> callable, and name -> SQL of the oracle."""

from __future__ import annotations

from keyloom.plans import counting, flows, keys  # noqa: F401  (they register their queries)
from keyloom.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""Loads every module that registers queries."""

from __future__ import annotations

from cohortspan.plans import cohorts, models, overlaps, reports, stores, use  # noqa: F401
from cohortspan.plans.base import REGISTRY

__all__ = ["REGISTRY"]

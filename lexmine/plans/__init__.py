"""All queries by name, and their SQL."""

from __future__ import annotations

from lexmine.plans import activity, cards, concordance, geometry, streams, text  # noqa: F401
from lexmine.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

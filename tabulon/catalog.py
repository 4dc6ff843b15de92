"""Named queries over the shared tables, each with SQL that must give the same rows."""

from __future__ import annotations

from tabulon.plans import learning, plots, relational, series  # noqa: F401  each registers its queries
from tabulon.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

"""The registered core queries and their SQL."""

from __future__ import annotations

from lumigraph.plans import media_queries, skewed

QUERIES: dict = {**media_queries.QUERIES, **skewed.QUERIES}
ORACLE: dict = {**media_queries.ORACLE, **skewed.ORACLE}

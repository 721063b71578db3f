"""All queries of the library outside the training-data operators, with their SQL."""

from __future__ import annotations

from korvane.plans import checks, conversations, corpus, learned, retrieval, sessions  # noqa: F401  (importing them registers their queries)
from korvane.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

"""All queries of the library and their SQL twins."""

from __future__ import annotations

from .plans import q_eval, q_features, q_market, q_models, q_sources  # noqa: F401
from .plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

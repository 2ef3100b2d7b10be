"""All queries of the library's own operators, with their SQL."""

from __future__ import annotations

from parley.plans import profiles, rules, sessions, speakers, streams, text, upkeep  # noqa: F401
from parley.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

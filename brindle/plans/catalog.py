"""Registered queries and the SQL that makes the same rows."""

from __future__ import annotations

from brindle.plans import chat_plans, index_plans, record_plans, retrieval_plans, store_plans, text_plans  # noqa: F401  they register themselves
from brindle.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

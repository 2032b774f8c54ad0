"""Registered queries and the SQL they are held against."""

from __future__ import annotations

from stormshift.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

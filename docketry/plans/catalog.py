"""All registered queries and the SQL statements that check them."""

from __future__ import annotations

import importlib

AREAS = ("text", "retrieval", "review", "audit", "store")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for area in AREAS:
        out |= getattr(importlib.import_module(f"docketry.plans.catalog_{area}"), attribute)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLES")

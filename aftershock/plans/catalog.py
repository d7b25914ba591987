"""Registry of query keys -> Spark callables and DuckDB oracle SQL."""

from __future__ import annotations

import importlib

_MODULES = [
    "aftershock.plans.recovery",
    "aftershock.plans.returns",
    "aftershock.plans.reshape",
    "aftershock.plans.columns",
    "aftershock.plans.events",
    "aftershock.plans.profiles",
    "aftershock.plans.rows",
    "aftershock.plans.scalars",
    "aftershock.plans.modelling",
    "aftershock.plans.entity",
    "aftershock.plans.facts",
    "aftershock.plans.learn",
    "aftershock.plans.sectors",
    "aftershock.plans.firms",
    "aftershock.plans.compare",
]


def _merge(attr: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        mod = importlib.import_module(m)
        part = getattr(mod, attr, {})
        dup = set(out) & set(part)
        if dup:
            raise ValueError(f"duplicate query keys {sorted(dup)} in {m}")
        out.update(part)
    return out


def queries() -> dict:
    return _merge("QUERIES")


def oracle_sql() -> dict:
    return _merge("ORACLE")

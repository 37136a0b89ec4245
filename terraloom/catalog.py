"""Registry of the library's queries and their SQL twins."""

from __future__ import annotations

from importlib import import_module

#: Modules of terraloom.plans that hold QUERIES (name -> function) and SQL (name -> text).
PLANS: tuple[str, ...] = ("metrics", "scalars", "windows", "calibration", "joins", "ground", "inout", "events")


def _all(attribute: str) -> dict:
    found: dict = {}
    for name in PLANS:
        more = getattr(import_module(f"terraloom.plans.{name}"), attribute)
        if clash := found.keys() & more.keys():
            raise ValueError(f"registered twice: {sorted(clash)}")
        found |= more
    return found


def queries() -> dict:
    """All queries: name -> function of (spark, sf_dir)."""
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    """DuckDB twins of queries, by the same names."""
    return _all("SQL")

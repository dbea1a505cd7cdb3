"""The registry of the library's own queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from loomframe.plans import monitoring, planning, storage


def registered() -> dict[str, tuple[Callable, str | None]]:
    return planning.QUERIES | monitoring.QUERIES | storage.QUERIES


def queries() -> dict[str, Callable]:
    return {name: q for name, (q, _) in registered().items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for name, (_, s) in registered().items() if s}

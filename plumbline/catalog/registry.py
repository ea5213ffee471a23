"""The register of queries, filled by the modules beside this one."""

from __future__ import annotations

from collections.abc import Callable

ENTRIES: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir) under its own name, with its SQL."""

    def register(f: Callable) -> Callable:
        if f.__name__ in ENTRIES:
            raise ValueError(f"{f.__name__} is registered twice")
        ENTRIES[f.__name__] = (f, sql)
        return f

    return register

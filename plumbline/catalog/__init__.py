"""All registered queries of the library, by operator name, with their SQL. Each module binds operators to the given tables."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from plumbline.catalog.registry import ENTRIES

FLAGSHIP = "a02_leaderboard"
for _name in ("voxels", "samples", "spatial", "surfaces", "evaluation", "graphs", "evidence", "streams", "records", "arrays", "reviews", "rays", "vectors", "ensembles", "releases"):
    import_module(f"plumbline.catalog.{_name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: e[0] for k, e in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: e[1] for k, e in ENTRIES.items() if e[1]}

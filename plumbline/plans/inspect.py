"""What Spark will do: physical operators by name, filters and columns that reach a scan."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def text(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def operators(df: DataFrame) -> list[str]:
    return re.findall(r"(?:^|[-+:* ()\d]+)([A-Z]\w+)", text(df), re.M)


def nested_loops(df: DataFrame) -> bool:
    return bool(re.search("BroadcastNestedLoopJoin|CartesianProduct", text(df)))


def pushed_filters(df: DataFrame) -> list[str]:
    return [x for m in re.findall(r"PushedFilters: \[([^\]]*)\]", text(df)) for x in m.split(", ") if x]


def read_columns(df: DataFrame) -> list[str]:
    return [x.split(":")[0] for m in re.findall(r"ReadSchema: struct<([^>]*)>", text(df)) for x in m.split(",") if x]

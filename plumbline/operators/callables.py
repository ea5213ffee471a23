"""Where callers plug in their own code: scorers by group, predictors by row, statistics by replicate, solvers by name."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import graphs

#: Solvers of node values from an edge table, by name.
SOLVERS: dict[str, Callable[..., DataFrame]] = {"bfs": lambda edges: graphs.bfs_forest(edges).select("node", F.col("pot").alias("val")), "mode": graphs.mode_refined}


def scored_by(df: DataFrame, keys: list[str], score: Callable[[pd.DataFrame], float], name: str = "score") -> DataFrame:
    """The caller's score of each group; a group must fit in a task, so keys should be chunks, not volumes of any size."""
    kinds = dict(df.dtypes)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, float(score(pdf))]], columns=[*keys, name])

    return df.groupBy(*keys).applyInPandas(one, ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{name} double"]))


def predicted(df: DataFrame, column: str, predict: Callable[[pd.Series], pd.Series], name: str = "prediction") -> DataFrame:
    """The caller's prediction for each row, in Arrow batches."""
    return df.withColumn(name, F.pandas_udf(predict, "double")(F.col(column)))

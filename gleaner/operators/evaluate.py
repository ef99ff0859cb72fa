"""Predictions, errors by part and kind of row, and learning curves."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot


def residuals(frame: DataFrame, beta: np.ndarray) -> DataFrame:
    """Rows with their prediction and squared residual; errors are not weighted."""
    rows = frame.withColumn("prediction", dot("features", beta))
    return rows.withColumn("r2", F.pow(F.col("prediction") - F.col("y"), F.lit(2.0)))


def rmse(where: Column, name: str) -> Column:
    """Null if no row is meant."""
    return F.sqrt(F.avg(F.when(where, F.col("r2")))).alias(name)


def errors_4way(train: DataFrame, test: DataFrame, beta: np.ndarray) -> DataFrame:
    """One row: e_train, f_train, e_test, f_test."""
    rows = residuals(train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))), beta)
    cells = [(F.col("part") == p) & (F.col("is_energy") if k == "e" else ~F.col("is_energy")) for p in ("train", "test") for k in "ef"]
    return rows.agg(*[rmse(c, n) for c, n in zip(cells, ["e_train", "f_train", "e_test", "f_test"])])


def errors_6way(train: DataFrame, test: DataFrame, chosen: DataFrame, beta: np.ndarray) -> DataFrame:
    """One row: e_sub, f_sub, e_train, f_train, e_test, f_test, in one pass over the rows."""
    marked = train.join(chosen.select("config_id", F.lit(True).alias("sub")), "config_id", "left")
    rows = marked.withColumn("part", F.lit("train")).unionByName(test.withColumns({"sub": F.lit(None).cast("boolean"), "part": F.lit("test")}))
    rows = residuals(rows, beta)
    parts = {"sub": F.coalesce("sub", F.lit(False)), "train": F.col("part") == "train", "test": F.col("part") == "test"}
    kinds = {"e": F.col("is_energy"), "f": ~F.col("is_energy")}
    return rows.agg(*[rmse(parts[p] & kinds[k], f"{k}_{p}") for p in parts for k in kinds])


METRICS = ["e_sub", "f_sub", "e_train", "f_train", "e_test", "f_test"]


def schedule(fractions: float | Sequence[float], repeats: int | Sequence[int]) -> list[tuple[float, int]]:
    """Fractions in ascending order with their numbers of repeats, which may not grow with the fraction."""
    f = [fractions] if np.isscalar(fractions) else list(fractions)
    r = [repeats] * len(f) if np.isscalar(repeats) else list(repeats)
    if len(f) != len(r):
        raise ValueError(f"{len(f)} fractions, but {len(r)} numbers of repeats")
    pairs = sorted(zip(f, r))
    if any(a[1] < b[1] for a, b in zip(pairs, pairs[1:])):
        raise ValueError("a larger fraction can't have more repeats")
    return pairs


def curve(spark, run: Callable[[int, float], DataFrame], pairs: list[tuple[float, int]], descending: bool = False) -> DataFrame:
    """Long table (repeat, fraction, metric, rmse) of what ``run(repeat, fraction)`` measures."""
    rows = []
    for j in range(max((r for _, r in pairs), default=0)):
        todo = [f for f, r in pairs if j < r]
        for f in reversed(todo) if descending else todo:
            found = run(j, f).first().asDict()
            rows += [(j, float(f), m, found[m]) for m in METRICS]
    return spark.createDataFrame(rows, "repeat int, fraction double, metric string, rmse double")


def wide(long: DataFrame) -> pd.DataFrame:
    """Repeats as rows, (metric, fraction) as columns in order; what was not repeated is NaN."""
    table = long.toPandas()
    table["metric"] = pd.Categorical(table["metric"], METRICS, ordered=True)
    return table.pivot(index="repeat", columns=["metric", "fraction"], values="rmse").sort_index(axis=1)

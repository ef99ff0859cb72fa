"""A seeded regression table: y = x . beta + noise, rows in blocks of one configuration, the first the energy row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _normal(name: str, i: int, seed: int, row: Column) -> Column:
    """A standard normal number from two hashes (Box and Muller), the same under any partitioning."""
    unit = lambda s: (F.pmod(F.xxhash64(F.lit(f"{name}|{seed}|{i}|{s}"), row), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.sqrt(-2 * F.log(unit(0))) * F.cos(2 * F.pi() * unit(1))


def observations(spark: SparkSession, configs: int = 400, block: int = 30, features: int = 20, noise: float = 0.01, seed: int = 0) -> DataFrame:
    """row_id, config_id, is_energy, y, w, features (without an intercept)."""
    row = F.col("id")
    x = [_normal("x", i, seed, row) for i in range(features)]
    beta = [_normal("beta", i, seed, F.lit(0)) for i in range(features)]
    rows = spark.range(configs * block).select(F.col("id"), F.array(*x).alias("features"), F.array(*beta).alias("beta"))
    signal = F.aggregate(F.zip_with("features", "beta", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return rows.select(
        row.alias("row_id"),
        F.floor(row / block).cast("long").alias("config_id"),
        (row % block == 0).alias("is_energy"),
        (signal + noise * _normal("noise", 0, seed, row)).alias("y"),
        F.lit(1.0).alias("w"),
        "features",
    )

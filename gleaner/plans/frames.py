"""Observation frames over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.frame import build, tasks_for


def _with_energy_weights(frame: DataFrame, heavy: float) -> DataFrame:
    return frame.withColumn("w", F.when(F.col("is_energy"), F.lit(heavy)).otherwise(F.lit(1.0)))


def _quiet(*args, **kwargs) -> DataFrame:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return build(*args, **kwargs)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FE: events by user; value against the hour; a user's first event is the energy row, of weight 10."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value", F.array(F.hour("ts").cast("double")).alias("x"))
    return _with_energy_weights(_quiet(t, "x", "event_id", "user_id", y="value"), 10.0)


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FL: lines by order; price against quantity and discount; the first line in a fixed order is the energy row."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount")
    t = t.repartition(tasks_for(t), "l_orderkey")  # the window sorts a task's rows
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"))
    t = t.withColumn("place", place).withColumn("row", F.col("l_orderkey") * 1000 + F.col("place"))
    x = F.array(F.col("l_quantity") / 10, F.col("l_discount") * 10)
    return _with_energy_weights(build(t, x, "row", "l_orderkey", F.col("place") == 1, F.col("l_extendedprice") / 1000), 10.0)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FO: orders by customer; total price against the day."""
    t = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")) / 1000
    return _quiet(t, F.array(day), "o_orderkey", "o_custkey", y=F.col("o_totalprice") / 1000)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FV: embeddings in 50 groups; the label against 64 features."""
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return _quiet(t, "embedding", "vec_id", F.col("vec_id") % 50, y="label")


FE = """
fe AS (SELECT event_id AS row_id, user_id AS config_id, event_id = min(event_id) OVER (PARTITION BY user_id) AS is_energy,
              value AS y, CASE WHEN event_id = min(event_id) OVER (PARTITION BY user_id) THEN 10.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
              1.0::DOUBLE AS x0, hour(ts)::DOUBLE AS x1 FROM events)"""

FL = """
fl0 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS place FROM lineitem),
fl AS (SELECT l_orderkey * 1000 + place AS row_id, l_orderkey AS config_id, place = 1 AS is_energy, l_extendedprice / 1000 AS y,
              CASE WHEN place = 1 THEN 10.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 1.0::DOUBLE AS x0, l_quantity / 10 AS x1, l_discount * 10 AS x2 FROM fl0)"""

FO = """
fo AS (SELECT o_orderkey AS row_id, o_custkey AS config_id, o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) AS is_energy,
              o_totalprice / 1000 AS y, 1.0::DOUBLE AS w, 1.0::DOUBLE AS x0, (o_orderdate::DATE - DATE '1970-01-01') / 1000.0::DOUBLE AS x1 FROM orders)"""


def u(expr: str, seed: int, salt: str) -> str:
    """The uniform number of an id."""
    return f"((('0x' || substr(md5('{salt}|{seed}|' || {expr}::VARCHAR), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE)"


def split(frame: str, fraction: float, seed: int) -> str:
    """CTEs test_ids, train, test."""
    return f"""
ids AS (SELECT DISTINCT config_id FROM {frame}),
test_ids AS (SELECT config_id FROM (SELECT config_id, row_number() OVER (ORDER BY {u("config_id", seed, "split")}, config_id) AS rk, count(*) OVER () AS n FROM ids) WHERE rk <= floor(n * {fraction})),
train AS (SELECT * FROM {frame} WHERE config_id NOT IN (SELECT config_id FROM test_ids)),
test AS (SELECT * FROM {frame} WHERE config_id IN (SELECT config_id FROM test_ids)),
train_ids AS (SELECT DISTINCT config_id FROM train)"""


def uniform(ids: str, fraction: float, seed: int, name: str = "chosen") -> str:
    return f"{name} AS (SELECT config_id FROM (SELECT config_id, row_number() OVER (ORDER BY {u('config_id', seed, 'uniform')}, config_id) AS rk, count(*) OVER () AS n FROM {ids}) WHERE rk <= round_even(n * {fraction}, 0))"


def race(scores: str, k: str, seed: int, name: str = "chosen") -> str:
    """Draws in proportion to the column score; k is an SQL expression of n, the number of configurations."""
    return f"{name} AS (SELECT config_id FROM (SELECT config_id, row_number() OVER (ORDER BY -ln({u('config_id', seed, 'weighted')}) / score, config_id) AS rk, n FROM (SELECT *, count(*) OVER () AS n FROM {scores}) WHERE score > 0) WHERE rk <= {k})"


def normal2(frame: str, name: str = "m") -> str:
    """Inverse normal matrix and coefficients for two features: i00, i01, i11, b0, b1."""
    return f"""
{name}_s AS (SELECT sum(w*w*x0*x0) AS a00, sum(w*w*x0*x1) AS a01, sum(w*w*x1*x1) AS a11, sum(w*w*x0*y) AS v0, sum(w*w*x1*y) AS v1 FROM {frame}),
{name} AS (SELECT a11/d AS i00, -a01/d AS i01, a00/d AS i11, (a11*v0 - a01*v1)/d AS b0, (a00*v1 - a01*v0)/d AS b1 FROM (SELECT *, a00*a11 - a01*a01 AS d FROM {name}_s))"""


def normal3(frame: str, name: str = "m") -> str:
    """The same for three features: i00 ... i22, b0, b1, b2."""
    return f"""
{name}_s AS (SELECT sum(w*w*x0*x0) AS a, sum(w*w*x0*x1) AS b, sum(w*w*x0*x2) AS c, sum(w*w*x1*x1) AS d, sum(w*w*x1*x2) AS e, sum(w*w*x2*x2) AS f,
                    sum(w*w*x0*y) AS v0, sum(w*w*x1*y) AS v1, sum(w*w*x2*y) AS v2 FROM {frame}),
{name}_i AS (SELECT (d*f-e*e)/t AS i00, (c*e-b*f)/t AS i01, (b*e-c*d)/t AS i02, (a*f-c*c)/t AS i11, (b*c-a*e)/t AS i12, (a*d-b*b)/t AS i22, v0, v1, v2
             FROM (SELECT *, a*(d*f-e*e) - b*(b*f-c*e) + c*(b*e-c*d) AS t FROM {name}_s)),
{name} AS (SELECT *, i00*v0+i01*v1+i02*v2 AS b0, i01*v0+i11*v1+i12*v2 AS b1, i02*v0+i12*v1+i22*v2 AS b2 FROM {name}_i)"""

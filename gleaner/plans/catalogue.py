"""Registered queries of the regression operators, each with DuckDB SQL where it can express them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evaluate, greedy, score
from ..operators import frame as frames_of
from ..operators.factor import gram as gram_sums
from ..operators.factor import Factor, root, tsqr, woodbury
from ..sampling import CooksSampler, LeverageSampler, Sampler, Study
from ..sources import containers, npy, synthetic
from . import frames as T

TEST, SEED, SUB = 0.25, 41, 0.2
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Sums of doubles depend on their order in the last digits."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def row(spark: SparkSession, names: list[str], values) -> DataFrame:
    return spark.createDataFrame([tuple(float(v) for v in values)], ", ".join(f"{n} double" for n in names))


def r(digits: int, *exprs: str) -> str:
    return ", ".join(f"round({e.split(' AS ')[0]}, {digits}) + 0.0 AS {e.split(' AS ')[-1]}" for e in exprs)


# frames and partitions


@query(f"WITH {T.FE} SELECT row_id, config_id, is_energy, y, w, x0, x1 FROM fe")
def frame_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = T.events(spark, sf_dir)
    return f.select("row_id", "config_id", "is_energy", "y", "w", F.get("features", F.lit(0)).alias("x0"), F.get("features", F.lit(1)).alias("x1"))


@query(f"WITH {T.FO} SELECT row_id, config_id, is_energy, y, w, x1::FLOAT::DOUBLE AS x1 FROM fo")
def frame_float32_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = T.orders(spark, sf_dir).select("*", F.slice("features", 2, 1).alias("x"))
    narrow = frames_of.build(f, "x", is_energy="is_energy", config_id="config_id", y="y", w="w", dtype="float32")
    return narrow.select("row_id", "config_id", "is_energy", "y", "w", F.get("features", F.lit(1)).alias("x1"))


@query(f"WITH {T.FL} SELECT config_id, count(*) AS n_rows FROM fl GROUP BY config_id")
def config_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_of.row_counts(T.lineitem(spark, sf_dir))


@query(f"WITH {T.FE} SELECT DISTINCT config_id FROM fe")
def config_id_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_of.config_ids(T.events(spark, sf_dir))


@query(
    f"""WITH {T.FE}, a AS (SELECT row_id, config_id, coalesce((config_id <> lag(config_id) OVER (ORDER BY row_id))::INT, 1) AS n FROM fe),
b AS (SELECT *, sum(n) OVER (ORDER BY row_id) - 1 AS island FROM a)
SELECT island::BIGINT AS island, config_id, min(row_id) AS start_row, count(*) AS n_rows FROM b GROUP BY island, config_id"""
)
def config_boundaries_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_of.boundaries(T.events(spark, sf_dir))


@query(
    f"""WITH {T.FL}, c AS (SELECT config_id, count(*) AS n FROM fl GROUP BY config_id),
e AS (SELECT config_id, sum(n) OVER (ORDER BY config_id) AS end_row FROM c), t AS (SELECT sum(n) AS total FROM c),
d AS (SELECT part::INT AS part, end_row, config_id, row_number() OVER (PARTITION BY part ORDER BY abs(end_row - total * part / 8.0), end_row) AS rk FROM e, t, range(1, 8) AS x(part))
SELECT part, end_row::BIGINT AS end_row, config_id AS end_config FROM d WHERE rk = 1"""
)
def partition_ranges_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_of.range_ends(frames_of.row_counts(T.lineitem(spark, sf_dir)), 8)


#: A source of skew: the last configuration counts for more rows than all others together.
_SKEWED = "CASE WHEN config_id = max(config_id) OVER () THEN 200000::BIGINT ELSE 1::BIGINT END"


@query(
    f"""WITH {T.FE}, c AS (SELECT config_id, {_SKEWED} AS n FROM (SELECT DISTINCT config_id FROM fe)),
e AS (SELECT config_id, sum(n) OVER (ORDER BY config_id) AS end_row, row_number() OVER (ORDER BY config_id) AS k, count(*) OVER () AS many, sum(n) OVER () AS total FROM c),
d AS (SELECT part::INT AS part, k, many, row_number() OVER (PARTITION BY part ORDER BY abs(end_row - total * part / 6.0), k) AS rk FROM e, range(1, 6) AS x(part)),
p AS (SELECT part, part + least(max(k - part) OVER (ORDER BY part), many - 6) AS k FROM d WHERE rk = 1)
SELECT part, end_row::BIGINT AS end_row, config_id AS end_config FROM p JOIN e USING (k)"""
)
def partition_ranges_skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part gets a configuration, though one of them holds nearly all rows."""
    ids = frames_of.config_ids(T.events(spark, sf_dir))
    last = ids.agg(F.max("config_id")).first()[0]
    counts = ids.withColumn("n_rows", F.when(F.col("config_id") == last, F.lit(200_000)).otherwise(F.lit(1)).cast("long"))
    return frames_of.range_ends(counts, 6)


@query(f"WITH {T.FL} SELECT 'by place' AS partitioning, config_id, count(DISTINCT row_id % 3)::BIGINT AS parts FROM fl GROUP BY config_id HAVING count(DISTINCT row_id % 3) > 1")
def split_config_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partitioning by hash of the configuration splits none; one by the rows' places splits all but the smallest."""
    f = T.lineitem(spark, sf_dir)
    by_hash = frames_of.split_configs(f.repartition(frames_of.tasks_for(f), "config_id").withColumn("part", F.spark_partition_id()), F.col("part"))
    by_place = frames_of.split_configs(f, F.col("row_id") % 3)
    return by_hash.select(F.lit("by hash").alias("partitioning"), "*").unionByName(by_place.select(F.lit("by place").alias("partitioning"), "*"))


# sources


@query(f"WITH {T.FE} SELECT config_id, count(*) AS n_rows, sum(is_energy::INT)::BIGINT AS n_energy, {r(6, 'sum(y) AS y', 'sum(w) AS w', 'sum(x1) AS x1')} FROM fe GROUP BY config_id")
def npy_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned arrays written as .npy files, read back in row ranges and joined by row number."""
    f = T.events(spark, sf_dir)
    numbered = _numbered(f)
    folder = containers.scratch(spark)
    paths = {c: f"{folder}/{c}.npy" for c in ("features", "y", "w", "config_id", "is_energy")}
    npy.save_all(numbered, paths, "place")
    rows = npy.observations(spark, paths["features"], paths["y"], paths["w"], paths["config_id"], paths["is_energy"])
    frame = frames_of.build(rows, "features", config_id="config_id", is_energy="is_energy", y="y", w="w", intercept=False)
    sums = frame.groupBy("config_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("is_energy").alias("n_energy"), F.sum("y").alias("y"), F.sum("w").alias("w"), F.sum(F.get("features", F.lit(1))).alias("x1"))
    return rounded(sums, 6, "y", "w", "x1")


@query(f"WITH {T.FE}, p AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS place FROM fe) SELECT (place // 100)::BIGINT AS range, count(*) AS n_rows, {r(6, 'sum(y) AS y')} FROM p WHERE place >= 100 AND place < 700 GROUP BY place // 100")
def npy_range_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six row ranges of a .npy vector, each read by a task of its own and no other rows."""
    path = f"{containers.scratch(spark)}/y.npy"
    npy.save(_numbered(T.events(spark, sf_dir)), path, "y", "place")
    rows = npy.load(spark, path, [(a, a + 100) for a in range(100, 700, 100)])
    return rounded(rows.groupBy(F.floor(F.col("row_id") / 100).alias("range")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("value").alias("y")), 6, "y")


def _numbered(frame: DataFrame) -> DataFrame:
    """Rows with their place in row order: a count within ranges of row ids on top of the ranges before."""
    cell = frames_of.cell_of(frame, "row_id")
    parts = frame.withColumn("cell", cell)
    sizes = parts.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("cell", (F.sum("n").over(Window.orderBy("cell")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("cell").orderBy("row_id"))
    return parts.withColumn("own", place).join(F.broadcast(before), "cell").withColumn("place", F.col("before") + F.col("own") - 1)


@query("SELECT (i // 30)::BIGINT AS config_id, 30::BIGINT AS n_rows, 1::BIGINT AS n_energy, min(i)::BIGINT AS energy_row, 5::INT AS width, 0.01::DOUBLE AS noise FROM range(1200) AS x(i) GROUP BY i // 30")
def generated_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generator's blocks, and the noise that a fit without intercept leaves."""
    rows = synthetic.observations(spark, 40, 30, 5)
    f = frames_of.build(rows, "features", config_id="config_id", is_energy="is_energy", y="y", w="w", intercept=False)
    s = Study(f, features=5)
    left = evaluate.residuals(f, s.fit()).agg(F.round(F.sqrt(F.avg("r2")), 2).alias("noise"))
    blocks = f.groupBy("config_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("is_energy").alias("n_energy"), F.min(F.when(F.col("is_energy"), F.col("row_id"))).alias("energy_row"), F.max(F.size("features")).alias("width"))
    return blocks.crossJoin(F.broadcast(left))


# splits and draws


@query(
    f"""WITH {T.FE}, {T.split("fe", TEST, SEED)}
SELECT 'train' AS part, count(DISTINCT config_id) AS n_configs, count(*) AS n_rows, sum(is_energy::INT)::BIGINT AS n_energy FROM train
UNION ALL SELECT 'test', count(DISTINCT config_id), count(*), sum(is_energy::INT)::BIGINT FROM test"""
)
def group_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Study(T.events(spark, sf_dir), TEST, SEED, features=2)
    both = s.train.withColumn("part", F.lit("train")).unionByName(s.test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count_distinct("config_id").alias("n_configs"), F.count(F.lit(1)).alias("n_rows"), F.count_if("is_energy").alias("n_energy"))


@query(f"WITH {T.FE}, {T.split('fe', TEST, SEED)}, {T.uniform('train_ids', SUB, 42)} SELECT config_id FROM chosen")
def random_subsample_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Sampler(T.events(spark, sf_dir), TEST, SEED, features=2).choose(SUB, 42)


@query(
    f"""WITH {T.FL}, ids AS (SELECT DISTINCT config_id FROM fl), {T.uniform("ids", 0.05, 7, "a")}, {T.uniform("ids", 0.1, 7, "b")}, {T.uniform("ids", 0.4, 7, "c")}
SELECT 0.05::DOUBLE AS fraction, config_id FROM a UNION ALL SELECT 0.1, config_id FROM b UNION ALL SELECT 0.4, config_id FROM c"""
)
def nested_random_subsamples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Sampler(T.lineitem(spark, sf_dir), features=3)
    parts = [s.choose(f, 7).select(F.lit(f).alias("fraction"), "config_id") for f in (0.05, 0.1, 0.4)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# fits and errors

_G3 = [(i, j) for i in range(3) for j in range(i, 3)]


@query(f"WITH {T.FL} SELECT {', '.join(f'round(sum(w*w*x{i}*x{j}), 3) + 0.0 AS g_{i}{j}' for i, j in _G3)}, {', '.join(f'round(sum(w*w*x{i}*y), 3) + 0.0 AS v_{i}' for i in range(3))} FROM fl")
def gram_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"g_{i}{j}" for i, j in _G3] + [f"v_{i}" for i in range(3)]
    return rounded(gram_sums(T.lineitem(spark, sf_dir), 3), 3, *names)


@query(f"WITH {T.FL}, {T.normal3('fl')} SELECT {r(6, 'b0', 'b1', 'b2')} FROM m")
def wls_full_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    beta = Study(T.lineitem(spark, sf_dir), features=3).fit()
    return rounded(row(spark, ["b0", "b1", "b2"], beta), 6, "b0", "b1", "b2")


@query(f"WITH {T.FL}, g AS (SELECT * REPLACE (1.0::DOUBLE AS w) FROM fl), {T.normal3('g')} SELECT {r(6, 'b0', 'b1', 'b2')} FROM m")
def wls_unweighted_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    beta = Study(T.lineitem(spark, sf_dir).withColumn("w", F.lit(1.0)), features=3).fit("qr")
    return rounded(row(spark, ["b0", "b1", "b2"], beta), 6, "b0", "b1", "b2")


@query(f"WITH {T.FO}, {T.normal2('fo')} SELECT {r(5, 'b0', 'b1')} FROM m")
def wls_orders_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    beta = Study(T.orders(spark, sf_dir), features=2).fit()
    return rounded(row(spark, ["b0", "b1"], beta), 5, "b0", "b1")


@query(
    f"""WITH {T.FL}, {T.normal3("fl")}, p AS (SELECT is_energy, b0 + b1*x1 + b2*x2 AS prediction, y FROM fl, m)
SELECT is_energy, count(*) AS n_rows, {r(6, "avg(prediction) AS mean_prediction", "sum(pow(prediction - y, 2)) / count(*) AS mean_r2")} FROM p GROUP BY is_energy"""
)
def residuals_by_row_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = T.lineitem(spark, sf_dir)
    rows = evaluate.residuals(f, Study(f).fit()).groupBy("is_energy")
    return rounded(rows.agg(F.count(F.lit(1)).alias("n_rows"), F.avg("prediction").alias("mean_prediction"), F.avg("r2").alias("mean_r2")), 6, "mean_prediction", "mean_r2")


@query(f"WITH {T.FE}, {T.normal2('fe')} SELECT {r(12, 'i00', 'i01', 'i11')} FROM m")
def normal_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverse of the normal matrix, from the triangle."""
    inverse = tsqr(T.events(spark, sf_dir), 2).inverse()
    return rounded(row(spark, ["i00", "i01", "i11"], inverse[np.triu_indices(2)]), 12, "i00", "i01", "i11")


@query(f"WITH {T.FL} SELECT {', '.join(f'round(sum(w*w*x{i}*x{j}), 3) + 0.0 AS g_{i}{j}' for i, j in _G3)} FROM fl")
def tsqr_tree_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R'R of a triangle that is merged in groups, as where many tasks' triangles are more than the driver may gather."""
    factor = tsqr(T.lineitem(spark, sf_dir).repartition(40), 3, gather=3 * 3 * 8 * 2)
    g = factor.r.T @ factor.r
    return rounded(row(spark, [f"g_{i}{j}" for i, j in _G3], [g[i, j] for i, j in _G3]), 3, *[f"g_{i}{j}" for i, j in _G3])


_LEFT = f"{T.FE}, ids AS (SELECT DISTINCT config_id FROM fe), {T.uniform('ids', 0.1, 5, 'gone')}, rest AS (SELECT * FROM fe WHERE config_id NOT IN (SELECT config_id FROM gone)), {T.normal2('rest')}"


def _few(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list]:
    """The frame, a tenth of its configurations, and their sums (G, v)."""
    f = T.events(spark, sf_dir)
    chosen = Sampler(f).choose(0.1, 5)
    own = greedy.statistics(frames_of.members(f, chosen), 2).collect()
    return f, chosen, [(np.array(x["g"]).reshape(2, 2), np.array(x["v"])) for x in own]


@query(f"WITH {_LEFT} SELECT {r(9, 'i00', 'i01', 'i11')}, {r(6, 'b0', 'b1')} FROM m")
def woodbury_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse and coefficients after configurations go, one low-rank update each."""
    f, _, sums = _few(spark, sf_dir)
    factor = tsqr(f, 2)
    inverse, xty = factor.inverse(), factor.xty
    for g, v in sums:
        inverse, _ = woodbury(inverse, xty, x := root(g), np.zeros(len(x)), add=False)
        xty = xty - v
    values = [*inverse[np.triu_indices(2)], *(inverse @ xty)]
    return rounded(rounded(row(spark, ["i00", "i01", "i11", "b0", "b1"], values), 9, "i00", "i01", "i11"), 6, "b0", "b1")


@query(f"WITH {T.FE}, {T.normal2('fe')} SELECT {r(6, 'b0', 'b1')} FROM m")
def qr_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of all rows, from the triangle of nine tenths and appended rows."""
    f, chosen, sums = _few(spark, sf_dir)
    factor = tsqr(frames_of.others(f, chosen), 2)
    for g, v in sums:
        factor = Factor(factor.append(x := root(g), np.zeros(len(x))).r, factor.xty + v)
    return rounded(row(spark, ["b0", "b1"], factor.coefficients()), 6, "b0", "b1")


_E3 = "b0 + b1*x1 + b2*x2 - y"
_E2 = "b0 + b1*x1 - y"


def _cells(part: str, e: str, name: str) -> str:
    return f"round(sqrt(avg(CASE WHEN part = '{part}' AND {e} THEN r2 END)), 6) + 0.0 AS {name}"


_4WAY = ", ".join(_cells(p, e, f"{k}_{p}") for p in ("train", "test") for k, e in (("e", "is_energy"), ("f", "NOT is_energy")))


@query(
    f"""WITH {T.FL}, {T.split("fl", TEST, SEED)}, {T.normal3("train")},
p AS (SELECT 'train' AS part, is_energy, pow({_E3}, 2) AS r2 FROM train, m UNION ALL SELECT 'test', is_energy, pow({_E3}, 2) FROM test, m)
SELECT {_4WAY} FROM p"""
)
def rmse_4way(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Study(T.lineitem(spark, sf_dir), TEST, SEED, features=3)
    s.fit()
    return rounded(s.errors(), 6, "e_train", "f_train", "e_test", "f_test")


def _6way(frame: str, normal: str, e: str, choose: str, digits: int = 6) -> str:
    cells = ", ".join(
        f"round(sqrt(avg(CASE WHEN {c} AND {k} THEN r2 END)), {digits}) + 0.0 AS {n}_{p}"
        for p, c in (("sub", "sub"), ("train", "part = 'train'"), ("test", "part = 'test'"))
        for n, k in (("e", "is_energy"), ("f", "NOT is_energy"))
    )
    return f"""{choose}, sub_rows AS (SELECT * FROM train WHERE config_id IN (SELECT config_id FROM chosen)), {normal},
p AS (SELECT 'train' AS part, config_id IN (SELECT config_id FROM chosen) AS sub, is_energy, pow({e}, 2) AS r2 FROM train, m
      UNION ALL SELECT 'test', false, is_energy, pow({e}, 2) FROM test, m)
SELECT {cells} FROM p"""


@query(f"WITH {T.FL}, {T.split('fl', TEST, SEED)}, " + _6way("fl", T.normal3("sub_rows"), _E3, T.uniform("train_ids", SUB, 42)))
def rmse_6way_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Sampler(T.lineitem(spark, sf_dir), TEST, SEED, features=3)
    s.choose(SUB, 42)
    s.fit_chosen()
    return rounded(s.chosen_errors(), 6, *evaluate.METRICS)


# leverage

_H2 = "w*w*(i00*x0*x0 + 2*i01*x0*x1 + i11*x1*x1)"
_H3 = "w*w*(i00*x0*x0 + i11*x1*x1 + i22*x2*x2 + 2*(i01*x0*x1 + i02*x0*x2 + i12*x1*x2))"
_FIRST = "arg_min(h, CASE WHEN is_energy THEN row_id ELSE row_id + 4611686018427387904 END)"


@query(f"WITH {T.FE}, {T.normal2('fe')} SELECT row_id, config_id, is_energy, round({_H2}, 9) + 0.0 AS h FROM fe, m")
def row_leverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(score.row_leverage(T.events(spark, sf_dir)), 9, "h")


@query(f"WITH {T.FE}, {T.normal2('fe')}, h AS (SELECT row_id, config_id, is_energy, {_H2} AS h FROM fe, m) SELECT config_id, round({_FIRST}, 9) + 0.0 AS score FROM h GROUP BY config_id")
def leverage_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(score.config_leverage(T.events(spark, sf_dir), block=False), 9, "score")


_BLOCK = f"{T.normal2('fe')}, scores AS (SELECT config_id, sum({_H2}) AS score FROM fe, m GROUP BY config_id)"


@query(f"WITH {T.FE}, {_BLOCK} SELECT config_id, round(score, 9) + 0.0 AS score FROM scores")
def leverage_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(score.config_leverage(T.events(spark, sf_dir), block=True), 9, "score")


@query(f"WITH {T.FE}, {_BLOCK} SELECT 'leverage' AS kind, config_id, round(score / sum(score) OVER (), 9) + 0.0 AS probability FROM scores UNION ALL SELECT 'zero', config_id, round(1.0::DOUBLE / count(*) OVER (), 9) + 0.0 FROM scores")
def leverage_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = score.config_leverage(T.events(spark, sf_dir), block=True)
    both = score.probabilities(scores).select(F.lit("leverage").alias("kind"), "*").unionByName(score.probabilities(scores.withColumn("score", F.lit(0.0))).select(F.lit("zero").alias("kind"), "*"))
    return rounded(both, 9, "probability")


@query(f"WITH {T.FE}, {_BLOCK}, {T.race('scores', f'round_even(n * {SUB}, 0)', 42)} SELECT config_id FROM chosen")
def leverage_weighted_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LeverageSampler(T.events(spark, sf_dir), block=True, features=2).choose(SUB, 42)


@query(f"WITH {T.FE}, {T.normal2('fe')} SELECT row_id, config_id, round({_H2}, 9) + 0.0 AS h FROM fe, m")
def leverage_rank_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature that is there twice changes no leverage once small singular values are left out."""
    f = T.events(spark, sf_dir).withColumn("features", F.concat("features", F.slice("features", 2, 1)))
    return rounded(score.row_leverage(f, tsqr(f, 3, moments=False), rank_filtered=True).select("row_id", "config_id", "h"), 9, "h")


# Cook's distance at once

_COOK = f"""{T.normal3("fl")}, hs AS (SELECT row_id, config_id, {_H3} AS h, w*({_E3}) AS e FROM fl, m WHERE is_energy),
scores AS (SELECT row_id, config_id, CASE WHEN h >= 1 - 1e-12 THEN 'inf'::DOUBLE ELSE e*e*h / ((1-h)*(1-h)) END AS score FROM hs)"""


@query(f"WITH {T.FL}, {_COOK} SELECT row_id, config_id, round(score, 5) + 0.0 AS score FROM scores")
def cooks_onestep_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(score.cooks_onestep(T.lineitem(spark, sf_dir)), 5, "score")


@query(f"WITH {T.FL}, {_COOK} SELECT row_id, config_id, round(score, 5) + 0.0 AS score FROM scores")
def cooks_onestep_scores_svd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(score.cooks_onestep(T.lineitem(spark, sf_dir), svd=True), 5, "score")


@query(f"WITH {T.FL}, {_COOK} SELECT config_id FROM (SELECT config_id, row_number() OVER (ORDER BY score DESC, config_id) AS rk, count(*) OVER () AS n FROM scores) WHERE rk <= round_even(n * 0.1, 0)")
def cooks_onestep_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CooksSampler(T.lineitem(spark, sf_dir), sampling=False, features=3).choose(0.1, 0)


@query(f"WITH {T.FL}, {_COOK}, {T.race('scores', 'round_even(n * 0.1, 0)', 42)} SELECT config_id FROM chosen")
def cooks_onestep_weighted_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CooksSampler(T.lineitem(spark, sf_dir), features=3).choose(0.1, 42)


# Cook's distance step by step

_STATS = """st AS (SELECT config_id, sum(w*w*x0*x0) AS g00, sum(w*w*x0*x1) AS g01, sum(w*w*x1*x1) AS g11, sum(w*w*x0*y) AS v0, sum(w*w*x1*y) AS v1 FROM fe GROUP BY config_id)"""


@query(f"WITH {T.FE}, {_STATS} SELECT config_id, {r(6, 'g00', 'g01', 'g11', 'v0', 'v1')} FROM st")
def config_sufficient_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = greedy.statistics(T.events(spark, sf_dir), 2)
    at = lambda c, i: F.get(c, F.lit(i))
    s = s.select("config_id", at("g", 0).alias("g00"), at("g", 1).alias("g01"), at("g", 3).alias("g11"), at("v", 0).alias("v0"), at("v", 1).alias("v1"))
    return rounded(s, 6, "g00", "g01", "g11", "v0", "v1")


def _start(fraction: float, seed: int = 5) -> str:
    return f"ids AS (SELECT DISTINCT config_id FROM fe), {T.uniform('ids', fraction, seed, 's0')}"


def _block_sql(sign: str) -> str:
    """D = q' (A +- G)^-1 q for two features."""
    return f"(q0*q0*(a11 {sign} g11) - 2*q0*q1*(a01 {sign} g01) + q1*q1*(a00 {sign} g00)) / ((a00 {sign} g00)*(a11 {sign} g11) - (a01 {sign} g01)*(a01 {sign} g01))"


def _scores_sql(sign: str, fraction: float, where: str) -> str:
    return f"""WITH {T.FE}, {_STATS}, {_start(fraction)},
a AS (SELECT sum(g00) AS a00, sum(g01) AS a01, sum(g11) AS a11, sum(v0) AS c0, sum(v1) AS c1 FROM st WHERE config_id IN (SELECT config_id FROM s0)),
b AS (SELECT *, (a11*c0 - a01*c1)/(a00*a11 - a01*a01) AS b0, (a00*c1 - a01*c0)/(a00*a11 - a01*a01) AS b1 FROM a),
q AS (SELECT st.*, b.*, g00*b0 + g01*b1 - v0 AS q0, g01*b0 + g11*b1 - v1 AS q1 FROM st, b WHERE config_id {where} (SELECT config_id FROM s0))
SELECT config_id, round({_block_sql(sign)}, 6) + 0.0 AS score FROM q"""


def _block_scores(spark: SparkSession, sf_dir: str, add: bool, fraction: float) -> DataFrame:
    f = T.events(spark, sf_dir)
    s = CooksSampler(f, block=True, stepwise=True, ascending=add, initial_fraction=fraction)
    found = greedy.candidates(s.train, 2)
    chosen = s.start(5)
    a, b = found.total(chosen)
    state = greedy.State(a, b, chosen)
    own = np.isin(found.ids, list(chosen)) != add
    scores = greedy.block_scores(found.g[own], found.v[own], state.a, state.beta(), add)
    return rounded(spark.createDataFrame([(int(i), float(x)) for i, x in zip(found.ids[own], scores)], "config_id long, score double"), 6, "score")


@query(_scores_sql("+", 0.2, "NOT IN"))
def block_cooks_add_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _block_scores(spark, sf_dir, True, 0.2)


@query(_scores_sql("-", 0.6, "IN"))
def block_cooks_remove_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _block_scores(spark, sf_dir, False, 0.6)


@query(
    f"""WITH {T.FE}, {_start(0.2)}, chosen_rows AS (SELECT * FROM fe WHERE config_id IN (SELECT config_id FROM s0)), {T.normal2("chosen_rows")},
h AS (SELECT row_id, config_id, {_H2} AS h, w*({_E2}) AS e FROM fe, m WHERE is_energy AND config_id NOT IN (SELECT config_id FROM s0))
SELECT row_id, config_id, round(e*e*h/(1+h), 6) + 0.0 AS score FROM h"""
)
def energy_cooks_stepwise_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = T.events(spark, sf_dir)
    chosen = Sampler(f).choose(0.2, 5)
    factor = tsqr(frames_of.members(f, chosen), 2)
    rows = frames_of.others(f, chosen).where("is_energy")
    beta = factor.coefficients()
    h = score.leverage_column(factor)
    e = (score.dot("features", beta) - F.col("y")) * F.col("w")
    out = rows.select("row_id", "config_id", h.alias("h"), e.alias("e")).select("row_id", "config_id", (F.col("e") * F.col("e") * F.col("h") / (1 + F.col("h"))).alias("score"))
    return rounded(out, 6, "score")


def _stepwise_sql(block: bool, add: bool, initial: float, final: float, start: str | None = None) -> str:
    """The greedy loop as a recursive query over (A, b, ids)."""
    sign = "+" if add else "-"
    order = "d DESC" if add else "d ASC"
    inside = "NOT list_contains" if add else "list_contains"
    if block:
        cand = "SELECT c.*, s.*, g00*b0 + g01*b1 - v0 AS q0, g01*b0 + g11*b1 - v1 AS q1 FROM s, st c"
        d = _block_sql(sign)
    else:
        cand = "SELECT c.*, s.*, en.ew AS ew, en.ex1 AS x1, en.ey AS ey FROM s, st c JOIN en USING (config_id)"
        h = "(ew*ew*(a11 - 2*a01*x1 + a00*x1*x1)/(a00*a11 - a01*a01))"
        d = f"pow(ew*(b0 + b1*x1 - ey), 2) * {h} / (1 + {h})"
    return f"""WITH RECURSIVE {T.FE}, {_STATS}, en AS (SELECT config_id, w AS ew, x1 AS ex1, y AS ey FROM fe WHERE is_energy), {start or _start(initial)},
n AS (SELECT round_even(count(*) * {final}, 0)::INT AS k, round_even(count(*) * {initial}, 0)::INT AS k0 FROM ids),
loop AS (
  SELECT 0 AS step, NULL::BIGINT AS config_id, sum(g00) AS a00, sum(g01) AS a01, sum(g11) AS a11, sum(v0) AS c0, sum(v1) AS c1, list(config_id) AS ids FROM st WHERE config_id IN (SELECT config_id FROM s0)
  UNION ALL
  SELECT step + 1, config_id, a00 {sign} g00, a01 {sign} g01, a11 {sign} g11, c0 {sign} v0, c1 {sign} v1,
         {"list_append(ids, config_id)" if add else "list_filter(ids, lambda x: x <> config_id)"}
  FROM (SELECT *, row_number() OVER (ORDER BY {order}, config_id) AS rk FROM (
    SELECT *, {d} AS d FROM ({cand.replace("FROM s,", "FROM (SELECT l.step, l.a00, l.a01, l.a11, l.c0, l.c1, l.ids, (a11*c0 - a01*c1)/(a00*a11 - a01*a01) AS b0, (a00*c1 - a01*c0)/(a00*a11 - a01*a01) AS b1 FROM loop l, n WHERE l.step < abs(n.k - n.k0)) s,")}) WHERE {inside}(ids, config_id)))
  WHERE rk = 1)
SELECT step::INT AS step, config_id FROM loop WHERE step > 0"""


def _stepwise(spark: SparkSession, sf_dir: str, block: bool, add: bool, initial: float, final: float, start: str = "random", **how) -> DataFrame:
    s = CooksSampler(T.events(spark, sf_dir), seed=0, block=block, stepwise=True, ascending=add, initial=start, initial_fraction=initial, features=2, **how)
    s.choose(final, 5)
    steps = pa.table({"step": pa.array([k for k, _, _ in s.state.steps], pa.int32()), "config_id": pa.array([i for _, i, _ in s.state.steps], pa.int64())})
    return spark.createDataFrame(steps)


@query(_stepwise_sql(False, True, 0.1, 0.2))
def stepwise_asc_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stepwise(spark, sf_dir, False, True, 0.1, 0.2)


@query(_stepwise_sql(True, True, 0.1, 0.2))
def stepwise_asc_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stepwise(spark, sf_dir, True, True, 0.1, 0.2)


@query(_stepwise_sql(False, False, 0.5, 0.4))
def stepwise_desc_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stepwise(spark, sf_dir, False, False, 0.5, 0.4)


@query(_stepwise_sql(True, False, 0.5, 0.4))
def stepwise_desc_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stepwise(spark, sf_dir, True, False, 0.5, 0.4)


@query(_stepwise_sql(True, True, 0.1, 0.2))
def stepwise_asc_block_woodbury(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same steps where the inverse is updated instead of the triangle."""
    return _stepwise(spark, sf_dir, True, True, 0.1, 0.2, update_method="woodbury")


@query(_stepwise_sql(False, True, 0.1, 0.2))
def stepwise_asc_energy_qr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stepwise(spark, sf_dir, False, True, 0.1, 0.2, update_method="qr")


@query(_stepwise_sql(True, False, 0.5, 0.4))
def stepwise_desc_block_svd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stepwise(spark, sf_dir, True, False, 0.5, 0.4, factorization="svd")


_LEVERAGE_START = f"ids AS (SELECT DISTINCT config_id FROM fe), {_BLOCK.replace('scores AS', 'lev AS')}, {T.race('lev', 'round_even(n * 0.1, 0)', 5, 's0')}"


@query(_stepwise_sql(True, True, 0.1, 0.2, _LEVERAGE_START))
def stepwise_asc_block_leverage_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stepwise(spark, sf_dir, True, True, 0.1, 0.2, "leverage")


# learning curves

CURVE = [(0.1, 2), (0.3, 1)]


def _curve_sql(choose) -> str:
    parts = []
    for f, repeats in CURVE:
        for j in range(repeats):
            inner = f"WITH {T.FE}, {T.split('fe', TEST, SEED)}, " + _6way("fe", T.normal2("sub_rows"), _E2, choose(f, j))
            parts += [f'SELECT {j}::INT AS "repeat", {f}::DOUBLE AS fraction, \'{m}\' AS metric, {m} AS rmse FROM ({inner})' for m in evaluate.METRICS]
    return " UNION ALL ".join(parts)


@query(_curve_sql(lambda f, j: T.uniform("train_ids", f, 42 + j)))
def learning_curve_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Sampler(T.events(spark, sf_dir), TEST, SEED, features=2)
    return rounded(s.curve([f for f, _ in CURVE], [n for _, n in CURVE], 42), 6, "rmse")


@query(_curve_sql(lambda f, j: f"{T.normal2('train', 't')}, scores AS (SELECT config_id, sum({_H2}) AS score FROM train, t GROUP BY config_id), {T.race('scores', f'round_even(n * {f}, 0)', 42 + j)}"))
def learning_curve_leverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = LeverageSampler(T.events(spark, sf_dir), TEST, SEED, block=True, features=2)
    return rounded(s.curve([f for f, _ in CURVE], [n for _, n in CURVE], 42), 6, "rmse")


# many features


@query()
def tsqr_embeddings_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 65 x 65 triangle of the embeddings, as (row, entries)."""
    r_ = tsqr(T.vectors(spark, sf_dir), 65).r
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(r_)], "row int, entries array<double>")


@query()
def leverage_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(score.config_leverage(T.vectors(spark, sf_dir), block=True, rank_filtered=True), 9, "score")


@query()
def stepwise_embeddings_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = CooksSampler(T.vectors(spark, sf_dir), block=True, stepwise=True, initial_fraction=0.4)
    s.choose(0.5, 5)
    return spark.createDataFrame([(k, i) for k, i, _ in s.state.steps], "step int, config_id long")

"""Leverage and Cook's distance of rows and configurations, and selections by them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import race_key, smallest, unit
from ..functions.vectors import UNROLL, dot, quadratic
from .factor import Factor, tsqr
from .frame import width

#: Salts keep the draws of different steps apart under one seed.
SPLIT, UNIFORM, WEIGHTED = "split", "uniform", "weighted"
#: From here on a leverage counts as 1, and Cook's distance as infinite.
ONE = 1 - 1e-12


def _arrow_quadratic(whitener: np.ndarray):
    def run(features: pd.Series, w: pd.Series) -> pd.Series:
        x = np.stack(features.to_numpy()) * w.to_numpy()[:, None] if len(features) else np.zeros((0, whitener.shape[1]))
        return pd.Series(((x @ whitener.T) ** 2).sum(axis=1))

    return F.pandas_udf(run, "double")


def leverage_column(factor: Factor, rank_filtered: bool = False) -> Column:
    """A row's leverage |R^-T w x|^2: unrolled for few features, in Arrow batches for many."""
    m = factor.whitener(rank_filtered)
    if factor.p > UNROLL // 2:
        return _arrow_quadratic(m)("features", "w")
    return quadratic("features", m) * F.col("w") * F.col("w")


def row_leverage(frame: DataFrame, factor: Factor | None = None, rank_filtered: bool = False) -> DataFrame:
    factor = factor or tsqr(frame, width(frame), moments=False)
    return frame.select("row_id", "config_id", "is_energy", leverage_column(factor, rank_filtered).alias("h"))


def config_leverage(frame: DataFrame, block: bool, factor: Factor | None = None, rank_filtered: bool = False) -> DataFrame:
    """(config_id, score): the sum over a configuration's rows, or that of its first energy row (else its first row)."""
    rows = row_leverage(frame, factor, rank_filtered)
    if block:
        return rows.groupBy("config_id").agg(F.sum("h").alias("score"))
    return rows.groupBy("config_id").agg(F.min_by("h", F.struct(~F.col("is_energy"), "row_id")).alias("score"))


def probabilities(scores: DataFrame) -> DataFrame:
    """Scores over their sum; uniform if the sum is 0."""
    total, n = scores.agg(F.sum("score"), F.count(F.lit(1))).first()
    share = F.col("score") / F.lit(total) if total else F.lit(1.0 / max(n, 1))
    return scores.select("config_id", share.alias("probability"))


def cooks_onestep(frame: DataFrame, factor: Factor | None = None, svd: bool = False) -> DataFrame:
    """(row_id, config_id, score) of energy rows: e^2 h / (1 - h)^2 under the fit on all rows; infinite where h is 1."""
    factor = factor or tsqr(frame, width(frame))
    beta = factor.svd()[0] @ factor.xty if svd else factor.coefficients()
    rows = frame.where("is_energy").select("row_id", "config_id", leverage_column(factor, svd).alias("h"), ((dot("features", beta) - F.col("y")) * F.col("w")).alias("e"))
    rest = 1 - F.col("h")
    score = F.when(F.col("h") >= ONE, F.lit(float("inf"))).otherwise(F.col("e") * F.col("e") * F.col("h") / (rest * rest))
    return rows.select("row_id", "config_id", score.alias("score"))


def one_a_config(scores: DataFrame) -> DataFrame:
    """A configuration with several scored rows counts with the largest."""
    return scores.groupBy("config_id").agg(F.max("score").alias("score"))


def uniform_draw(ids: DataFrame, k: int, seed: int, salt: str = UNIFORM, total: int | None = None) -> DataFrame:
    """k ids at random; for one seed the draws for smaller k are part of those for larger."""
    return smallest(ids.select("config_id", unit(F.col("config_id"), seed, salt).alias("u")), "u", k, total=total)


def weighted_draw(scores: DataFrame, k: int, seed: int, salt: str = WEIGHTED) -> DataFrame:
    """k ids in proportion to their scores, without replacement; all equal if every score is 0."""
    total, positive, n = scores.agg(F.sum("score"), F.count_if(F.col("score") > 0), F.count(F.lit(1))).first()
    own = scores.withColumn("score", F.lit(1.0)) if not total else scores
    if k > (n if not total else positive):
        raise ValueError(f"{k} draws of {positive} configurations with a positive score")
    keyed = own.select("config_id", race_key(unit(F.col("config_id"), seed, salt), F.col("score")).alias("u"))
    return smallest(keyed, "u", k, total=n if not total else positive)


def top(scores: DataFrame, k: int) -> DataFrame:
    """The k ids with the largest scores; ties go to the smaller id."""
    return smallest(scores.select("config_id", (-F.col("score")).alias("u")), "u", k)

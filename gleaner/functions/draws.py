"""Seeded draws: uniform numbers from hashes, and exact choices of the k rows with the smallest keys.

A draw depends on the salt, the seed and the id alone, so it is the same under any partitioning and in any engine that has md5.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which one sort chooses; beyond, quantiles bound a narrow band first and only that is sorted.
SORTABLE = 200_000
ACCURACY = 10_000


def unit(ids: Column, seed: int, salt: str) -> Column:
    """A number in (0, 1) per id: 52 bits of md5."""
    text = F.concat(F.lit(f"{salt}|{seed}|"), ids.cast("string"))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def race_key(u: Column, score: Column) -> Column:
    """Keys whose k smallest are k successive draws in proportion to the scores, without replacement."""
    return F.when(score > 0, -F.log(u) / score)


def smallest(rows: DataFrame, key: str, k: int, id_col: str = "config_id", total: int | None = None) -> DataFrame:
    """The ids of the k rows with the smallest (key, id); rows with a null key are no candidates.

    Large tables never meet in one task: approximate quantiles around rank k give a band that surely holds the k-th
    row (checked by exact counts, widened if not), all rows below it are taken, and the choice goes on within the band:
    by the key while the band is large, by the id where all its keys are equal.
    """
    rows = rows.where(F.col(key).isNotNull())
    total = rows.count() if total is None else total
    if k <= 0:
        return rows.limit(0).select(id_col)
    if k >= total:
        return rows.select(id_col)
    if total <= SORTABLE:
        return rows.orderBy(key, id_col).limit(k).select(id_col)
    margin = 4 / ACCURACY
    while True:
        ask = [max(0.0, k / total - margin), min(1.0, k / total + margin)]
        low, high = rows.agg(F.percentile_approx(key, ask, ACCURACY)).first()[0]
        low = -math.inf if ask[0] == 0.0 else low
        high = math.inf if ask[1] == 1.0 else high
        below, upto = rows.agg(F.count_if(F.col(key) < low), F.count_if(F.col(key) <= high)).first()
        if below <= k <= upto:
            break
        margin *= 2
    band, n, more = rows.where((F.col(key) >= low) & (F.col(key) <= high)), upto - below, k - below
    if n <= SORTABLE:
        rest = band.orderBy(key, id_col).limit(more).select(id_col)
    elif low < high and n < total:
        rest = smallest(band, key, more, id_col, n)
    elif key != id_col:
        rest = smallest(band.select(id_col), id_col, more, id_col, n) if low == high else _ranked(band, key, more, id_col)
    else:
        rest = band.limit(more).select(id_col)  # one id, again and again
    return rows.where(F.col(key) < low).select(id_col).unionByName(rest)


def _ranked(rows: DataFrame, key: str, k: int, id_col: str) -> DataFrame:
    """For bands that quantiles can't narrow: the k-th row by a global sort, which is distributed."""
    last = rows.orderBy(key, id_col).select(key, id_col).offset(k - 1).limit(1).first()
    return rows.where((F.col(key) < last[0]) | ((F.col(key) == last[0]) & (F.col(id_col) <= last[1]))).select(id_col)


def half_even(x: float) -> int:
    """Rounding as the subsample size is rounded: halves go to the even neighbour."""
    return round(x)

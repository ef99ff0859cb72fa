import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import draws
from gleaner.operators import score
from gleaner.sampling import CooksSampler, LeverageSampler

from .data import arrays, fit, frame


def leverage(x, w):
    q = np.linalg.qr(x * w[:, None])[0]
    return (q * q).sum(axis=1)


@pytest.mark.parametrize("p", [4, 30])
def test_row_leverage(spark, p):
    x, y, w, c, e = arrays(60, 5, p)
    got = score.row_leverage(frame(spark, x, y, w, c, e)).orderBy("row_id").toPandas()["h"]
    assert np.abs(got - leverage(x, w)).max() < 1e-10 and abs(got.sum() - p) < 1e-9


def test_config_leverage(spark):
    x, y, w, c, e = arrays(60, 5, 4, first=False)
    e[:5] = False  # without an energy row the first row stands for a configuration
    h = leverage(x, w)
    f = frame(spark, x, y, w, c, e)
    block = score.config_leverage(f, True).orderBy("config_id").toPandas()["score"]
    assert np.abs(block - h.reshape(60, 5).sum(axis=1)).max() < 1e-10
    one = score.config_leverage(f, False).orderBy("config_id").toPandas()["score"]
    assert np.abs(one - np.r_[h[0], h.reshape(60, 5)[1:, 4]]).max() < 1e-10


def test_cooks_onestep(spark):
    x, y, w, c, e = arrays(60, 5, 4, ids=np.arange(60)[::-1])
    h, r = leverage(x, w), (x @ fit(x, y, w) - y) * w
    want = (r * r * h / (1 - h) ** 2)[e]
    for svd in (False, True):
        got = score.cooks_onestep(frame(spark, x, y, w, c, e), svd=svd).orderBy("row_id").toPandas()
        assert np.abs(got["score"] - want).max() < 1e-9 and (got["config_id"] == c[e]).all()
    picked = CooksSampler(frame(spark, x, y, w, c, e), sampling=False).choose(0.5)
    assert {r["config_id"] for r in picked.collect()} == set(c[e][np.argsort(-want)[:30]].tolist())


def test_leverage_one_counts_as_infinite(spark):
    x, y, w, c, e = arrays(20, 2, 3)
    x = np.column_stack([x, np.arange(40) == 0])
    got = score.cooks_onestep(frame(spark, x.astype(float), y, w, c, e)).orderBy("row_id").toPandas()["score"]
    assert np.isinf(got[0]) and np.isfinite(got[1:]).all()


def test_probabilities_and_zero_sum(spark):
    s = spark.createDataFrame([(1, 1.0), (2, 3.0)], "config_id long, score double")
    assert {r[0]: r[1] for r in score.probabilities(s).collect()} == {1: 0.25, 2: 0.75}
    z = s.withColumn("score", F.lit(0.0))
    assert {r[1] for r in score.probabilities(z).collect()} == {0.5}
    assert score.weighted_draw(z, 1, 3).count() == 1
    with pytest.raises(ValueError):
        score.weighted_draw(s.withColumn("score", F.when(F.col("config_id") == 1, 0.0).otherwise(1.0)), 2, 3)


def test_draws_are_nested_and_do_not_depend_on_partitions(spark):
    ids = spark.range(1000).select(F.col("id").alias("config_id"))
    small = {r[0] for r in score.uniform_draw(ids, 50, 4).collect()}
    large = {r[0] for r in score.uniform_draw(ids.repartition(9), 200, 4).collect()}
    assert len(small) == 50 and len(large) == 200 and small < large
    assert small != {r[0] for r in score.uniform_draw(ids, 50, 5).collect()}


def test_smallest_by_quantile_band(spark, monkeypatch):
    rows = spark.range(5000).select(F.col("id").alias("config_id"), (F.xxhash64("id") % 700).cast("double").alias("k"))
    want = {r[0] for r in rows.orderBy("k", "config_id").limit(1234).collect()}
    monkeypatch.setattr(draws, "SORTABLE", 10)
    monkeypatch.setattr(draws, "ACCURACY", 100)
    assert {r[0] for r in draws.smallest(rows, "k", 1234).collect()} == want
    assert draws.smallest(rows, "k", 0).count() == 0 and draws.smallest(rows, "k", 9999).count() == 5000


def test_weighted_draw_prefers_large_scores(spark):
    s = spark.range(2000).select(F.col("id").alias("config_id"), F.when(F.col("id") < 1000, 9.0).otherwise(1.0).alias("score"))
    got = [r[0] for r in score.weighted_draw(s, 200, 1).collect()]
    assert 160 <= sum(i < 1000 for i in got) <= 195


def test_leverage_sampler(spark):
    f = frame(spark, *arrays(60, 5, 4))
    a = LeverageSampler(f, block=True).choose(0.3, 2)
    b = LeverageSampler(f.repartition(6), block=True, factorization="svd").choose(0.3, 2)
    assert a.count() == 18 and {r[0] for r in a.collect()} == {r[0] for r in b.collect()}
    with pytest.raises(ValueError):
        LeverageSampler(f, factorization="lu")


def test_smallest_with_ties(spark, monkeypatch):
    """Equal keys by the thousand are settled by id, not by one sort of them all."""
    from gleaner.functions import draws

    monkeypatch.setattr(draws, "SORTABLE", 50)
    keys = [float("inf") if i % 3 else float(i % 5) for i in range(3000)]
    rows = spark.createDataFrame([((i * 7919) % 3000, k) for i, k in enumerate(keys)], "config_id long, u double").repartition(4)
    every = sorted(((k, (i * 7919) % 3000) for i, k in enumerate(keys)))
    for k in (1, 190, 700, 1500, 2999):
        got = {r["config_id"] for r in draws.smallest(rows, "u", k).collect()}
        assert got == {i for _, i in every[:k]}

import numpy as np
import pytest

from gleaner.operators import evaluate, greedy
from gleaner.sampling import CooksSampler, Sampler, Study

from .data import arrays, fit, frame


def test_split_and_errors(spark):
    x, y, w, c, e = arrays(40, 5, 4)
    s = Study(frame(spark, x, y, w, c, e), 0.33, 41)
    test = {r[0] for r in s.test_ids.collect()}
    assert len(test) == int(40 * 0.33)
    with pytest.raises(ValueError):
        s.errors()
    s.fit()
    own = np.isin(c, list(test))
    beta = fit(x[~own], y[~own], w[~own])
    r2 = (x @ beta - y) ** 2
    want = [np.sqrt(r2[m & k].mean()) for m in (~own, own) for k in (e, ~e)]
    assert np.allclose(list(s.errors().first()), want)
    for bad in (-0.1, 1.0):
        with pytest.raises(ValueError):
            Study(s.frame, bad)


def test_no_test_rows_and_given_test_ids(spark):
    f = frame(spark, *arrays(10, 3, 3))
    s = Study(f)
    s.fit()
    assert s.errors().first()["e_test"] is None
    ids = spark.createDataFrame([(3,), (4,)], "config_id long")
    assert Study(f, 0.5, 1, ids).test.count() == 6


def test_uniform_subsample(spark):
    x, y, w, c, e = arrays(50, 5, 4)
    s = Sampler(frame(spark, x, y, w, c, e), 0.2, 41)
    with pytest.raises(ValueError):
        s.chosen_errors()
    assert s.choose(0.0625, 1).count() == 2  # 2.5 rounds to even
    s.choose(0.3, 42)
    s.fit_chosen()
    own = np.isin(c, [r[0] for r in s.chosen.collect()])
    test = np.isin(c, [r[0] for r in s.test_ids.collect()])
    assert not (own & test).any()
    r2 = (x @ fit(x[own], y[own], w[own]) - y) ** 2
    want = [np.sqrt(r2[m & k].mean()) for m in (own, ~test, test) for k in (e, ~e)]
    assert np.allclose(list(s.chosen_errors().first()), want)
    for bad in (0, 1.2):
        with pytest.raises(ValueError):
            s.choose(bad)


def test_selector_hook(spark):
    pick = lambda train, k, seed: train.select("config_id").distinct().orderBy("config_id").limit(k)
    s = Sampler(frame(spark, *arrays(20, 3, 3)), selector=pick)
    assert [r[0] for r in s.choose(0.2).orderBy("config_id").collect()] == [0, 1, 2, 3]


def dense_steps(x, y, w, c, e, chosen, k, block, add):
    """The greedy loop over raw rows, with everything computed anew in each step."""
    x, y = x * w[:, None], y * w
    chosen, steps = set(chosen), []
    while len(chosen) != k:
        own = np.isin(c, list(chosen))
        inv = np.linalg.inv(x[own].T @ x[own])
        beta = inv @ x[own].T @ y[own]
        scores = {}
        for i in sorted(set(c.tolist())):
            if (i in chosen) == add:
                continue
            rows = c == i if block else (c == i) & e
            r, h = x[rows] @ beta - y[rows], x[rows] @ inv @ x[rows].T
            if block:
                scores[i] = r @ np.linalg.solve(np.eye(len(r)) + (h if add else -h), h @ r)
            else:
                scores[i] = (r * r * np.diag(h) / (1 + np.diag(h)))[0]
        best = max(scores, key=lambda i: scores[i]) if add else min(scores, key=lambda i: scores[i])
        chosen ^= {best}
        steps.append(best)
    return steps


@pytest.mark.parametrize("block", [False, True])
@pytest.mark.parametrize("add", [False, True])
def test_stepwise_matches_raw_rows(spark, block, add):
    x, y, w, c, e = arrays(24, 4, 3, noise=0.5)
    s = CooksSampler(frame(spark, x, y, w, c, e), block=block, stepwise=True, ascending=add, initial_fraction=0.25 if add else 0.75)
    start = s.start(3)
    s.choose(0.5, 3)
    assert [i for _, i, _ in s.state.steps] == dense_steps(x, y, w, c, e, start, 12, block, add)
    a, b = s._found.total(s.state.chosen)
    assert np.allclose(a, s.state.a) and np.allclose(b, s.state.b)


def test_stepwise_on_executors_and_many_features(spark):
    x, y, w, c, e = arrays(16, 3, 10, noise=0.5)
    f = frame(spark, x, y, w, c, e)
    for block in (True, False):
        start = set(range(8))
        near = greedy.stepwise(f, 11, start, block)
        far = greedy.stepwise(f, 11, start, block, found=greedy.candidates(f, 10, limit=0))
        assert [i for _, i, _ in near.steps] == [i for _, i, _ in far.steps] == dense_steps(x, y, w, c, e, start, 11, block, True)


def test_stepwise_contracts(spark):
    f = frame(spark, *arrays(12, 3, 3))
    with pytest.raises(NotImplementedError):
        CooksSampler(f, block=True)
    with pytest.raises(ValueError):
        CooksSampler(f, stepwise=True, ascending=False, update_method="qr")
    with pytest.raises(ValueError):
        CooksSampler(f, initial="best")
    with pytest.raises(ValueError):
        CooksSampler(f, stepwise=True).choose(0.5)  # all are chosen at the start
    assert CooksSampler(f, stepwise=True, strict=False).choose(0.5).count() == 12
    assert greedy.update_policy("auto", True, True, True) == "qr"
    assert greedy.update_policy("auto", True, False, True) == "woodbury"


def test_learning_curve(spark):
    s = Sampler(frame(spark, *arrays(30, 4, 3)), 0.2, 1)
    long = s.curve([0.5, 0.25], [1, 2], 7)
    assert long.count() == 3 * 6
    table = evaluate.wide(long)
    assert table.shape == (2, 12) and table.loc[1, ("e_sub", 0.5)] != table.loc[1, ("e_sub", 0.5)]
    same = s.curve(0.25, 2, 7, same_seed=True).where("metric = 'e_test'").toPandas()["rmse"]
    assert same.nunique() == 1
    for f, r in (([0.1, 0.2], [1, 2]), ([0.1], [1, 2])):
        with pytest.raises(ValueError):
            evaluate.schedule(f, r)


def test_descending_curve_goes_downwards(spark):
    s = CooksSampler(frame(spark, *arrays(20, 4, 3)), stepwise=True, ascending=False, initial_fraction=0.8)
    s.curve([0.4, 0.6], 1, 3)
    assert len(s.state.chosen) == 8


@pytest.mark.parametrize("add", [True, False])
def test_updates_agree(spark, add):
    """Every way of updating, on the driver and on the executors, takes the same steps; svd also where a feature is there twice."""
    x, y, w, c, e = arrays(24, 3, 3, seed=8)
    f = frame(spark, x, y, w, c, e)
    k, start = (12, set(range(6))) if add else (10, set(range(18)))
    want = None
    for limit in (greedy.DRIVER, 0):
        found = greedy.candidates(f, 3, limit)
        for method, svd in [("woodbury", False), ("auto", False), ("auto", True)] + ([("qr", False)] if add else []):
            steps = greedy.stepwise(f, k, start, True, add, True, found, method, svd).steps
            want = want or steps
            assert [i for _, i, _ in steps] == [i for _, i, _ in want] and np.allclose([s for *_, s in steps], [s for *_, s in want])
        found.release()
    twice = frame(spark, np.column_stack([x, x[:, 1]]), y, w, c, e)
    steps = greedy.stepwise(twice, k, start, True, add, True, None, "auto", True).steps
    assert [i for _, i, _ in steps] == [i for _, i, _ in want]


def test_spread_candidates_send_changes_only(spark, monkeypatch):
    monkeypatch.setattr(greedy, "REFRESH", 3)
    f = frame(spark, *arrays(20, 3, 3, seed=9))
    a = greedy.stepwise(f, 14, set(range(5)), True, True, True, greedy.candidates(f, 3)).steps
    assert [i for _, i, _ in greedy.stepwise(f, 14, set(range(5)), True, True, True, greedy.candidates(f, 3, 0)).steps] == [i for _, i, _ in a]

import numpy as np
import pytest

from gleaner.operators import factor as F

from .data import arrays, fit, frame


def test_tsqr_matches_dense_qr_under_any_partitioning(spark):
    x, y, w, c, e = arrays(200, 5, 6)
    f = frame(spark, x, y, w, c, e)
    want = F.positive(np.linalg.qr(x * w[:, None], mode="r"))
    for g in (f.coalesce(1), f.repartition(7), f.repartition(3, "config_id")):
        got = F.tsqr(g, 6)
        assert np.abs(got.r - want).max() < 1e-10
        assert np.abs(got.xty - (x * w[:, None]).T @ (y * w)).max() < 1e-9


def test_folding_in_groups(spark, monkeypatch):
    x, y, w, c, e = arrays(200, 5, 6)
    f = frame(spark, x, y, w, c, e).repartition(9)
    want = F.tsqr(f, 6)
    monkeypatch.setattr(F, "GATHER", 6 * 6 * 8 * 2)
    got = F.tsqr(f, 6)
    assert np.abs(got.r - want.r).max() < 1e-10 and np.abs(got.xty - want.xty).max() < 1e-9


def test_fewer_rows_than_features(spark):
    x, y, w, c, e = arrays(1, 3, 6)
    got = F.tsqr(frame(spark, x, y, w, c, e), 6)
    assert got.r.shape == (6, 6)
    assert np.abs(got.r.T @ got.r - (x * w[:, None]).T @ (x * w[:, None])).max() < 1e-10
    beta = F.solve(frame(spark, x, y, w, c, e))
    assert np.abs((x @ beta - y) * w).max() < 1e-8


def test_solve_uses_squared_weights(spark):
    x, y, w, c, e = arrays(100, 5, 5, noise=1.0)
    f = frame(spark, x, y, w, c, e)
    for method in ("auto", "qr", "lstsq"):
        assert np.abs(F.solve(f, method=method) - fit(x, y, w)).max() < 1e-10
    with pytest.raises(ValueError):
        F.solve(f, method="cholesky")


def test_gram_equals_tsqr(spark):
    x, y, w, c, e = arrays(50, 5, 3)
    f = frame(spark, x, y, w, c, e)
    g, r = F.gram(f, 3).first().asDict(), F.tsqr(f, 3)
    a = r.r.T @ r.r
    assert all(abs(g[f"g_{i}{j}"] - a[i, j]) < 1e-8 for i in range(3) for j in range(i, 3))


def test_inverse_woodbury_and_append():
    x, y, w, _, _ = arrays(200, 5, 8)
    x, y = x * w[:, None], y * w
    first = F.Factor(F.fold([x[:800]], 8), x[:800].T @ y[:800])
    want = np.linalg.inv(x.T @ x)
    assert np.abs(first.inverse() - np.linalg.inv(x[:800].T @ x[:800])).max() < 1e-8
    inv, xty = F.woodbury(first.inverse(), first.xty, x[800:], y[800:])
    assert np.abs(inv - want).max() < 1e-6 and np.abs(xty - x.T @ y).max() < 1e-8
    back, bxty = F.woodbury(inv, xty, x[800:], y[800:], add=False)
    assert np.abs(back - first.inverse()).max() < 1e-6 and np.abs(bxty - first.xty).max() < 1e-8
    assert np.abs(first.append(x[800:], y[800:]).inverse() - want).max() < 1e-8


def test_svd_leaves_out_a_duplicate_column():
    x, y, w, _, _ = arrays(50, 5, 4)
    x = np.column_stack([x, x[:, 1]])
    f = F.Factor(F.fold([x], 5), x.T @ y)
    inv, s, _ = f.svd(len(x))
    assert np.abs(inv - np.linalg.pinv(x.T @ x)).max() < 1e-8 and (s[:-1] > 1).all()
    m = f.whitener(rank_filtered=True)
    assert abs(((x @ m.T) ** 2).sum() - 4) < 1e-8

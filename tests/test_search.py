"""Stepwise search at many steps: the same steps as scoring everything, with far fewer scores."""

import numpy as np
import pytest

from gleaner.operators import greedy

from .data import arrays, frame

#: The registered queries, by direction, kind of score, update and factorization.
WAYS = {
    "stepwise_desc_block_svd": (False, True, "auto", True),
    "stepwise_desc_block": (False, True, "auto", False),
    "stepwise_asc_block": (True, True, "auto", False),
    "stepwise_asc_block_woodbury": (True, True, "woodbury", False),
    "stepwise_asc_block_leverage_start": (True, True, "auto", False),
    "stepwise_asc_energy": (True, False, "auto", False),
    "stepwise_asc_energy_qr": (True, False, "qr", False),
}


def plain_steps(found, chosen, n, block, add):
    """Every candidate scored in every step, A and b summed up anew."""
    chosen, steps = np.isin(found.ids, list(chosen)), []
    x, y = found.pools[False].x, found.pools[False].y
    for _ in range(n):
        a, b = found.g[chosen].sum(axis=0), found.v[chosen].sum(axis=0)
        inverse = np.linalg.inv(a)
        beta = inverse @ b
        if block:
            q = found.g @ beta - found.v
            scores = np.einsum("ni,ni->n", q, np.linalg.solve(a + found.g if add else a - found.g, q[..., None])[..., 0])
        else:
            h = np.einsum("ni,ij,nj->n", x, inverse, x)
            scores = (x @ beta - y) ** 2 * h / (1 + h)
        scores = np.where(chosen == add, -np.inf if add else np.inf, scores)
        k = int(np.argmax(scores) if add else np.argmin(scores))
        chosen[k] = add
        steps.append(int(found.ids[k]))
    return steps


@pytest.mark.parametrize("name", WAYS)
def test_steps_score_few_candidates(spark, monkeypatch, name):
    add, block, method, svd = WAYS[name]
    f = frame(spark, *arrays(1200, 3, 3, seed=5, noise=0.7))
    found = greedy.candidates(f, 3)
    start, n, scored = set(range(120 if add else 600)), 150, []
    function = "block_scores" if block else "energy_scores"
    real = getattr(greedy, function)
    monkeypatch.setattr(greedy, function, lambda g, *more: scored.append(len(g)) or real(g, *more))
    monkeypatch.setattr(greedy, "FEW", 16, raising=False)
    k = len(start) + (n if add else -n)
    steps = greedy.stepwise(f, k, start, block, add, True, found, method, svd).steps
    # everything in every step would be over 75,000 scores
    assert len(steps) == n and sum(scored) < 40_000
    assert [i for _, i, _ in steps] == plain_steps(found, start, n, block, add)


@pytest.mark.parametrize("add", [True, False])
@pytest.mark.parametrize("block", [True, False])
def test_search_on_executors_scans_seldom(spark, monkeypatch, add, block):
    monkeypatch.setattr(greedy, "FEW", 8)
    monkeypatch.setattr(greedy.Spread, "few", 40)
    scans, real = [], greedy.Spread.scan
    monkeypatch.setattr(greedy.Spread, "scan", lambda *a: scans.append(1) or real(*a))
    f = frame(spark, *arrays(300, 3, 3, seed=6, noise=0.7))
    start = set(range(60 if add else 200))
    found = greedy.candidates(f, 3, 0)
    steps = greedy.stepwise(f, len(start) + (40 if add else -40), start, block, add, found=found).steps
    assert [i for _, i, _ in steps] == plain_steps(greedy.candidates(f, 3), start, 40, block, add)
    assert len(scans) <= 12
    found.release()


def test_copies_and_singular_matrices_go_by_id(spark, monkeypatch):
    """Equal candidates by the dozen are taken by id; where A is singular every step scores all, as svd lets it."""
    monkeypatch.setattr(greedy, "FEW", 4)
    monkeypatch.setattr(greedy.Local, "few", 4)
    x, y, w, c, e = arrays(20, 3, 3, seed=7)
    x, y = np.round(x, 1), np.round(y, 1)
    many = frame(spark, np.tile(x, (12, 1)), np.tile(y, 12), np.ones(12 * len(y)), np.concatenate([c + 20 * i for i in range(12)]), np.tile(e, 12))
    found = greedy.candidates(many, 3)
    found.g, found.v = (np.tile(z[:20], (12,) + (1,) * (z.ndim - 1)) for z in (found.g, found.v))
    found.pools[True] = greedy.Blocks(found.ids, found.g, found.v)
    steps = [i for _, i, _ in greedy.stepwise(many, 120, set(range(20)), True, True, found=found).steps]
    assert len(steps) == 100
    for one in range(20):
        own = [i for i in steps if i % 20 == one]
        assert own == sorted(own)
    twice = frame(spark, np.column_stack([x, x[:, 1]]), y, w, c, e)
    assert len(greedy.stepwise(twice, 12, set(range(6)), True, True, svd=True).steps) == 6

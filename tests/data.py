"""Seeded regression data as numpy arrays and as an observation frame."""

import numpy as np
import pandas as pd

from gleaner.operators.frame import COLUMNS


def arrays(configs=30, block=5, p=4, seed=0, noise=0.1, first=True, ids=None):
    rng = np.random.default_rng(seed)
    n = configs * block
    x = np.column_stack([np.ones(n), rng.standard_normal((n, p - 1))])
    y = x @ rng.standard_normal(p) + noise * rng.standard_normal(n)
    w = rng.uniform(0.5, 2, n)
    config = np.repeat(np.arange(configs) if ids is None else ids, block)
    energy = np.arange(n) % block == (0 if first else block - 1)
    return x, y, w, config, energy


def frame(spark, x, y, w, config, energy):
    pdf = pd.DataFrame({"row_id": np.arange(len(y)), "config_id": config, "is_energy": energy, "y": y, "w": w, "features": x.astype(float).tolist()})
    return spark.createDataFrame(pdf, "row_id long, config_id long, is_energy boolean, y double, w double, features array<double>").select(COLUMNS)


def fit(x, y, w):
    return np.linalg.lstsq(x * w[:, None], y * w, rcond=None)[0]

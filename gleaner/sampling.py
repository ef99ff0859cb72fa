"""Split, choose, fit, measure: the library's workflow over one observation frame."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .functions.draws import half_even
from .operators import evaluate, greedy, score
from .operators.factor import Factor, solve, tsqr
from .operators.frame import config_ids, members, others, width

Selector = Callable[[DataFrame, int, int], DataFrame]


def id_set(ids: DataFrame) -> set[int]:
    return set(ids.select("config_id").toArrow().column(0).to_pylist())


class Study:
    """A frame split by configuration; fits and errors of the whole training part.

    The frame is computed once and kept in the cache (memory, then disk) until ``release``, as every step reads it;
    ``keep=False`` leaves that to the caller. ``features`` is the number of features, intercept included; counted if not given.
    """

    def __init__(self, frame: DataFrame, test_fraction: float = 0.0, seed: int = 0, test_ids: DataFrame | None = None, keep: bool = True, features: int | None = None):
        self.frame, self.seed = frame.persist() if keep else frame, seed
        self._kept, self._width = keep, features
        self._ids: DataFrame | None = None
        self.coefficients: np.ndarray | None = None
        self._factor: Factor | None = None
        self.split(test_fraction, seed, test_ids)

    def split(self, test_fraction: float = 0.0, seed: int = 0, test_ids: DataFrame | None = None) -> "Study":
        """floor(n f) configurations are for testing, the same for one seed under any partitioning; given ids win."""
        if not 0 <= test_fraction < 1:
            raise ValueError(f"test fraction must be in [0, 1), not {test_fraction}")
        if self._ids is None:
            self._ids = config_ids(self.frame).persist() if self._kept else config_ids(self.frame)
        self._n_train = None
        if test_ids is not None:
            self.test_ids = test_ids.select("config_id").distinct()
        else:
            n = self._ids.count()
            # drawn once: every later plan only joins the ids
            self.test_ids = score.uniform_draw(self._ids, int(n * test_fraction), seed, score.SPLIT, n).cache()
            self._n_train = n - int(n * test_fraction)
        self.train, self.test = others(self.frame, self.test_ids), members(self.frame, self.test_ids)
        self.train_ids = others(self._ids, self.test_ids)
        self._factor = None
        return self

    @property
    def n_train(self) -> int:
        """The number of training configurations."""
        if self._n_train is None:
            self._n_train = self.train_ids.count()
        return self._n_train

    @property
    def p(self) -> int:
        if self._width is None:
            self._width = width(self.frame)
        return self._width

    def release(self) -> None:
        """Give the cached frame back."""
        if self._kept:
            self.frame.unpersist()
            self._ids.unpersist()

    def factor(self) -> Factor:
        """R and X'y of the training rows, computed once per split."""
        if self._factor is None:
            self._factor = tsqr(self.train, self.p)
        return self._factor

    def fit(self, method: str = "auto") -> np.ndarray:
        self.coefficients = solve(self.train, self.p, method)
        return self.coefficients

    def errors(self) -> DataFrame:
        if self.coefficients is None:
            raise ValueError("the model has not been fitted")
        return evaluate.errors_4way(self.train, self.test, self.coefficients)


class Sampler(Study):
    """Uniform choice of training configurations, or by a selector (train frame, k, seed) -> config ids."""

    def __init__(self, *args, selector: Selector | None = None, **kwargs):
        self.selector = selector
        self.chosen: DataFrame | None = None
        self.sub_coefficients: np.ndarray | None = None
        self._scores: DataFrame | None = None
        super().__init__(*args, **kwargs)

    def select(self, k: int, seed: int) -> DataFrame:
        if self.selector is not None:
            return self.selector(self.train, k, seed)
        return score.uniform_draw(self.train_ids, k, seed, total=self.n_train)

    def choose(self, fraction: float, seed: int | None = None) -> DataFrame:
        """Choose round(n f) training configurations, halves to even; returns their ids."""
        if not 0 < fraction <= 1:
            raise ValueError(f"fraction must be in (0, 1], not {fraction}")
        self.seed = self.seed if seed is None else seed
        before, self.chosen = self.chosen, self.select(half_even(self.n_train * fraction), self.seed).cache()
        if before is not None:
            before.unpersist()
        return self.chosen

    def _scored(self, compute: Callable[[], DataFrame]) -> DataFrame:
        if self._scores is None:
            self._scores = compute().persist()
        return self._scores

    def split(self, *args, **kwargs) -> "Study":
        self._drop_scores()
        return super().split(*args, **kwargs)

    def _drop_scores(self) -> None:
        if self._scores is not None:
            self._scores.unpersist()
        self._scores = None

    def release(self) -> None:
        self.reset()
        self._drop_scores()
        super().release()

    def reset(self) -> None:
        if self.chosen is not None:
            self.chosen.unpersist()
        self.chosen = self.sub_coefficients = None

    def chosen_rows(self) -> DataFrame:
        if self.chosen is None:
            raise ValueError("nothing has been chosen")
        return members(self.train, self.chosen)

    def fit_chosen(self, method: str = "auto") -> np.ndarray:
        self.sub_coefficients = solve(self.chosen_rows(), self.p, method)
        return self.sub_coefficients

    def chosen_errors(self) -> DataFrame:
        if self.sub_coefficients is None or self.chosen is None:
            raise ValueError("the model has not been fitted")
        return evaluate.errors_6way(self.train, self.test, self.chosen, self.sub_coefficients)

    descending = False

    def curve(self, fractions: float | Sequence[float], repeats: int | Sequence[int] = 1, seed: int = 0, same_seed: bool = False) -> DataFrame:
        """Errors over fractions and repeats, as a long table; repeats differ in seed unless told otherwise."""

        def run(repeat: int, fraction: float) -> DataFrame:
            if run.last != repeat:
                self.reset()
                run.last = repeat
            self.choose(fraction, seed if same_seed else seed + repeat)
            self.fit_chosen()
            return self.chosen_errors()

        run.last = -1
        return evaluate.curve(self.frame.sparkSession, run, evaluate.schedule(fractions, repeats), self.descending)


class LeverageSampler(Sampler):
    """Choice in proportion to leverage: of a configuration's energy row, or summed over its rows (block)."""

    def __init__(self, *args, block: bool = False, factorization: str = "auto", **kwargs):
        if factorization not in ("auto", "qr", "svd"):
            raise ValueError(f"factorization must be auto, qr or svd, not {factorization!r}")
        self.block, self.svd = block, factorization == "svd"
        super().__init__(*args, **kwargs)

    def scores(self) -> DataFrame:
        """(config_id, score), computed once per split."""
        return self._scored(lambda: score.config_leverage(self.train, self.block, self.factor(), self.svd))

    def select(self, k: int, seed: int) -> DataFrame:
        return score.weighted_draw(self.scores(), k, seed)


class CooksSampler(Sampler):
    """Choice by Cook's distance: at once, by draw or from the top, or stepwise by adding or removing configurations."""

    def __init__(
        self,
        *args,
        block: bool = False,
        stepwise: bool = False,
        sampling: bool = True,
        ascending: bool = True,
        initial: str = "random",
        initial_fraction: float = 1.0,
        factorization: str = "auto",
        update_method: str = "auto",
        strict: bool = True,
        **kwargs,
    ):
        if block and not stepwise:
            raise NotImplementedError("one-step Cook's distance of blocks")
        if initial not in ("random", "leverage"):
            raise ValueError(f"initial choice must be random or leverage, not {initial!r}")
        if factorization not in ("auto", "qr", "svd"):
            raise ValueError(f"factorization must be auto, qr or svd, not {factorization!r}")
        self.update = greedy.update_policy(update_method, ascending, block, factorization != "svd") if stepwise else None
        self.block, self.stepwise, self.sampling, self.ascending = block, stepwise, sampling, ascending
        self.initial, self.initial_fraction, self.svd, self.strict = initial, initial_fraction, factorization == "svd", strict
        self.descending = stepwise and not ascending
        self._found: greedy.Local | greedy.Spread | None = None
        super().__init__(*args, **kwargs)

    def split(self, *args, **kwargs) -> "Study":
        self._let_go()
        return super().split(*args, **kwargs)

    def _let_go(self) -> None:
        if self._found is not None:
            self._found.release()
        self._found = None

    def release(self) -> None:
        self._let_go()
        super().release()

    def scores(self) -> DataFrame:
        """(row_id, config_id, score) of energy rows, computed once per split."""
        return self._scored(lambda: score.cooks_onestep(self.train, self.factor(), self.svd))

    def start(self, seed: int) -> set[int]:
        k = half_even(self.n_train * self.initial_fraction)
        if self.initial == "random":
            ids = score.uniform_draw(self.train_ids, k, seed, total=self.n_train)
        else:
            ids = score.weighted_draw(score.config_leverage(self.train, self.block, self.factor()), k, seed)
        return id_set(ids)

    def select(self, k: int, seed: int) -> DataFrame:
        if not self.stepwise:
            scores = score.one_a_config(self.scores())
            return score.weighted_draw(scores, k, seed) if self.sampling else score.top(scores, k)
        if self._found is None:
            self._found = greedy.candidates(self.train, self.p)
        before = id_set(self.chosen) if self.chosen is not None else self.start(seed)
        self.state = greedy.stepwise(self.train, k, before, self.block, self.ascending, self.strict, self._found, self.update, self.svd)
        return self.frame.sparkSession.createDataFrame(pa.table({"config_id": np.sort(np.fromiter(self.state.chosen, np.int64))}))


__all__ = ["CooksSampler", "LeverageSampler", "Sampler", "Study"]

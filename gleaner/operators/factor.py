"""Tall-skinny QR, weighted least squares and the small updates that follow from them.

Rows are read once: each task folds its batches into one p x p triangle and one moment vector; triangles are folded
further in groups while there are many, and the last ones on the driver. Only p x p matrices reach it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of triangles that the driver may gather; beyond, they are folded in groups first.
GATHER = 64 << 20
FOLD = 16


def positive(r: np.ndarray) -> np.ndarray:
    """The triangle with a diagonal of no negative entries: the one QR that does not depend on row order."""
    sign = np.where(np.diag(r) < 0, -1.0, 1.0)
    return r * sign[:, None]


def fold(blocks: list[np.ndarray], p: int) -> np.ndarray:
    """The triangle of stacked blocks, padded to p rows."""
    stacked = np.vstack(blocks) if blocks else np.zeros((0, p))
    r = np.linalg.qr(stacked, mode="r") if len(stacked) else stacked
    if len(r) < p:
        r = np.vstack([r, np.zeros((p - len(r), p))])
    return positive(r)


def stacked(column: pa.Array, p: int) -> np.ndarray:
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    if len(values) != len(column) * p:
        raise ValueError(f"rows do not all have {p} features")
    return values.reshape(-1, p)


def _partials(p: int, with_moments: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, xty = np.zeros((0, p)), np.zeros(p)
        for b in batches:
            if not b.num_rows:
                continue
            x = stacked(b.column("features"), p) * b.column("w").to_numpy()[:, None]
            if with_moments:
                xty += x.T @ (b.column("y").to_numpy(zero_copy_only=False) * b.column("w").to_numpy())
            r = np.linalg.qr(np.vstack([r, x]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_pydict({"r": [r.ravel()], "xty": [xty]}, pa.schema([("r", pa.list_(pa.float64())), ("xty", pa.list_(pa.float64()))]))

    return run


def _folded(p: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, xty = np.zeros((0, p)), np.zeros(p)
        for b in batches:
            for one, moments in zip(b.column("r").to_pylist(), b.column("xty").to_pylist()):
                r = np.linalg.qr(np.vstack([r, np.array(one).reshape(-1, p)]), mode="r")
                xty += np.array(moments)
        if len(r):
            yield pa.RecordBatch.from_pydict({"r": [r.ravel()], "xty": [xty]}, pa.schema([("r", pa.list_(pa.float64())), ("xty", pa.list_(pa.float64()))]))

    return run


@dataclass
class Factor:
    """R of the weighted rows, and X'y of weighted rows and targets."""

    r: np.ndarray
    xty: np.ndarray

    @property
    def p(self) -> int:
        return len(self.r)

    def coefficients(self) -> np.ndarray:
        return np.linalg.solve(self.r, np.linalg.solve(self.r.T, self.xty))

    def inverse(self) -> np.ndarray:
        """Of the normal matrix, from R."""
        back = np.linalg.solve(self.r, np.eye(self.p))
        return back @ back.T

    def svd(self, rows: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pseudo-inverse of the normal matrix, singular values, V'), small singular values left out."""
        _, s, vt = np.linalg.svd(self.r)
        keep = s > np.finfo(float).eps * max(rows or self.p, self.p) * (s[0] if len(s) else 0)
        inv = (vt[keep].T / s[keep] ** 2) @ vt[keep]
        return inv, s, vt

    def whitener(self, rank_filtered: bool = False, rows: int | None = None) -> np.ndarray:
        """A matrix whose product with a weighted row has the row's leverage as squared norm."""
        if rank_filtered:
            _, s, vt = self.svd(rows)
            keep = s > np.finfo(float).eps * max(rows or self.p, self.p) * s[0]
            return vt[keep] / s[keep][:, None]
        return np.linalg.inv(self.r).T

    def append(self, x: np.ndarray, y: np.ndarray) -> "Factor":
        """With further (weighted) rows."""
        return Factor(fold([self.r, x], self.p), self.xty + x.T @ y)


def root(g: np.ndarray) -> np.ndarray:
    """Rows whose product X'X is a given sum of such products: as many as its rank, however many rows it was summed from."""
    w, v = np.linalg.eigh(g)
    some = w > np.finfo(float).eps * len(g) * max(w[-1], 0.0)
    return np.sqrt(w[some])[:, None] * v[:, some].T


def tsqr(frame: DataFrame, p: int, moments: bool = True, gather: int | None = None) -> Factor:
    """R and X'y of a frame's weighted rows in one pass; at most ``gather`` bytes of triangles reach the driver."""
    gather = GATHER if gather is None else gather
    cols = ["features", "w"] + (["y"] if moments else [])
    parts = frame.select(*cols).mapInArrow(_partials(p, moments), "r array<double>, xty array<double>")
    tasks = parts.rdd.getNumPartitions() if p * p * 8 * 1000 > gather else 1
    while tasks > 1 and tasks * p * p * 8 > gather:
        tasks = -(-tasks // FOLD)
        parts = parts.repartition(tasks).mapInArrow(_folded(p), "r array<double>, xty array<double>")
    rows = parts.collect()
    xty = np.zeros(p)
    for r in rows:
        xty += np.array(r["xty"])
    return Factor(fold([np.array(r["r"]).reshape(-1, p) for r in rows], p), xty)


def gram(frame: DataFrame, p: int) -> DataFrame:
    """X'W^2X and X'W^2y as one row of sums (g_ij for i <= j, v_i): for few features, entirely in the JVM."""
    return frame.agg(*gram_columns(p))


def gram_columns(p: int) -> list:
    x = [F.get(F.col("features"), F.lit(i)) for i in range(p)]
    w2 = F.col("w") * F.col("w")
    sums = [F.sum(w2 * x[i] * x[j]).alias(f"g_{i}{j}") for i in range(p) for j in range(i, p)]
    return sums + [F.sum(w2 * x[i] * F.col("y")).alias(f"v_{i}") for i in range(p)]


def solve(frame: DataFrame, p: int | None = None, method: str = "auto") -> np.ndarray:
    """Weighted least squares; every method goes through R, so that no row count matters."""
    if method not in ("auto", "qr", "lstsq"):
        raise ValueError(f"method must be auto, qr or lstsq, not {method!r}")
    if p is None:
        first = frame.select(F.size("features")).first()
        if first is None:
            raise ValueError("no rows to fit")
        p = first[0]
    factor = tsqr(frame, p)
    if np.abs(np.diag(factor.r)).min() <= np.finfo(float).eps * p * np.abs(factor.r).max():
        return factor.svd()[0] @ factor.xty
    return factor.coefficients()


def woodbury(inverse: np.ndarray, xty: np.ndarray, x: np.ndarray, y: np.ndarray, add: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The inverse and X'y after rows come (or go): a rank-k update."""
    sign = 1.0 if add else -1.0
    part = inverse @ x.T
    core = np.eye(len(x)) + sign * (x @ part)
    return inverse - sign * part @ np.linalg.solve(core, part.T), xty + sign * x.T @ y

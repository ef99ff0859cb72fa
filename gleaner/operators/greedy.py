"""Stepwise selection by Cook's distance, one configuration at a time.

Each configuration is reduced once to G = X~'X~ and v = X~'y~. With A the normal matrix and b the moments of the rows chosen so
far, a configuration's block score is g' (A +- G)^-1 g with g = G beta - v, the same number as r' (I +- H)^-1 H r over its
rows; taking it moves A by G and b by v. Scores of energy rows need only those rows. What is left is a search of the best
among compressed candidates, which are on the driver while they fit there, on the executors otherwise.

A step does not score all of them. A scan keeps a few near the top, and for the others the root of the score and the most that
it can change while the coefficients move by d in the norm of A: |G d| in the norm of (A +- G)^-1 is at most h / sqrt(1 +- h) d
with h the trace of A^-1 G, and rows that come only shrink that norm, as rows that go only widen it. Steps choose among the few,
exactly, until the others' bound reaches the best of them; then all are scanned again. Where A is near singular every step scans.

A step's update follows the chosen method: rows that have G as their sum (``factor.root``) are appended to a triangle (qr) or
change the inverse by their rank (woodbury). With ``svd`` small singular values are left out of coefficients and scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .factor import Factor, fold, gram_columns, root, stacked, woodbury
from .frame import members, width

#: Bytes of compressed candidates that the driver may hold.
DRIVER = 256 << 20
#: Features up to which sums per configuration are plain aggregates.
PLAIN = 8
#: Steps after which the factor is made anew from A and b instead of updated.
REFRESH = 200
#: Candidates first kept in sight between two scans, on the driver and on the executors, and the bytes they may grow to.
FEW, FEW_SPREAD, FEW_BYTES = 256, 4096, 16 << 20
#: Growth of a score that has no bound.
UNBOUNDED = 1e150


def _packed(p: int):
    """Partial sums (config_id, g, v) per batch: a configuration of many rows is never gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids = part.column("config_id").to_numpy()
                w = part.column("w").to_numpy()[:, None]
                x = stacked(part.column("features"), p) * w
                y = part.column("y").to_numpy(zero_copy_only=False) * w[:, 0]
                order = np.argsort(ids, kind="stable")
                ids, x, y = ids[order], x[order], y[order]
                starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
                ends = np.r_[starts[1:], len(ids)]
                g = [(x[s:e].T @ x[s:e]).ravel() for s, e in zip(starts, ends)]
                v = [x[s:e].T @ y[s:e] for s, e in zip(starts, ends)]
                yield pa.RecordBatch.from_pydict({"config_id": ids[starts], "g": g, "v": v}, pa.schema([("config_id", pa.int64()), ("g", pa.list_(pa.float64())), ("v", pa.list_(pa.float64()))]))

    return run


def statistics(frame: DataFrame, p: int) -> DataFrame:
    """(config_id, g, v) with G as p^2 numbers by row."""
    if p <= PLAIN:
        sums = frame.groupBy("config_id").agg(*gram_columns(p))
        g = F.array(*[F.col(f"g_{min(i, j)}{max(i, j)}") for i in range(p) for j in range(p)])
        return sums.select("config_id", g.alias("g"), F.array(*[F.col(f"v_{i}") for i in range(p)]).alias("v"))
    parts = frame.select("config_id", "features", "w", "y").mapInArrow(_packed(p), "config_id long, g array<double>, v array<double>")
    flat = parts.select("config_id", F.posexplode(F.concat("g", "v")).alias("i", "x")).groupBy("config_id", "i").agg(F.sum("x").alias("x"))
    rows = flat.groupBy("config_id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("all"))
    values = F.transform("all", lambda s: s["x"])
    return rows.select("config_id", F.slice(values, 1, p * p).alias("g"), F.slice(values, p * p + 1, p).alias("v"))


def _along(columns: list[np.ndarray], weights) -> np.ndarray:
    """A sum of products, one element at a time: equal candidates get equal numbers wherever they stand."""
    total = columns[0] * weights[0]
    for c, w in zip(columns[1:], weights[1:]):
        total = total + c * w
    return total


def _forms(q: list[np.ndarray], m: np.ndarray, svd: bool) -> tuple[np.ndarray, np.ndarray]:
    """q' M^-1 q of many small matrices by LDL', and where that is sound (with ``svd``: and nothing would be left out)."""
    p = m.shape[1]
    low: list[list[np.ndarray]] = []
    d: list[np.ndarray] = []
    z: list[np.ndarray] = []
    total, sound = np.zeros(len(m)), np.ones(len(m), bool)
    for i in range(p):
        part: list[np.ndarray] = []  # l_ik d_k
        row: list[np.ndarray] = []
        for k in range(i):
            x = m[:, i, k]
            for j in range(k):
                x = x - part[j] * low[k][j]
            part.append(x)
            row.append(x / d[k])
        pivot, rest = m[:, i, i], q[i]
        for k in range(i):
            pivot, rest = pivot - part[k] * row[k], rest - row[k] * z[k]
        sound &= pivot > 1e-10 * m[:, i, i]
        low.append(row)
        d.append(pivot)
        z.append(rest)
        total = total + rest * rest / pivot
    if svd and p > 1:
        trace = np.trace(m, axis1=1, axis2=2)
        least = np.prod([x * (p - 1) / trace for x in d[1:]], axis=0) * d[0]
        sound &= least > 1e-9 * trace
    return total, sound


def block_scores(g: np.ndarray, v: np.ndarray, a: np.ndarray, beta: np.ndarray, add: bool, svd: bool = False) -> np.ndarray:
    """Scores of many configurations: g (n, p, p), v (n, p)."""
    m, p = a + g if add else a - g, len(a)
    if p > PLAIN:
        return _solved(g @ beta - v, m, svd)
    q = [_along([g[:, i, j] for j in range(p)], beta) - v[:, i] for i in range(p)]
    with np.errstate(all="ignore"):
        scores, sound = _forms(q, m, svd)
    if not sound.all():
        scores[~sound] = _solved(np.stack(q, axis=1)[~sound], m[~sound], svd)
    return scores


def _solved(q: np.ndarray, m: np.ndarray, svd: bool) -> np.ndarray:
    if svd:
        return np.einsum("ni,nij,nj->n", q, np.linalg.pinv(m, rcond=m.shape[1] * 1e-15, hermitian=True), q)
    return np.einsum("ni,ni->n", q, np.linalg.solve(m, q[..., None])[..., 0])


def _leverages(x: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    p = len(inverse)
    if p > PLAIN:
        return np.einsum("ni,ij,nj->n", x, inverse, x)
    columns = [x[:, i] for i in range(p)]
    return sum(c * _along(columns, inverse[i]) for i, c in enumerate(columns))


def energy_scores(x: np.ndarray, y: np.ndarray, inverse: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """e^2 h / (1 + h) of weighted rows, whether rows come or go."""
    h = _leverages(x, inverse)
    e = (x @ beta if len(beta) > PLAIN else _along([x[:, i] for i in range(len(beta))], beta)) - y
    return e * e * h / (1 + h)


@dataclass
class View:
    """What scores depend on at some step, without the factor: small enough to be sent to tasks."""

    a: np.ndarray
    beta: np.ndarray
    inverse: np.ndarray | None
    add: bool
    svd: bool
    #: The inverse of A as bounds use it, none where A is near singular.
    norm: np.ndarray | None = None
    #: Rounding of a bound, as a share.
    slack: float = 1e-9

    @classmethod
    def of(cls, state: State, add: bool, block: bool, bounds: bool) -> View:
        view = cls(state.a, state.beta(), None if block else state.inverse(), add, state.svd)
        if bounds:
            with np.errstate(all="ignore"):
                values, vectors = np.linalg.eigh(view.a)
                if values[0] > 1e-10 * values[-1] and np.isfinite(view.beta).all():
                    view.norm = (vectors / values) @ vectors.T
                    view.slack += 1e-14 * len(values) * values[-1] / values[0]
        return view

    def drift(self, now: View) -> float | None:
        """How far the coefficients have moved, rounding of scores included; none if bounds hold no longer."""
        if not self.add and np.sum(self.norm * (self.a - now.a)) > 0.4:
            return None
        length = lambda x: float(np.sqrt(max(x @ self.a @ x, 0.0)))
        return length(now.beta - self.beta) + 1e-12 * length(now.beta)


@dataclass
class Blocks:
    """Configurations, by id."""

    ids: np.ndarray
    g: np.ndarray
    v: np.ndarray

    def take(self, at: np.ndarray) -> Blocks:
        return Blocks(self.ids[at], self.g[at], self.v[at])

    def scores(self, view: View) -> np.ndarray:
        return block_scores(self.g, self.v, view.a, view.beta, view.add, view.svd)

    def growth(self, view: View) -> np.ndarray:
        h = np.maximum(self.g.reshape(len(self.g), -1) @ view.norm.ravel(), 0.0)
        if view.add:
            return h / np.sqrt(1 + h)
        return np.where(h < 0.5, h / np.sqrt(np.maximum(1 - h, 0.5)), UNBOUNDED)


@dataclass
class Rows:
    """Weighted energy rows, by configuration id."""

    ids: np.ndarray
    x: np.ndarray
    y: np.ndarray

    def take(self, at: np.ndarray) -> Rows:
        return Rows(self.ids[at], self.x[at], self.y[at])

    def scores(self, view: View) -> np.ndarray:
        return energy_scores(self.x, self.y, view.inverse, view.beta)

    def growth(self, view: View) -> np.ndarray:
        h = np.maximum(_leverages(self.x, view.norm), 0.0)
        return h / np.sqrt(1 + h)


def blocks(table: pa.Table | pa.RecordBatch, p: int) -> Blocks:
    ids = table.column("config_id").to_numpy()
    return Blocks(ids, _flat(table.column("g")).reshape(-1, p, p), _flat(table.column("v")).reshape(-1, p))


def energy_rows(table: pa.Table | pa.RecordBatch, p: int) -> Rows:
    w = _numbers(table.column("w"))
    return Rows(table.column("config_id").to_numpy(), _flat(table.column("features")).reshape(-1, p) * w[:, None], _numbers(table.column("y")) * w)


def _numbers(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.to_numpy(zero_copy_only=False), np.float64)


def _flat(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)


@dataclass
class Limit:
    """The most that (signed) roots of scores out of sight reach while coefficients drift: at 0, at ``far`` and beyond."""

    far: float
    near: float = -np.inf
    edge: float = -np.inf
    steep: float = 0.0

    def at(self, drift: float) -> float:
        if self.near == -np.inf:
            return -np.inf
        # a maximum of straight lines lies below its chord
        if drift <= self.far:
            return self.near + (self.edge - self.near) * (drift / self.far)
        return self.edge + self.steep * (drift - self.far)

    def with_(self, other: Limit) -> Limit:
        return Limit(self.far, max(self.near, other.near), max(self.edge, other.edge), max(self.steep, other.steep))


def signed_root(score, add: bool):
    root_ = np.sqrt(np.maximum(score, 0.0))
    return root_ if add else -root_


def shortlist(scores: np.ndarray, growth: np.ndarray, add: bool, many: int, far: float) -> tuple[np.ndarray, Limit]:
    """Where the ``many`` are whose scores may get best before ``far``, in order, and a limit for the others."""
    if many >= len(scores):
        return np.arange(len(scores)), Limit(far)
    start = signed_root(scores, add)
    end = start + growth * far
    order = np.argpartition(-end, many)
    rest = order[many:]
    return np.sort(order[:many]), Limit(far, float(start[rest].max()), float(end[rest].max()), float(growth[rest].max()))


@dataclass
class State:
    """What is chosen, its normal matrix and moments, and the factor by which they move."""

    a: np.ndarray
    b: np.ndarray
    chosen: set[int] = field(default_factory=set)
    steps: list[tuple[int, int, float]] = field(default_factory=list)
    method: str = "woodbury"
    svd: bool = False
    r: np.ndarray | None = None
    inv: np.ndarray | None = None
    #: What rounding has taken from a and b.
    lost: tuple = (0.0, 0.0)

    def __post_init__(self):
        self.anew(self.a, self.b)

    def anew(self, a: np.ndarray, b: np.ndarray) -> None:
        """From sums over all that is chosen."""
        self.a, self.b, self.inv, self.lost = a, b, None, (0.0, 0.0)
        self.r = fold([root(a)], len(a)) if self.method == "qr" else None
        if self.method == "woodbury" and not self.svd:
            self.inv = np.linalg.inv(a)

    def inverse(self) -> np.ndarray:
        if self.svd:
            r = self.r if self.r is not None else fold([root(self.a)], len(self.a))
            return Factor(r, self.b).svd()[0]
        return Factor(self.r, self.b).inverse() if self.r is not None else self.inv

    def beta(self) -> np.ndarray:
        if self.r is not None and not self.svd:
            return Factor(self.r, self.b).coefficients()
        return self.inverse() @ self.b

    def move(self, i: int, g: np.ndarray, v: np.ndarray, add: bool) -> None:
        """A configuration comes or goes."""
        self.chosen.add(i) if add else self.chosen.discard(i)
        x, sign = root(g), 1.0 if add else -1.0
        if self.r is not None:
            self.r = Factor(self.r, self.b).append(x, np.zeros(len(x))).r
        elif self.inv is not None:
            self.inv, _ = woodbury(self.inv, self.b, x, np.zeros(len(x)), add)
        (self.a, da), (self.b, db) = _sum(self.a, sign * g), _sum(self.b, sign * v)
        self.lost = self.lost[0] + da, self.lost[1] + db

    def settle(self) -> None:
        """The factor anew; A and b are as exact as if they were summed up anew, at any number of steps."""
        self.anew(self.a + self.lost[0], self.b + self.lost[1])


def _sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sum and its rounding error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


class Local:
    """Candidates in the driver's memory."""

    few = FEW

    def __init__(self, stats: pa.Table, energy: pa.Table, p: int):
        self.pools = {True: blocks(stats.sort_by("config_id"), p), False: energy_rows(energy.sort_by([("config_id", "ascending"), ("row_id", "ascending")]), p)}
        self.ids, self.g, self.v = self.pools[True].ids, self.pools[True].g, self.pools[True].v
        self.e_ids = self.pools[False].ids
        self._seen: tuple = (None, None, 0)

    def total(self, chosen: set[int]) -> tuple[np.ndarray, np.ndarray]:
        own = np.isin(self.ids, list(chosen))
        return self.g[own].sum(axis=0), self.v[own].sum(axis=0)

    def energy_rows(self, chosen: set[int]) -> int:
        return int(np.isin(self.e_ids, list(chosen)).sum())

    def release(self) -> None:
        self._seen = (None, None, 0)

    def size(self, block: bool) -> int:
        return len(self.pools[block].ids)

    def _inside(self, state: State, block: bool) -> np.ndarray:
        """Which candidates are chosen: counted once, then moved step by step."""
        owner, inside, steps = self._seen
        ids = self.pools[block].ids
        if owner is not state:
            inside, steps = np.isin(ids, list(state.chosen)), len(state.steps)
        for _, i, _ in state.steps[steps:]:
            inside[np.searchsorted(ids, i) : np.searchsorted(ids, i, "right")] = i in state.chosen
        self._seen = state, inside, len(state.steps)
        return inside

    def scan(self, state: State, view: View, block: bool, many: int, far: float) -> tuple[tuple[int, float], Blocks | Rows, Limit | None, Blocks] | None:
        """The best of all, and the few that are best from here on: (best, few, limit of the others, what they move)."""
        at = np.flatnonzero(self._inside(state, block) != view.add)
        if not len(at):
            return None
        pool = self.pools[block].take(at)
        scores = pool.scores(view)
        # the first of equal scores has the smallest id
        k = int(np.argmax(scores) if view.add else np.argmin(scores))
        best = int(pool.ids[k]), float(scores[k])
        if view.norm is None or np.isnan(scores).any():
            few, limit = np.array([k]), None
        else:
            few, limit = shortlist(scores, pool.growth(view), view.add, many, far)
        kept = pool.take(few)
        # the best is among what moves, whether it is among the few or not
        moved = np.searchsorted(self.ids, np.unique(np.append(kept.ids, best[0])))
        return best, kept, limit, self.pools[True].take(moved)


class Spread:
    """Candidates that stay on the executors, in the cache until ``release``.

    What was chosen at some step is a column of the cached tables; a step sends only what has changed since, and after
    REFRESH changes the column is made anew.
    """

    few = FEW_SPREAD

    def __init__(self, stats: DataFrame, energy: DataFrame, p: int, sizes: tuple[int, int]):
        self.plain, self.p, self.sizes = {"stats": stats, "energy": energy}, p, sizes
        self.base: set[int] | None = None
        self.tables: dict[str, DataFrame] = {}

    def release(self) -> None:
        for t in self.tables.values():
            t.unpersist()
        self.tables, self.base = {}, None

    def _table(self, name: str, chosen: set[int]) -> DataFrame:
        """The table with a column ``inside``: whether a configuration is among the chosen."""
        if self.base is None or len(self.base ^ chosen) > REFRESH:
            self.release()
            self.base = set(chosen)
            spark = self.plain["stats"].sparkSession
            ids = spark.createDataFrame([(i, True) for i in sorted(chosen)], "config_id long, base boolean")
            self.tables = {k: t.join(ids, "config_id", "left").withColumn("base", F.coalesce("base", F.lit(False))).persist() for k, t in self.plain.items()}
        flag = F.col("base")
        if more := sorted(chosen - self.base):
            flag = flag | F.col("config_id").isin(more)
        if gone := sorted(self.base - chosen):
            flag = flag & ~F.col("config_id").isin(gone)
        return self.tables[name].withColumn("inside", flag)

    def _in(self, name: str, chosen: set[int], inside: bool) -> DataFrame:
        table = self._table(name, chosen)
        return table.where("inside" if inside else "not inside")

    def total(self, chosen: set[int]) -> tuple[np.ndarray, np.ndarray]:
        p = self.p
        own = self._in("stats", chosen, True).select(F.concat("g", "v").alias("x"))
        sums = own.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
        flat = np.zeros(p * p + p)
        for r in sums:
            flat[r["i"]] = r["x"]
        return flat[: p * p].reshape(p, p), flat[p * p :]

    def energy_rows(self, chosen: set[int]) -> int:
        return self._in("energy", chosen, True).count()

    def size(self, block: bool) -> int:
        return self.sizes[not block]

    def scan(self, state: State, view: View, block: bool, many: int, far: float) -> tuple[tuple[int, float], Blocks | Rows, Limit | None, Blocks] | None:
        """As on the driver: each task sends its few and the limit of its others, then the few of all are fetched."""
        p, read = self.p, blocks if block else energy_rows
        frame = self._in("stats" if block else "energy", state.chosen, not view.add)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, scores, growth = [], [], []
            for b in batches:
                if b.num_rows:
                    pool = read(b, p)
                    ids.append(pool.ids)
                    scores.append(pool.scores(view))
                    growth.append(pool.growth(view) if view.norm is not None else np.zeros(len(pool.ids)))
            if not ids:
                return
            ids, scores, growth = np.concatenate(ids), np.concatenate(scores), np.concatenate(growth)
            own = np.lexsort((ids, -scores if view.add else scores))[:1]
            if view.norm is None or np.isnan(scores).any():
                few, limit = own[:0], Limit(far, np.nan, np.nan, np.nan)
            else:
                few, limit = shortlist(scores, growth, view.add, many, far)
            at = np.append(few, own)
            columns = [ids[at], scores[at], growth[at]] + [np.full(len(at), x) for x in (limit.near, limit.edge, limit.steep)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["config_id", "score", "growth", "near", "edge", "steep"])

        found = frame.mapInArrow(run, "config_id long, score double, growth double, near double, edge double, steep double").toArrow()
        if not found.num_rows:
            return None
        ids = found.column("config_id").to_numpy()
        scores, growth, near, edge, steep = (_numbers(found.column(c)) for c in ("score", "growth", "near", "edge", "steep"))
        k = np.lexsort((ids, -scores if view.add else scores))[0]
        best = int(ids[k]), float(scores[k])
        limit, keep = None, np.array([k])
        if not np.isnan(near).any():
            keep, limit = shortlist(scores, growth, view.add, many, far)
            limit = limit.with_(Limit(far, float(near.max()), float(edge.max()), float(steep.max())))
        wanted = np.unique(np.append(ids[keep], best[0]))
        spark = frame.sparkSession
        some = F.broadcast(spark.createDataFrame(pa.table({"config_id": wanted})))
        moved = blocks(members(self.tables["stats"], some).select("config_id", "g", "v").toArrow().sort_by("config_id"), p)
        if block:
            return best, moved, limit, moved
        rows = members(self.tables["energy"], some).select("row_id", "config_id", "features", "w", "y").toArrow()
        return best, energy_rows(rows.sort_by([("config_id", "ascending"), ("row_id", "ascending")]), p), limit, moved


def candidates(frame: DataFrame, p: int, limit: int = DRIVER) -> Local | Spread:
    stats = statistics(frame, p)
    energy = frame.where("is_energy").select("row_id", "config_id", "features", "w", "y")
    sizes = frame.select("config_id").distinct().count(), energy.count()
    if sum(sizes) * (p * p + p) * 8 <= limit:
        return Local(stats.toArrow(), energy.toArrow(), p)
    return Spread(stats, energy, p, sizes)


class Search:
    """The best candidate of each step, by scans of all with many steps between them."""

    def __init__(self, found: Local | Spread, add: bool, block: bool):
        self.found, self.add, self.block = found, add, block
        self.many, self.far, self.scans, self.steps = found.few, 0.0, 0, 0
        self.start: View | None = None
        self.few: Blocks | Rows | None = None
        self.limit: Limit | None = None
        self.moved: Blocks | None = None
        self.alive: np.ndarray | None = None

    def best(self, state: State) -> tuple[int, float] | None:
        if self.limit is not None:
            if (found := self._among(state)) is not None:
                return found
            self._adapt(len(state.a))
        return self._anew(state)

    def sums(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """G and v of the one that was found best."""
        k = int(np.searchsorted(self.moved.ids, i))
        return self.moved.g[k], self.moved.v[k]

    def _taken(self, i: int) -> None:
        self.alive[np.searchsorted(self.few.ids, i) : np.searchsorted(self.few.ids, i, "right")] = False
        self.steps += 1

    def _among(self, state: State) -> tuple[int, float] | None:
        view = View.of(state, self.add, self.block, False)
        if (drift := self.start.drift(view)) is None:
            return None
        scores = np.where(self.alive, self.few.scores(view), -np.inf if self.add else np.inf)
        k = int(np.argmax(scores) if self.add else np.argmin(scores))
        if not self.alive[k] or np.isnan(scores[k]):
            return None
        mine, others = float(signed_root(scores[k], self.add)), self.limit.at(drift)
        if others > -np.inf and mine <= others + self.start.slack * (abs(mine) + abs(others)):
            self.reached = drift
            return None
        self._taken(i := int(self.few.ids[k]))
        return i, float(scores[k])

    def _adapt(self, p: int) -> None:
        """As much is scored in steps as in scans; the limit is sharp where the last few were used up."""
        self.far = getattr(self, "reached", 0.0)
        work, size = self.steps * self.many, self.found.size(self.block)
        if work < size:
            self.many *= 2
        elif work > 4 * size:
            self.many //= 2
        self.many = max(FEW, min(self.many, FEW_BYTES // (8 * (p * p + p))))

    def _anew(self, state: State) -> tuple[int, float] | None:
        self.start = View.of(state, self.add, self.block, True)
        found = self.found.scan(state, self.start, self.block, self.many, max(self.far, 1e-30))
        self.scans += 1
        if found is None:
            self.limit = None
            return None
        best, self.few, self.limit, self.moved = found
        self.alive, self.steps = np.ones(len(self.few.ids), bool), 0
        self._taken(best[0])
        return best


def stepwise(
    frame: DataFrame,
    k: int,
    initial: set[int],
    block: bool,
    ascending: bool = True,
    strict: bool = True,
    found: Local | Spread | None = None,
    method: str = "auto",
    svd: bool = False,
) -> State:
    """Add (ascending) or remove configurations until k energy rows are chosen.

    With ``strict`` a start that is past k already raises; without, it is returned as it is.
    """
    found = found or candidates(frame, width(frame))
    a, b = found.total(initial)
    state = State(a, b, set(initial), method=update_policy(method, ascending, block, not svd), svd=svd)
    n = found.energy_rows(state.chosen)
    if strict and (n > k if ascending else n < k):
        raise ValueError(f"{n} chosen at the start, {k} wanted: no step in this direction leads there")
    search = Search(found, ascending, block)
    for _ in range(n, k, 1 if ascending else -1):
        best = search.best(state)
        if best is None:
            break
        i, score = best
        state.move(i, *search.sums(i), ascending)
        state.steps.append((len(state.steps) + 1, i, score))
        if len(state.steps) % REFRESH == 0:
            state.settle()
    return state


def update_policy(method: str, ascending: bool, block: bool, has_r: bool) -> str:
    """Which update a step uses: rows can only be appended to a QR, never removed from it."""
    if method not in ("auto", "qr", "woodbury"):
        raise ValueError(f"update method must be auto, qr or woodbury, not {method!r}")
    if method == "qr" and not ascending:
        raise ValueError("a QR factor can't lose rows: use woodbury when descending")
    if method == "qr" and not has_r:
        raise ValueError("update by QR needs an R factor")
    if method == "auto":
        return "qr" if ascending and block and has_r else "woodbury"
    return method

"""Near-duplicate vectors by randomised-rotation binary codes with stored correction factors.

Vectors are compared only under equal labels. Each is normalised and rotated by a seeded random rotation; the signs
are its binary code, and the inner product of code and vector is its correction factor. The estimate of an inner
product is the code's product with the other vector, rounded to 8 bits a component, divided by the factor; it is unbiased
but for the rounding, with an error bound that follows from the factor alone. A pair whose estimate plus EPSILON times that
error and all that rounding can do stays below the threshold is dropped, every other pair is recomputed in double
precision, and only that decides.

Pairs meet in tables keyed by short pieces of further sign codes. The number of tables follows from the length of the
keys, so that a pair at the threshold misses all of them with a chance of at most MISS; the closer, the rarer. Only codes,
factors and rounded vectors are dealt to the tables; a second pass fetches the vectors of those that have a pair left in
a group. A pair counts in the first table in which it meets, so each is decided once and no list of pairs ever leaves a
task. With ``miss=0`` there is one table without a key and nothing is dropped unseen: all pairs of a label, exactly.

* Null vectors, vectors with null or non-finite components, zero and empty vectors and rows without a label link with
  nothing; each is its own component.
* Equal vectors are one class: compared once, counted as many times as they occur. Vectors of different lengths never link.
* Null ids are allowed; a component's id is its smallest non-null id. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keep, pick
from .components import components
from .simhash import forest

COSINE, SEED = 0.98, 11
#: Standard errors that an estimate may be off before a pair is dropped unseen, and the chance to miss a pair's tables.
EPSILON, MISS = 5.0, 1e-3
#: Aimed size of a table's group, rows compared at once, and the size beyond which a group is dealt out in blocks.
GROUP, BLOCK, CELL = 64, 512, 4096


@lru_cache(maxsize=64)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random rotation: the orthogonal factor of a Gaussian matrix with its signs fixed."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def plan(largest: int, cosine: float, miss: float = MISS) -> tuple[int, int]:
    """(bits of a key, tables) for the rows of the largest label."""
    if not miss:
        return 0, 1
    bits = min(30, max(4, math.ceil(math.log2(max(largest, 1) / GROUP)))) if largest > GROUP else 4
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - meet))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of norm one; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def table_keys(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The key of each unit vector in each table: consecutive signs under as many rotations as that takes."""
    if not bits:
        return np.zeros((len(x), tables), np.int32)
    dim = x.shape[1]
    turns = math.ceil(bits * tables / dim)
    signs = np.concatenate([x @ rotation(dim, SEED + 1 + k).T > 0 for k in range(turns)], axis=1)[:, : bits * tables]
    return (signs.reshape(len(x), tables, bits) << np.arange(bits)).sum(axis=2).astype(np.int32)


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sign codes, correction factors, rounded components, their unit) of unit vectors."""
    dim = x.shape[1]
    turned = x @ rotation(dim, SEED).T
    step = np.abs(turned).max(axis=1) / 127
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(dim), np.rint(turned / step[:, None]).astype(np.int8), step


def _coded(bits: int, tables: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            dims = b["vec"].map(len).to_numpy()
            for dim in np.unique(dims):
                own = b[dims == dim]
                raw = np.stack(own["vec"].to_numpy()).astype(np.float64)
                x = unit(raw)
                keys = table_keys(x, bits, tables)
                code, factor, rough, step = codes(x)
                as_bytes = lambda rows: [r.tobytes() for r in rows]
                same = {c: own[c].to_numpy() for c in ("label", "cid", "n")}
                yield pd.DataFrame({**same, "raw": as_bytes(raw), "code": as_bytes(code), "factor": factor, "rough": as_bytes(rough), "step": step, "all_keys": as_bytes(keys), "ks": list(keys), "dim": int(dim)})

    return run


def estimated(code: np.ndarray, factor: np.ndarray, rough: np.ndarray, step: np.ndarray, rows: slice, cols: slice, cosine: float, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of two runs of rows that may reach the cosine."""
    dim = rough.shape[1]
    bar = (np.unpackbits(code[rows], axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(dim))
    estimate = (bar @ rough[cols].astype(np.float32).T) * step[cols] / factor[rows, None]
    error = np.sqrt(np.maximum(0, 1 - factor[rows] ** 2)) / factor[rows] / math.sqrt(max(dim - 1, 1)) if dim > 1 else np.full(len(bar), 2.0)
    # rounding moves each component by half a unit at most
    most = estimate + epsilon * error[:, None] + math.sqrt(dim) * step[cols] / 2 / factor[rows, None]
    i, j = np.nonzero(most >= cosine - 1e-5)
    i, j = i + rows.start, j + cols.start
    ok = i < j
    return i[ok], j[ok]


def reached(raw: np.ndarray, i: np.ndarray, j: np.ndarray, cosine: float) -> np.ndarray:
    """Whether the pairs' cosines, in double precision, reach the threshold."""
    far = [np.empty(0, bool)]
    for at in range(0, len(i), 1 << 15):
        s = slice(at, at + (1 << 15))
        a, b = raw[i[s]], raw[j[s]]
        a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
        dot = np.einsum("ij,ij->i", a, b)
        far.append(dot / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b))) >= cosine)
    return np.concatenate(far)


#: What names a group: its label, length of vectors, table, key and, where it is dealt in blocks, the two blocks.
NAMES = ["label", "dim", "t", "k", "low", "high"]


Group = dict[str, np.ndarray]


def _groups(batches: Iterator[pa.RecordBatch], binary: dict[str, type]) -> Iterator[Group | None]:
    """Rows sorted by NAMES -> the columns of each group of two or more rows; a group may run over several batches.

    Binary columns become matrices of the given kind. None after each batch: time to give results on.
    """
    held: list[Group] = []
    key = None

    def whole() -> Group:
        return held[0] if len(held) == 1 else {c: np.concatenate([h[c] for h in held]) for c in held[0]}

    for b in batches:
        if not b.num_rows:
            continue
        plain = {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names if c not in binary}
        new, dim = np.zeros(b.num_rows, bool), plain["dim"]
        for c in NAMES:
            new[1:] |= plain[c][1:] != plain[c][:-1]
        cuts = np.r_[0, np.flatnonzero(new), b.num_rows]
        at = end = 0  # the rows of one length of vectors, whose bytes are one matrix
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if e > end:
                rest = np.flatnonzero(dim[s:] != dim[s])
                at, end = s, s + int(rest[0]) if len(rest) else b.num_rows
                matrix = {c: np.frombuffer(b"".join(b.column(c).slice(at, end - at).to_pylist()), kind).reshape(end - at, -1) for c, kind in binary.items()}
            own = tuple(plain[c][s] for c in NAMES)
            if own != key:
                if sum(len(h["cid"]) for h in held) > 1:
                    yield whole()
                key, held = own, []
            held.append({c: v[s:e] for c, v in plain.items()} | {c: v[s - at : e - at] for c, v in matrix.items()})
        yield None
    if sum(len(h["cid"]) for h in held) > 1:
        yield whole()
    yield None


def _pairs(b: Group, cosine: float, epsilon: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a group that the estimates leave, in pieces; between blocks only those of different sides."""
    n, side = len(b["cid"]), b["side"]
    across = b["low"][0] != b["high"][0]
    for at in range(0, n, BLOCK):
        for to in range(at, n, BLOCK):
            i, j = estimated(b["code"], b["factor"], b["rough"], b["step"], slice(at, min(at + BLOCK, n)), slice(to, min(to + BLOCK, n)), cosine, epsilon)
            ok = side[i] != side[j] if across else np.ones(len(i), bool)
            if ok.any():
                yield i[ok], j[ok]


_LIGHT = {"code": np.uint8, "rough": np.int8}


def _left(cosine: float, epsilon: float):
    """Groups by their codes -> the rows that have a pair left, by their group."""
    names = [*NAMES, "side", "cid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def watched() -> Iterator[pa.RecordBatch]:
            for b in batches:
                kinds[:] = [b.schema.field(c).type for c in names]
                yield b

        out: list[Group] = []
        for b in _groups(watched(), _LIGHT):
            if b is not None:
                some = np.zeros(len(b["cid"]), bool)
                for i, j in _pairs(b, cosine, epsilon):
                    some[i] = some[j] = True
                if some.any():
                    out.append({c: b[c][some] for c in names})
            elif out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out]), kind) for c, kind in zip(names, kinds)], names)
                out = []

    return run


def _compared(cosine: float, epsilon: float):
    """Groups of what is left, with their vectors -> what each member gains in links, and a spanning forest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b in _groups(batches, _LIGHT | {"raw": np.float64, "all_keys": np.int32}):
            if b is None:
                if out:
                    a, other, w = (np.concatenate(x) for x in zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(other, mask=w > 0), pa.array(w)], ["a", "b", "w"])
                    out = []
                continue
            if len(np.unique(b["cid"])) < len(b["cid"]):
                first = np.unique(b["cid"], return_index=True)[1]
                b = {c: v[first] for c, v in b.items()}
            raw, keys, cid, n, t = b["raw"], b["all_keys"], b["cid"], b["n"], int(b["t"][0])
            links, found = np.zeros(len(cid), np.int64), []
            for i, j in _pairs(b, cosine, epsilon):
                first = ~(keys[i, :t] == keys[j, :t]).any(axis=1)
                i, j = i[first], j[first]
                ok = reached(raw, i, j, cosine)
                i, j = i[ok], j[ok]
                np.add.at(links, i, n[j])
                np.add.at(links, j, n[i])
                if len(i):
                    found.append((i, j))
            if found:
                root = forest(len(cid), iter(found))
                some, far = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(cid)))
                # gains have a weight and no partner, links of the forest a partner and no weight
                out.append((np.r_[cid[some], cid[far]], np.r_[cid[some], cid[root[far]]], np.r_[links[some], np.zeros(len(far), np.int64)]))

    return run


def near(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, miss: float = MISS) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept; ``miss=0`` compares all pairs of a label."""
    rows = pick(vectors, vec_id=id_col, vec=vec_col, label=label_col).withColumn("vec", F.col("vec").cast("array<double>"))
    whole = F.col("label").isNotNull() & F.coalesce(F.forall("vec", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False)) & F.coalesce(F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = keep(rows.select("vec_id", "label", F.when(whole, F.col("vec")).alias("vec")), "vectors")
    own = rows.where("vec is not null").groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    own = keep(own.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    largest = own.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan(largest, cosine, miss)
    epsilon = EPSILON if miss else 1e12
    kind = own.schema["label"].dataType.simpleString()
    coded = own.select("label", "cid", "n", "vec").mapInPandas(_coded(bits, tables), f"label {kind}, cid long, n long, raw binary, code binary, factor double, rough binary, step double, all_keys binary, ks array<int>, dim int")
    # written: should keys be computed again, a sign near zero might turn
    coded = keep(coded, "codes")
    light = ["cid", "code", "factor", "rough", "step"]
    dealt = coded.select("label", "dim", *light, F.posexplode("ks").alias("t", "k"))
    sizes = keep(coded.select("label", "dim", F.posexplode("ks").alias("t", "k")).groupBy("label", "dim", "t", "k").count().where(F.col("count") > CELL), "large-groups")
    if sizes.take(1):
        # a group too large for one task: each row goes to the block pairs that its own block takes part in
        blocks = sizes.select("label", "dim", "t", "k", F.ceil(F.col("count") / CELL).cast("int").alias("blocks"))
        dealt = dealt.join(blocks, ["label", "dim", "t", "k"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        dealt = dealt.withColumn("side", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.withColumn("low", F.least("side", "other")).withColumn("high", F.greatest("side", "other")).drop("blocks", "other")
    else:
        dealt = dealt.withColumns({"side": F.lit(0), "low": F.lit(0), "high": F.lit(0)})
    met = lambda df: df.repartition(*NAMES).sortWithinPartitions(*NAMES)
    left = f"label {kind}, dim int, t int, k int, low int, high int, side int, cid long"
    left = keep(met(dealt.select(*NAMES, "side", *light)).mapInArrow(_left(cosine, epsilon), left), "left")
    heavy = left.join(coded.select("n", "raw", "all_keys", *light), "cid")
    found = keep(met(heavy.select(*NAMES, "side", "n", "raw", "all_keys", *light)).mapInArrow(_compared(cosine, epsilon), "a long, b long, w long"), "vector-links")
    discard(coded, sizes, left)
    linked = found.where("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v"))
    gained = found.groupBy("a").agg(F.sum("w").alias("w"))
    of = own.select("cid", "label", "vec", "least", "n").join(components(linked).withColumnRenamed("node", "cid"), "cid", "left").join(gained.withColumnRenamed("a", "cid"), "cid", "left")
    of = keep(of.select("label", "vec", "least", F.coalesce("component", "cid").alias("component"), (F.coalesce("w", F.lit(0)) + F.col("n") - 1).alias("links")), "linked-classes")
    named = of.groupBy("component").agg(F.min("least").alias("component_id")).join(of, "component").select("label", "vec", "links", "component_id")
    alone = rows.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = rows.where("vec is not null").join(named, ["label", "vec"]).select("vec_id", F.col("links").alias("n_links"), "component_id").unionByName(alone)
    return both.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE = f"""
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach(u, v) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
n AS (SELECT u, count(*) AS n FROM links GROUP BY u),
c AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON vec_id = c.u LEFT JOIN n ON vec_id = n.u
"""

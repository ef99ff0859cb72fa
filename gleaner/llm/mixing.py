"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents are summed up by the set of sources that they belong to. Source words flow from patterns to the quotas of
their members; a pattern's words may be taken up to MOST times, each further time at a higher cost, so the flow repeats as little
as it can. A pattern that the flow uses f times over gives every document floor(f) times, and the rest by seeded choice:
documents in the order of a seeded hash as long as they fit, then small ones from further on in that order, until what is
missing is under CLOSE of a pattern's words or no document fits, then one document more if that comes nearer.

* A null source is a source of its own, last in order; a document without any source (an empty array) is never taken.
* A null or empty text has size 0 and is taken 0 words. Repeated rows are decided alike; they are told apart by nothing.
* Quotas: weights 1, 2, 3, repeating, by code-point order share the words of all documents; a quota stops at MOST times its
  source's words and the excess is shared anew by weight. Sources without words get 0. An empty table gives an empty result.

The driver sees one row for each pattern, never a document; the patterns of single-membership data are its sources. The
flow takes time about in proportion to the memberships of all patterns; tables of patterns are broadcast up to SMALL rows.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, keep, numbered, pick

MOST, SEED = 3, 29
#: Bits of the seeded order looked at in each of the passes that find where a pattern's choice ends.
STEP, ORDER = 10, 60
#: Passes that fill what is left of a pattern's words, each with documents of at most half of it; and the share of the
#: words that may be left.
ROUNDS, CLOSE = 16, 0.0005
#: Rows of a table of patterns that is broadcast.
SMALL = 100_000


def quotas(sizes: dict[str, int], weights: dict[str, float], total: float, most: float = MOST) -> dict[str, float]:
    """Share ``total`` by weight; no source gets more than ``most`` times its size, the excess goes to the others."""
    out: dict[str, float] = {}
    free = sorted(sizes)
    left = float(total)
    while free:
        unit = left / sum(weights[s] for s in free)
        full = [s for s in free if weights[s] * unit > most * sizes[s]]
        if not full:
            out.update({s: weights[s] * unit for s in free})
            break
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in full]
    return out


class Flow:
    """Maximum flow by blocking flows in layered networks (Dinic); room may be added between runs."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def arc(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def _layers(self, source: int, sink: int) -> list[int]:
        layer = [-1] * len(self.out)
        layer[source], queue = 0, deque([source])
        while queue:
            a = queue.popleft()
            for e in self.out[a]:
                if self.room[e] > 0 and layer[self.to[e]] < 0:
                    layer[self.to[e]] = layer[a] + 1
                    queue.append(self.to[e])
        return layer

    def run(self, source: int, sink: int) -> None:
        while (layer := self._layers(source, sink))[sink] >= 0:
            at = [0] * len(self.out)  # the next arc of each node to try
            path: list[int] = []
            a = source
            while True:
                if a == sink:
                    room = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= room
                        self.room[e ^ 1] += room
                    # back to the tail of the first arc that is full
                    k = next(i for i, e in enumerate(path) if not self.room[e])
                    a = self.to[path[k] ^ 1]
                    del path[k:]
                elif at[a] < len(self.out[a]):
                    e = self.out[a][at[a]]
                    if self.room[e] > 0 and layer[self.to[e]] == layer[a] + 1:
                        path.append(e)
                        a = self.to[e]
                    else:
                        at[a] += 1
                elif path:
                    a = self.to[path.pop() ^ 1]
                    at[a] += 1
                else:
                    break


def route(patterns: dict[tuple[str, ...], int], quota: dict[str, float], most: int = MOST) -> dict[tuple[str, ...], int]:
    """Words to take of each pattern: as much of the quotas as can be met, with as little repetition as that allows.

    Costs stand on the arcs that leave the source only: a pattern's words cost k when taken for the k-th further time. A
    cheapest augmenting path starts with the cheapest arc that leads anywhere and never gives such an arc back, so the
    least cost is found by a maximum flow with the arcs of cost 0, then with those of cost 1 added, and so on.
    """
    names, sources = sorted(patterns), sorted(quota)
    place = {s: 2 + len(names) + i for i, s in enumerate(sources)}
    flow = Flow(2 + len(names) + len(sources))
    first = [flow.arc(0, 2 + i, 0) for i in range(len(names))]
    for i, p in enumerate(names):
        for s in p:
            flow.arc(2 + i, place[s], most * patterns[p])
    for s in sources:
        flow.arc(place[s], 1, round(quota[s]))
    for _ in range(most):
        for p, e in zip(names, first):
            flow.room[e] += patterns[p]
        flow.run(0, 1)
    return {p: flow.room[e ^ 1] for p, e in zip(names, first)}


def words(text: Column) -> Column:
    """The number of runs of anything but ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def labels_of(source: Column, many: bool) -> Column:
    """A document's sources as a sorted set of labels; labels sort as the sources do, null last."""
    label = lambda s: F.when(s.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), s.cast("string")))
    return F.array_sort(F.array_distinct(F.transform(source, label))) if many else F.array(label(source))


def place_of(doc_id: Column, seed: int) -> Column:
    """The document's place in the seeded order, ORDER bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id.cast("string")), 64 - ORDER)


def _small(table: DataFrame, rows: int) -> DataFrame:
    """The table, to be broadcast if it has few rows."""
    return F.broadcast(table) if rows <= SMALL else table


def _ends(rows: DataFrame, rest: DataFrame, patterns: int) -> DataFrame:
    """For each pattern the last place up to which all documents fit into the wanted words: (pattern, last, gap).

    Sums over the upper bits of the place first, then over the next bits within the one cell where the wanted words
    run out, and so on: each pass is a partial aggregation to at most 2^STEP sums a pattern. A pattern that has fewer
    words than wanted is not in the result.
    """
    ends = rest.withColumn("cell", F.lit(0).cast("long"))
    for shift in range(ORDER - STEP, -1, -STEP):
        # one row a pattern
        here = rows.join(_small(ends.select("pattern", "wanted", "cell"), patterns), "pattern").where(F.shiftright("place", shift + STEP) == F.col("cell"))
        sums = here.groupBy("pattern", "wanted", F.shiftright("place", shift).alias("part")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy("pattern").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).where("before <= wanted and before + size > wanted")
        ends = keep(sums.select("pattern", (F.col("wanted") - F.col("before")).alias("wanted"), F.col("part").alias("cell"), "size", "n"), "ends")
        if not ends.where("n > 1").take(1):
            break
    # the cell holds one document, or several at one place, and does not fit
    return ends.select("pattern", (F.shiftleft("cell", shift) - 1).alias("last"), F.col("wanted").alias("gap"))


def plan(rows: DataFrame, most: int = MOST) -> tuple[DataFrame, dict[str, float], dict[str, int]]:
    """rows (pattern, size, place) -> (pattern, copies, runs), quotas and sizes by label."""
    spark = rows.sparkSession
    patterns = {tuple(r["pattern"]): r["size"] for r in rows.groupBy("pattern").agg(F.sum("size").alias("size")).collect()}
    sizes: dict[str, int] = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    weights = {s: float(1 + i % 3) for i, s in enumerate(sorted(sizes))}
    quota = quotas(sizes, weights, sum(patterns.values()), most)
    flow = route(patterns, quota, most)
    whole = [(list(p), flow[p] // n, flow[p] % n) for p, n in patterns.items() if n]
    kind = T.ArrayType(T.StringType())
    wanted = T.StructType([T.StructField("pattern", kind), T.StructField("wanted", T.LongType())])
    # runs of the order whose documents are taken once more: (after, upto, more than, at most) by pattern
    runs: dict[tuple[str, ...], list[tuple[int, int, int, int]]] = {tuple(p): [] for p, _, _ in whole}
    short: dict[tuple[str, ...], int] = {}
    rows = rows.where("size > 0")
    left = [(list(p), r, -1, 0, r) for p, _, r in whole if r]
    for _ in range(ROUNDS):
        if not left:
            break
        bound = spark.createDataFrame(left, T.StructType([T.StructField("pattern", kind), *[T.StructField(c, T.LongType()) for c in ("wanted", "after", "least", "most")]]))
        fit = rows.join(_small(bound.drop("wanted"), len(left)), "pattern").where("place > after and size > least and size <= most").select("pattern", "size", "place")
        ends = {tuple(r["pattern"]): r for r in _ends(fit, bound.select("pattern", "wanted"), len(left)).collect()}
        # where all of them fit, their sum
        fitted = {tuple(r["pattern"]): r["size"] for r in fit.groupBy("pattern").agg(F.sum("size").alias("size")).collect()} if len(ends) < len(left) else {}
        rest = []
        for p, want, after, least, most_ in left:
            if end := ends.get(tuple(p)):
                runs[tuple(p)].append((after, end["last"], least, most_))
                # what is missing is less than one document: the next round takes small ones from further on
                gap, after = end["gap"], end["last"]
                upto = gap // 2 if gap // 2 > least else gap
            else:
                # from here on only larger ones are left in the order
                runs[tuple(p)].append((after, (1 << ORDER) - 1, least, most_))
                gap, least = want - fitted.get(tuple(p), 0), most_
                upto = gap
            short[tuple(p)] = gap
            if gap > CLOSE * flow[tuple(p)] and upto > least:
                rest.append((p, gap, after, least, upto))
        left = rest
    # one document more where that comes nearer, though it passes the mark
    if short := [(list(p), gap, [tuple(x) for x in runs[p]]) for p, gap in short.items() if gap > 0]:
        known = T.StructType([T.StructField("pattern", kind), T.StructField("gap", T.LongType()), T.StructField("runs", RUNS)])
        spare = rows.join(_small(spark.createDataFrame(short, known), len(short)), "pattern").where(~_once_more() & (F.col("size") < 2 * F.col("gap")))
        nearest = spare.groupBy("pattern").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "place", "size")).alias("x"))
        for found in nearest.select("pattern", "x.place", "x.size").collect():
            runs[tuple(found["pattern"])].append((found["place"] - 1, found["place"], found["size"] - 1, found["size"]))
    schema = T.StructType([T.StructField("pattern", kind), T.StructField("copies", T.LongType()), T.StructField("runs", RUNS)])
    return spark.createDataFrame([(p, q, runs[tuple(p)]) for p, q, _ in whole], schema), quota, sizes


#: Runs of the seeded order: (after, upto] in place, (least, most] in size.
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("after", "upto", "least", "most")]))


def _once_more(prefix: str = "") -> Column:
    size, place = F.col(prefix + "size"), F.col(prefix + "place")
    return F.exists(prefix + "runs", lambda r: (place > r["after"]) & (place <= r["upto"]) & (size > r["least"]) & (size <= r["most"]))


def _copies(prefix: str = "") -> Column:
    """How often a document of a planned pattern is taken; needs its size and place beside the plan."""
    return F.when(F.col(prefix + "size") > 0, F.col(prefix + "copies") + _once_more(prefix).cast("long")).otherwise(F.lit(0))


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    many = isinstance(docs.schema[source_col].dataType, T.ArrayType)
    rows = pick(docs, doc_id=id_col, text=text_col, source=source_col)
    return rows.select("doc_id", words(F.col("text")).alias("size"), labels_of(F.col("source"), many).alias("pattern"), place_of(F.col("doc_id"), seed).alias("place"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, size, sources (labels), copies, source_size and target (of the first source)."""
    rows = keep(_rows(docs, id_col, text_col, source_col, seed), "sized")
    chosen, quota, sizes = plan(rows)
    patterns = chosen.count()
    spark = docs.sparkSession
    # one row a source, and one a pattern: the driver has held them already
    of = spark.createDataFrame([(s, sizes[s], quota[s]) for s in sorted(sizes)], "label string, source_size long, target double")
    out = rows.join(_small(chosen, patterns), "pattern", "left").join(_small(of, len(sizes)), F.get("pattern", F.lit(0)) == F.col("label"), "left")
    return out.select("doc_id", "size", F.col("pattern").alias("sources"), F.coalesce(_copies(), F.lit(0)).alias("copies"), F.coalesce("source_size", F.lit(0)).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with all its columns. No text is shuffled."""
    rows = keep(_rows(docs, id_col, text_col, source_col, seed), "sized")
    chosen, _, _ = plan(rows)
    many = isinstance(docs.schema[source_col].dataType, T.ArrayType)
    flat, at = numbered(docs)
    marked = flat.withColumns({"m_pattern": labels_of(F.col(at[source_col]), many), "m_place": place_of(F.col(at[id_col]), seed), "m_size": words(F.col(at[text_col]))})
    marked = marked.join(_small(chosen.toDF(*[f"m_{c}" for c in chosen.columns]), chosen.count()), "m_pattern")
    times = F.array_repeat(F.lit(0), _copies("m_").cast("int"))
    return marked.withColumn("m_copy", F.explode(times)).select(*flat.columns).toDF(*docs.columns)

"""The observation frame: one row per observation, grouped into configurations that are never split.

Columns: row_id, config_id (long), is_energy (boolean), y (double, may be null), w (double), features (array<double>,
the intercept first). A frame has no order but row_id.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ["row_id", "config_id", "is_energy", "y", "w", "features"]


class BadRows(ValueError):
    """Rows that can't be part of a frame."""


def first_rows(frame: DataFrame) -> DataFrame:
    """The smallest row_id of each configuration: a partial aggregate, so a large one does no harm."""
    return frame.groupBy("config_id").agg(F.min("row_id").alias("first_row"))


def build(
    source: DataFrame,
    features: Column | str,
    row_id: Column | str = "row_id",
    config_id: Column | str | None = None,
    is_energy: Column | str | None = None,
    y: Column | str | None = None,
    w: Column | str | None = None,
    intercept: bool = True,
    dtype: str = "float64",
    check: bool = False,
) -> DataFrame:
    """An observation frame with the documented defaults.

    Without configurations each row is its own, and an energy row; with them, the first row of each is its energy row
    unless told otherwise (both with a warning). A missing weight is 1. ``float32`` narrows what is stored; all sums
    stay in double precision. ``check`` counts rows with null ids, weights or features and raises for any.
    """
    if dtype not in ("float64", "float32"):
        raise ValueError(f"dtype must be float64 or float32, not {dtype!r}")
    col = lambda c: F.col(c) if isinstance(c, str) else c
    x = col(features)
    x = x.cast("array<float>").cast("array<double>") if dtype == "float32" else x.cast("array<double>")
    x = F.concat(F.array(F.lit(1.0)), x) if intercept else x
    if config_id is None:
        warnings.warn("no configurations: every row is its own", UserWarning, stacklevel=2)
    config = col(row_id) if config_id is None else col(config_id)
    plain = source.select(
        col(row_id).cast("long").alias("row_id"),
        config.cast("long").alias("config_id"),
        (F.lit(True) if config_id is None else F.lit(None) if is_energy is None else col(is_energy)).cast("boolean").alias("is_energy"),
        (F.lit(None) if y is None else col(y)).cast("double").alias("y"),
        (F.lit(1.0) if w is None else F.coalesce(col(w), F.lit(1.0))).cast("double").alias("w"),
        x.alias("features"),
    )
    if check:
        bad = plain.where("row_id is null or config_id is null or features is null or exists(features, v -> v is null or isnan(v))").count()
        if bad:
            raise BadRows(f"{bad} rows have a null id, a null feature or NaN")
    if config_id is None or is_energy is not None:
        return plain
    warnings.warn("no energy rows: the first row of each configuration is taken", UserWarning, stacklevel=2)
    return plain.join(first_rows(plain), "config_id").withColumn("is_energy", F.col("row_id") == F.col("first_row")).select(COLUMNS)


def width(frame: DataFrame) -> int:
    row = frame.select(F.size("features")).first()
    if row is None:
        raise ValueError("the frame is empty")
    return row[0]


def weighted(frame: DataFrame) -> DataFrame:
    """x~ = w x, y~ = w y; so the weight of a row in the normal equations is w squared."""
    return frame.withColumns({"features": F.transform("features", lambda v: v * F.col("w")), "y": F.col("y") * F.col("w")})


def config_ids(frame: DataFrame) -> DataFrame:
    return frame.select("config_id").distinct()


def members(frame: DataFrame, chosen: DataFrame) -> DataFrame:
    """All rows of the chosen configurations."""
    return frame.join(chosen.select("config_id"), "config_id", "left_semi")


def others(frame: DataFrame, chosen: DataFrame) -> DataFrame:
    return frame.join(chosen.select("config_id"), "config_id", "left_anti")


def row_counts(frame: DataFrame) -> DataFrame:
    return frame.groupBy("config_id").agg(F.count(F.lit(1)).alias("n_rows"))


#: Rows that a task sorts or groups where a shuffle is of a size of our own.
TASK = 1_000_000


def tasks_for(rows: DataFrame) -> int:
    """Tasks of a shuffle of all rows: as many as the session asks for, more where each would get over TASK rows."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK))


#: Rows of a cell when an order over all rows is cut into ranges, and the most cells.
CELL, CELLS = 100_000, 1024


def cell_of(rows: DataFrame, column: str) -> Column:
    """A number for each row that grows with the column, for ranges of about CELL rows between approximate quantiles."""
    many = min(CELLS, rows.count() // CELL + 1)
    if many == 1:
        return F.lit(0)
    bounds = rows.agg(F.percentile_approx(column, [i / many for i in range(1, many)], 10 * CELLS)).first()[0]
    return _below(sorted(set(bounds)), F.col(column))


def _below(bounds: list, x: Column) -> Column:
    """How many of the ascending bounds are below x: every k-th is compared first, then those between two of them."""
    k = max(1, math.isqrt(len(bounds)))
    array = lambda some: F.array(*[F.lit(b) for b in some])
    whole = F.size(F.filter(array(bounds[k - 1 :: k]), lambda b: b < x)) * k
    return whole + F.size(F.filter(F.slice(array(bounds), whole + 1, k), lambda b: b < x))


def boundaries(frame: DataFrame, order: str = "row_id", check: bool = False) -> DataFrame:
    """Runs of equal configurations in row order: (island, config_id, start_row, n_rows), the k-th run has island k.

    Row order is global. It is cut into cells first and runs are found within a cell; one row per cell tells how many
    runs precede it and whether its first run goes on from the cell before. ``check`` raises if a configuration has
    several runs.
    """
    parts = frame.select(F.col(order).alias("pos"), "config_id")
    parts = parts.withColumn("cell", cell_of(parts, "pos"))
    own = Window.partitionBy("cell").orderBy("pos")
    marked = parts.withColumn("new", F.coalesce((F.col("config_id") != F.lag("config_id").over(own)).cast("int"), F.lit(1)))
    runs = marked.withColumn("run", F.sum("new").over(own)).groupBy("cell", "run", "config_id").agg(F.min("pos").alias("start_row"), F.count(F.lit(1)).alias("n_rows"))
    # at most CELLS rows
    cells = runs.groupBy("cell").agg(F.max("run").alias("runs"), F.min_by("config_id", "run").alias("first"), F.max_by("config_id", "run").alias("last"))
    before = Window.orderBy("cell")
    cells = cells.withColumn("goes_on", F.coalesce((F.col("first") == F.lag("last").over(before)).cast("int"), F.lit(0)))
    cells = cells.withColumn("offset", F.sum(F.col("runs") - F.col("goes_on")).over(before) - F.col("runs")).select("cell", "offset")
    joined = runs.join(F.broadcast(cells), "cell").groupBy((F.col("offset") + F.col("run") - 1).alias("island"), "config_id").agg(F.min("start_row").alias("start_row"), F.sum("n_rows").alias("n_rows"))
    if check and joined.groupBy("config_id").count().where("count > 1").take(1):
        raise ValueError("rows of a configuration are not contiguous")
    return joined


def range_ends(counts: DataFrame, parts: int) -> DataFrame:
    """The cut after part i: the configuration boundary nearest to i/parts of all rows: (part, end_row, end_config).

    ``counts`` has (config_id, n_rows); configurations follow each other by id. Every part gets one configuration at least:
    where the nearest boundary lies at or before the cut before, the next one is taken, as in ``balanced_ranges``. Running
    sums are taken within cells of ids, on top of the sums of the cells before.
    """
    spark = counts.sparkSession
    total, many = counts.agg(F.sum("n_rows"), F.count(F.lit(1))).first()
    if parts > (many or 0):
        raise ValueError(f"{parts} parts of {many} configurations")
    counts = counts.withColumn("cell", cell_of(counts, "config_id"))
    cells = counts.groupBy("cell").agg(F.sum("n_rows").alias("sum"), F.count(F.lit(1)).alias("n"))
    below = lambda c: (F.sum(c).over(Window.orderBy("cell")) - F.col(c))  # noqa: E731  at most CELLS rows
    cells = cells.select("cell", below("sum").alias("base"), below("n").alias("first"))
    own = Window.partitionBy("cell").orderBy("config_id")
    ends = counts.withColumns({"run": F.sum("n_rows").over(own), "k": F.row_number().over(own)}).join(F.broadcast(cells), "cell")
    ends = ends.select("config_id", (F.col("base") + F.col("run")).alias("end_row"), (F.col("first") + F.col("k")).alias("k"))
    if parts == 1:
        return ends.limit(0).select(F.lit(1).alias("part"), "end_row", F.col("config_id").alias("end_config"))
    # one pass of partial minima, however many configurations there are
    best = ends.select(*[F.min(F.struct(F.abs(F.col("end_row") - F.lit(total * i / parts)).alias("d"), "k")).alias(f"p{i}") for i in range(1, parts)]).first()
    cuts, last = [], 0
    for i in range(1, parts):
        # distances fall and rise again along the boundaries, so the nearest one allowed is the nearest or next to the cut before
        last = min(max(best[f"p{i}"]["k"], last + 1), many - (parts - i))
        cuts.append((i, last))
    chosen = spark.createDataFrame(cuts, "part int, k long")
    return ends.join(F.broadcast(chosen), "k").select("part", "end_row", F.col("config_id").alias("end_config"))


def balanced_ranges(counts: list[int], parts: int) -> list[tuple[int, int]]:
    """Row ranges of consecutive configurations with about equal rows; each gets one configuration at least."""
    if parts > len(counts):
        raise ValueError(f"{parts} parts of {len(counts)} configurations")
    ends = [0]
    for c in counts:
        ends.append(ends[-1] + c)
    cuts = [0]
    for i in range(1, parts):
        least, most = cuts[-1] + 1, len(counts) - (parts - i)
        cuts.append(min(range(least, most + 1), key=lambda k: (abs(ends[k] - ends[-1] * i / parts), k)))
    cuts.append(len(counts))
    return [(ends[a], ends[b]) for a, b in zip(cuts, cuts[1:])]


def split_configs(frame: DataFrame, by: Column) -> DataFrame:
    """Configurations that a partitioning splits: (config_id, parts); none if it respects them."""
    return frame.groupBy("config_id").agg(F.count_distinct(by).alias("parts")).where("parts > 1")


def check_respected(frame: DataFrame, by: Column) -> None:
    """Raise if a partitioning splits a configuration."""
    found = [r["config_id"] for r in split_configs(frame, by).limit(5).collect()]
    if found:
        raise ValueError(f"configurations in several parts, such as {found}")

"""``.npy`` arrays as a Spark data source, read in row ranges as Arrow batches.

``spark.read.format("npy").option("path", ...)`` gives (row_id, values) for a matrix and (row_id, value) for a vector.
Only the header and the rows of a partition are read; row ranges are found without reading data. Paths are those of
a file system that driver and executors share.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a partition and rows of a batch.
SPLIT, BATCH = 64 << 20, 8192


@dataclass
class Header:
    shape: tuple[int, ...]
    dtype: str
    fortran: bool
    offset: int


def header(path: str) -> Header:
    if not path.endswith(".npy"):
        raise ValueError(f"not a .npy file: {path}")
    with open(path.removeprefix("file://"), "rb") as f:
        version = np.lib.format.read_magic(f)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, fortran, dtype = read(f)
        return Header(shape, dtype.str, fortran and len(shape) > 1, f.tell())


def read_range(path: str, start: int, end: int) -> np.ndarray:
    """Rows start to end of an array, reading no others; Fortran order goes through a memory map."""
    h = header(path)
    end = min(end, h.shape[0])
    if h.fortran:
        return np.array(np.load(path.removeprefix("file://"), mmap_mode="r")[start:end])
    wide = int(np.prod(h.shape[1:], dtype=np.int64))
    kind = np.dtype(h.dtype)
    values = np.fromfile(path.removeprefix("file://"), kind, max(0, end - start) * wide, offset=h.offset + start * wide * kind.itemsize)
    if len(values) != max(0, end - start) * wide:
        raise ValueError(f"{path} is shorter than its header says")
    return values.reshape(max(0, end - start), *h.shape[1:])


@dataclass
class Rows(InputPartition):
    start: int
    end: int


def _kind(h: Header) -> str:
    kind = np.dtype(h.dtype)
    return "long" if kind.kind in "iu" else "boolean" if kind.kind == "b" else "float" if kind.itemsize == 4 else "double"


def _plain(x: np.ndarray) -> np.ndarray:
    """Numbers of a type that Spark has."""
    if x.dtype.kind in "iu":
        return x.astype(np.int64)
    return x.astype(np.float64) if x.dtype.kind == "f" and x.dtype.itemsize not in (4, 8) else x


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        h = header(self.options["path"])
        own = f"values array<{_kind(h)}>" if len(h.shape) > 1 else f"value {_kind(h)}"
        others = [f"{name} {_kind(header(path))}" for name, path in json.loads(self.options.get("others", "[]"))]
        return ", ".join(["row_id long", own, *others])

    def reader(self, schema) -> DataSourceReader:
        return NpyReader(self.options)


class NpyReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.ranges = json.loads(options["ranges"]) if "ranges" in options else None
        self.others = [tuple(x) for x in json.loads(options.get("others", "[]"))]

    def partitions(self) -> list[Rows]:
        if self.ranges is not None:
            return [Rows(a, b) for a, b in self.ranges]
        all_ = [header(path) for path in (self.path, *(path for _, path in self.others))]
        row = max(1, sum(int(np.prod(h.shape[1:], dtype=np.int64)) * np.dtype(h.dtype).itemsize for h in all_))
        step, n = max(1, SPLIT // row), min(h.shape[0] for h in all_)
        return [Rows(a, min(a + step, n)) for a in range(0, n, step)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        flat = len(header(self.path).shape) == 1
        for a in range(partition.start, partition.end, BATCH):
            end = min(a + BATCH, partition.end)
            x = _plain(read_range(self.path, a, end))
            ids = pa.array(np.arange(a, a + len(x)))
            # of a matrix beside the first array, the first column
            others = [pa.array(np.ascontiguousarray(_plain(read_range(path, a, end)).reshape(len(x), -1)[:, 0])) for _, path in self.others]
            names = [name for name, _ in self.others]
            if flat:
                yield pa.RecordBatch.from_arrays([ids, pa.array(x), *others], ["row_id", "value", *names])
            else:
                x = x.reshape(len(x), -1)
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1] or 1, dtype=np.int32)[: len(x) + 1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([ids, values, *others], ["row_id", "values", *names])


def save(frame: DataFrame, path: str, column: str, row_id: str = "row_id") -> Header:
    """Write a column as an array file: row i of the array is the row with number i; numbers run from 0 without gaps.

    Arrays become a matrix, numbers a vector. The file is laid out first; then each task writes its rows where they belong, so a
    task that runs again writes the same bytes. Paths are those of a file system that driver and executors share.
    """
    return save_all(frame, {column: path}, row_id)[column]


def save_all(frame: DataFrame, paths: dict[str, str], row_id: str = "row_id") -> dict[str, Header]:
    """Columns as array files, as ``save``: the frame is computed and its numbers are checked once for all of them."""
    for path in paths.values():
        if not path.endswith(".npy"):
            raise ValueError(f"not a .npy file: {path}")
    rows = frame.select(F.col(row_id).cast("long").alias("i"), *[F.col(c).alias(f"v{k}") for k, c in enumerate(paths)]).persist()
    try:
        arrays = [k for k, c in enumerate(paths) if frame.schema[c].dataType.typeName() == "array"]
        n, last, low, *wide = rows.agg(F.count(F.lit(1)), F.max("i"), F.count_distinct("i"), *[F.max(F.size(f"v{k}")) for k in arrays]).first()
        if n and (last != n - 1 or low != n):
            raise ValueError(f"rows are not numbered from 0 to {n - 1}")
        wide = dict(zip(arrays, wide))
        return {c: _write(frame, rows, path, c, k, n, wide.get(k, 0)) for k, (c, path) in enumerate(paths.items())}
    finally:
        rows.unpersist()


def _write(frame: DataFrame, rows: DataFrame, path: str, column: str, k: int, n: int, wide: int) -> Header:
    vector = frame.schema[column].dataType.typeName() != "array"
    element = frame.schema[column].dataType.simpleString().removeprefix("array<").removesuffix(">")
    kind = np.dtype({"bigint": "<i8", "int": "<i8", "boolean": "|b1", "float": "<f4", "double": "<f8"}[element])
    local, shape = path.removeprefix("file://"), (n,) if vector else (n, wide)
    with open(local, "wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": kind.str, "fortran_order": False, "shape": shape})
        offset = f.tell()
        f.truncate(offset + int(np.prod(shape, dtype=np.int64)) * kind.itemsize)
    row = (1 if vector else wide) * kind.itemsize

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(local, "r+b") as f:
            for b in batches:
                at = b.column("i").to_numpy()
                values = b.column("v") if vector else b.column("v").flatten()
                data = np.ascontiguousarray(values.to_numpy(zero_copy_only=False), kind).reshape(len(at), -1)
                cuts = np.r_[0, np.flatnonzero(np.diff(at) != 1) + 1, len(at)]
                for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    if s < e:
                        f.seek(offset + int(at[s]) * row)
                        f.write(data[s:e].tobytes())
                yield pa.RecordBatch.from_pydict({"n": [len(at)]}, pa.schema([("n", pa.int64())]))

    rows = rows.select("i", F.col(f"v{k}").alias("v"))
    written = rows.sortWithinPartitions("i").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
    if written != n:
        raise ValueError(f"{written} rows written of {n}")
    return Header(shape, kind.str, False, offset)


def load(spark: SparkSession, path: str, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
    """An array as a table; ``ranges`` fixes the row ranges of the partitions."""
    spark.dataSource.register(NpySource)
    reader = spark.read.format("npy").option("path", path)
    return (reader.option("ranges", json.dumps(ranges)) if ranges is not None else reader).load()


def observations(spark: SparkSession, x: str, y: str | None = None, w: str | None = None, config_ids: str | None = None, enrow_mask: str | None = None) -> DataFrame:
    """Arrays aligned by row as one table: row_id, features and what else is given; rows that all arrays have.

    A task reads one row range of all arrays, so that no row is shuffled to meet its others.
    """
    given = [("y", y), ("w", w), ("config_id", config_ids), ("is_energy", enrow_mask)]
    spark.dataSource.register(NpySource)
    others = json.dumps([[name, path] for name, path in given if path is not None])
    out = spark.read.format("npy").option("path", x).option("others", others).load()
    return out.withColumnRenamed("values", "features")

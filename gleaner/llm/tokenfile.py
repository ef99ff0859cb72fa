"""Token files with frequency-ranked ids in a byte-aligned variable-length code.

Ids are replaced by their rank by frequency over the whole corpus, so common tokens take one byte. A rank takes one to
four bytes; its length less one goes, two bits each, to a separate run of control bytes. A file holds consecutive
documents in ascending id order::

    "GLTOK1\\0\\0", documents (u64), tokens (u64), then three sections, each as byte length (u64) and bytes:
    document ids (flags of null ids, packed, then i64 each), token counts of documents (coded), ranks (coded)

with ``coded`` as value count (u64), control bytes, data bytes. ``ranks.ids`` holds the id of each rank (u32).
Decoding looks lengths up in a table of 256 control bytes and spreads the data bytes by a mask: no loop over tokens.

* A null or empty text is a document of the end token alone. Ties in the id keep the order of the text's hash; repeated
  rows stand side by side; null ids come first. An empty table gives no file and an empty result.
* Other columns are ignored. Ids must be integers.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.frame import cell_of
from .common import fresh, keep, partitions, pick, release
from .tokens import encoder

MAGIC = b"GLTOK1\0\0"
#: Tokens after which a file is closed; a document is never cut.
BLOCK = 4 << 20

#: Lengths of the four values that a control byte describes.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def encode(values: np.ndarray) -> bytes:
    """Values below 2^32 as count, control bytes and data bytes."""
    values = np.ascontiguousarray(values, "<u4")
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = extra
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return struct.pack("<Q", len(values)) + control.tobytes() + data.tobytes()


def decode(blob: bytes | memoryview) -> np.ndarray:
    (n,) = struct.unpack_from("<Q", blob)
    m = -(-n // 4)
    lengths = LENGTHS[np.frombuffer(blob, np.uint8, m, 8)].ravel()[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4, dtype=np.uint8) < lengths[:, None]] = np.frombuffer(blob, np.uint8, offset=8 + m)
    return out.view("<u4").ravel()


def write_block(ids: list[int | None], counts: np.ndarray, ranks: np.ndarray) -> bytes:
    null = np.array([i is None for i in ids], bool)
    own = np.packbits(null).tobytes() + np.array([i or 0 for i in ids], "<i8").tobytes()
    parts = [own, encode(counts), encode(ranks)]
    return b"".join([MAGIC, struct.pack("<QQ", len(ids), len(ranks)), *(x for p in parts for x in (struct.pack("<Q", len(p)), p))])


def read_block(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    view = memoryview(blob)
    if blob[:8] != MAGIC:
        raise ValueError("not a token file")
    n, tokens = struct.unpack_from("<QQ", view, 8)
    at, parts = 24, []
    for _ in range(3):
        (size,) = struct.unpack_from("<Q", view, at)
        parts.append(view[at + 8 : at + 8 + size])
        at += 8 + size
    m = -(-n // 8)
    null = np.unpackbits(np.frombuffer(parts[0], np.uint8, m), count=n).astype(bool)
    ids = np.frombuffer(parts[0], "<i8", n, m)
    counts, ranks = decode(parts[1]), decode(parts[2])
    if len(ranks) != tokens or counts.sum() != tokens:
        raise ValueError("token file is damaged")
    return [None if z else i for i, z in zip(ids.tolist(), null.tolist())], counts, ranks


def make_folder(uri: str) -> None:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path, recursive=True)


def save(uri: str, data: bytes) -> None:
    """Write a file at once; a task that runs again writes the same bytes and replaces it."""
    import uuid

    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, path)


def as_uri(path: str) -> str:
    """A plain local path, or Spark's short form of one, as a URI."""
    return path if "://" in path else "file://" + path.removeprefix("file:")


def _encoded(path: str, end: int):
    """Documents to id bytes, and at a task's end the count of each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        seen = np.zeros(max(coder.size, end + 1), np.int64)
        last = np.array([end], coder.kind)
        names = ["doc_id", "ids", "counts"]
        kind = None
        for b in batches:
            kind = b.column("doc_id").type
            out = []
            for text in b.column("text").to_pylist():
                ids = np.concatenate([coder.ids(text), last])
                out.append(ids.tobytes())
            every = np.frombuffer(b"".join(out), coder.kind)
            seen += np.bincount(every, minlength=len(seen))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary()), pa.nulls(len(out), pa.binary())], names)
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.array([seen.tobytes()], pa.binary())], names)

    return run


#: Ascending runs that a task may report before its ids count as unordered.
RUNS = 64


def _low(doc_id: int | None) -> int:
    return -(1 << 63) if doc_id is None else doc_id


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(low, high) of each ascending run of a task's ids, a null low for too many of them; null ids sort first."""
    low, high = [], []
    for b in batches:
        v = np.array([_low(x) for x in b.column("doc_id").to_pylist()], np.int64)
        if not len(v) or len(low) > RUNS:
            continue
        cuts = np.flatnonzero(v[1:] < v[:-1]) + 1
        starts, ends = np.r_[0, cuts][: RUNS + 1], np.r_[cuts, len(v)][: RUNS + 1]
        for s, e in zip(v[starts].tolist(), v[ends - 1].tolist()):
            if high and s >= high[-1]:
                high[-1] = e
            else:
                low.append(s)
                high.append(e)
    if len(low) > RUNS:
        low, high = [None], [None]
    yield pa.RecordBatch.from_pydict({"low": low, "high": high}, pa.schema([("low", pa.int64()), ("high", pa.int64())]))


#: Runs that the driver may look at itself; more are compared within ranges of ids.
LOOK = 1 << 16


def in_order(rows: DataFrame) -> bool:
    """Whether each task reads a few ascending runs of ids and no two runs overlap."""
    runs = rows.select("doc_id").mapInArrow(_runs, "low long, high long")
    if runs.rdd.getNumPartitions() * RUNS <= LOOK:
        found = [tuple(r) for r in runs.collect()]
        if any(r[0] is None for r in found):
            return False
        found.sort()
        return all(a[1] <= b[0] for a, b in zip(found, found[1:]))
    runs = keep(runs, "runs")
    if runs.where("low is null").take(1):
        return False
    runs = runs.withColumn("cell", cell_of(runs, "low"))
    before = F.lag("high").over(Window.partitionBy("cell").orderBy("low", "high"))
    if runs.select("low", before.alias("before")).where("before > low").take(1):
        return False
    # one row a cell: a range of ids, of which there are a bounded number
    cells = runs.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return not cells.select("low", F.max("high").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)).alias("before")).where("before > low").take(1)


def _written(folder: str, kind: str, rank_of: np.ndarray, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        parts: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            counts = np.array([len(p) for p in parts])
            ranks = rank_of[np.concatenate(parts)]
            data = write_block(ids, counts, ranks)
            # the name says what is in it: where the order starts, and a checksum that tells ties apart
            first = _low(ids[0])
            name = f"{first + (1 << 63):020d}-{zlib.crc32(data):08x}-{held}.tok"
            save(f"{folder}/{name}", data)
            out = pa.RecordBatch.from_pydict({"name": [name], "first": [first], "documents": [len(ids)], "tokens": [held]}, pa.schema([("name", pa.string()), ("first", pa.int64()), ("documents", pa.int64()), ("tokens", pa.int64())]))
            ids.clear()
            parts.clear()
            return out

        for b in batches:
            for doc_id, blob in zip(b.column("doc_id").to_pylist(), b.column("ids")):
                if held >= block or ids and _low(doc_id) < _low(ids[-1]):
                    yield close()
                    held = 0
                p = np.frombuffer(blob.as_buffer(), kind)
                ids.append(doc_id)
                parts.append(p.copy())
                held += len(p)
        if ids:
            yield close()

    return run


def write(docs: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, block: int = BLOCK) -> tuple[str, DataFrame]:
    """Write the token files of a corpus; their folder, and a table of the files (name, first, documents, tokens)."""
    spark = docs.sparkSession
    folder = as_uri(folder or fresh(spark, "token-files"))
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    ordered = in_order(rows)
    if not ordered:
        hashed = rows.withColumn("h", F.xxhash64("text"))
        rows = hashed.repartitionByRange(partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    coded = keep(rows.mapInArrow(_encoded(tokenizer, end), "doc_id long, ids binary, counts binary"), "ids")
    release(spark)
    coder = encoder(tokenizer)
    size = max(coder.size, end + 1)
    seen = np.zeros(size, np.int64)
    # the counts of one task are as long as the vocabulary; they meet as sums per id
    sums = coded.where("counts is not null").select("counts").mapInArrow(_counts(size), "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    for r in sums.collect():
        seen[r["id"]] = r["n"]
    ids_by_rank = np.argsort(-seen, kind="stable").astype("<u4")
    rank_of = np.empty(size, np.uint32)
    rank_of[ids_by_rank] = np.arange(size, dtype=np.uint32)
    save(f"{folder}/ranks.ids", ids_by_rank.tobytes())
    texts = coded.where("ids is not null").select("doc_id", "ids")
    if not ordered or not in_order(texts):
        # also where tables were read back in other splits than they were written
        hashed = texts.withColumn("h", F.xxhash64("ids"))
        texts = hashed.repartitionByRange(partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    files = texts.mapInArrow(_written(folder, coder.kind.str, rank_of, block), "name string, first long, documents long, tokens long")
    return folder, keep(files, "token-file-list")


def _counts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for blob in b.column("counts"):
                total += np.frombuffer(blob.as_buffer(), np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["id", "n"])

    return run


def _read(id_of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, blob in zip(b.column("name").to_pylist(), b.column("content")):
                ids, counts, ranks = read_block(blob.as_buffer().to_pybytes())
                tokens = id_of[ranks]
                ends = np.cumsum(counts.astype(np.int64))
                starts = ends - counts
                crc = [zlib.crc32(tokens[s:e].tobytes()) for s, e in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(ids)), pa.array(ids, pa.int64()), pa.array(starts), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())],
                    ["name", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def read(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32.

    A file's own start is the sum of the tokens of the files before it: a prefix sum over one row per file.
    """
    table = spark.read.format("binaryFile").option("pathGlobFilter", "ranks.ids").load(folder).select("content").first()
    id_of = np.frombuffer(bytes(table[0]), "<u4")
    blobs = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder)
    blobs = blobs.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    rows = blobs.mapInArrow(_read(id_of), "name string, doc_id long, start long, n_tokens long, ids_crc32 long")
    # running sums within ranges of files, on top of the ranges before: no task sees all files
    files = files.withColumn("cell", cell_of(files, "first"))
    cells = files.groupBy("cell").agg(F.sum("tokens").alias("sum"))
    cells = cells.select("cell", (F.sum("sum").over(Window.orderBy("cell")) - F.col("sum")).alias("below"))
    before = Window.partitionBy("cell").orderBy("first", "name").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.withColumn("own", F.coalesce(F.sum("tokens").over(before), F.lit(0))).join(F.broadcast(cells), "cell")
    # files that a lost attempt left are not in the table and drop out here
    return rows.join(bases.select("name", (F.col("below") + F.col("own")).alias("base")), "name").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    folder, files = write(docs, tokenizer, end, id_col, text_col)
    release(docs.sparkSession)
    return read(docs.sparkSession, folder, files)

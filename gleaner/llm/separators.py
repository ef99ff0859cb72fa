"""Token counts by a separator scan over flat token files without any index.

A flat file set is streams of raw little-endian ids; a stream is cut into blocks of a fixed number of ids, wherever
that falls, and every document ends with a separator id that no text can produce. The scan compares whole blocks with the
separator at once and takes differences of the places found. Documents that run over block borders are stitched by a
prefix scan over one row per block: the place of the last separator in any earlier block of the stream.

* A null or empty text counts 0 tokens: its separator alone is in the stream. Repeated rows are separate documents.
* Ids behind a stream's last separator are one more document; an empty table is an empty folder and gives an empty result.
* Other columns are ignored. Null ids are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, keep, pick, release
from .tokenfile import as_uri, make_folder, save
from .tokens import encoder

#: Ids in a block.
BLOCK = 4 << 20


def _flat(folder: str, path: str, separator: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        stream = TaskContext.get().partitionId()
        coder = encoder(path)
        end = np.array([separator], coder.kind)
        held: list[np.ndarray] = []
        size = written = seq = 0

        def put(last: bool) -> None:
            nonlocal held, size, written
            every = np.concatenate(held) if held else np.empty(0, coder.kind)
            while len(every) >= block or last and len(every):
                save(f"{folder}/{stream:08d}-{written:08d}.bin", every[:block].tobytes())
                written, every = written + 1, every[block:]
            held, size = [every.copy()], len(every)

        for b in batches:
            for text in b.column("text").to_pylist():
                ids = coder.ids(text)
                held += [ids, end]
                size += len(ids) + 1
                if size >= block:
                    put(False)
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([stream] * n, pa.int64()), pa.array(np.arange(seq, seq + n)), b.column("doc_id")], ["stream", "seq", "doc_id"])
            seq += n
        put(True)

    return run


def write_flat(docs: DataFrame, tokenizer: str, separator: int, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> tuple[str, DataFrame]:
    """Write a corpus as a flat file set, each task its own stream; the folder, and (stream, seq, doc_id) for reference."""
    folder = as_uri(fresh(docs.sparkSession, "flat-tokens"))
    make_folder(folder)  # an empty corpus writes no file
    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    order = keep(rows.mapInArrow(_flat(folder, tokenizer, separator, block), f"stream long, seq long, doc_id {kind}"), "flat-order")
    return folder, order


def _scan(separator: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["stream", "block", "n", "ends"]
        for b in batches:
            for path, blob in zip(b.column("path").to_pylist(), b.column("content")):
                stream, _, block = path.rpartition("/")[2].removesuffix(".bin").partition("-")
                ids = np.frombuffer(blob.as_buffer(), kind)
                ends = np.flatnonzero(ids == separator)
                yield pa.RecordBatch.from_arrays([pa.array([int(stream)]), pa.array([int(block)]), pa.array([len(ids)]), pa.array([ends], pa.list_(pa.int64()))], names)

    return run


def scan(spark: SparkSession, folder: str, separator: int, kind: str = "<u2") -> DataFrame:
    """One row per document of a flat file set: stream, seq (place in its stream), start (in the stream), n_tokens."""
    blobs = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "content")
    blocks = keep(blobs.mapInArrow(_scan(separator, kind), "stream long, block long, n long, ends array<long>"), "separators")
    # one row a block from here on: which documents end in it, and where the first of them began
    before = Window.partitionBy("stream").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = blocks.select("stream", "block", "n", F.size("ends").alias("k"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    heads = heads.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    heads = heads.withColumns(
        {
            "seq": F.coalesce(F.sum("k").over(before), F.lit(0)),
            "open": F.coalesce(F.last(F.col("base") + F.col("last"), ignorenulls=True).over(before) + 1, F.lit(0)),
            "final": F.lead("block").over(Window.partitionBy("stream").orderBy("block")).isNull(),
        }
    ).select("stream", "block", "base", "seq", "open", "final")
    rows = blocks.join(heads, ["stream", "block"])
    tail = F.when(F.col("final"), F.col("base") + F.col("n")).otherwise(F.lit(None))
    closed = F.transform("ends", lambda e: e + F.col("base"))
    rows = rows.select("stream", "seq", F.concat(F.array(F.col("open") - 1), closed).alias("cuts"), tail.alias("tail"))
    tailed = rows.withColumn("cuts", F.when(F.col("tail") > F.element_at("cuts", -1) + 1, F.concat("cuts", F.array("tail"))).otherwise(F.col("cuts")))
    spans = F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), lambda i: F.struct((F.get("cuts", i - 1) + 1).alias("start"), (F.get("cuts", i) - F.get("cuts", i - 1) - 1).alias("n_tokens")))
    out = tailed.where(F.size("cuts") > 1).select("stream", "seq", F.posexplode(spans).alias("i", "span"))
    return out.select("stream", (F.col("seq") + F.col("i")).alias("seq"), "span.start", "span.n_tokens")


def count_tokens(docs: DataFrame, tokenizer: str, separator: int, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, stream, seq, start, n_tokens, from flat files written and scanned again."""
    spark = docs.sparkSession
    folder, order = write_flat(docs, tokenizer, separator, id_col, text_col, block)
    release(spark)
    found = scan(spark, folder, separator, encoder(tokenizer).kind.str)
    return order.join(found, ["stream", "seq"]).select("doc_id", "stream", "seq", "start", "n_tokens")

"""Best-fit packing planned on a histogram of lengths.

Documents are tokenised and cut into pieces of at most CAPACITY tokens. The plan sees only how many pieces there are of
each length: lengths from long to short, each put where the least room that suffices is left, for all sequences with
that room at once. A piece then takes a planned slot: its rank within its length, found by counts per bucket and a rank
within the bucket, says which run of slots it falls in.

Size of the plan: an entry says that runs of sequences get the same pieces of one length. A length that runs out splits
at most one run and opens at most two, so there are at most 3 CAPACITY runs, and a sequence holds at most
sqrt(2 CAPACITY) different lengths: under 1.2 million entries for 4096, whatever the input; usually some thousands.

* A null or empty text is a document of the end token alone. Repeated rows are packed as often as they occur.
* Only documents longer than the capacity are cut; all their pieces but the last have the full length.
* Pieces of equal length are ranked by bucket, then id, piece and checksum; rows equal in all these are interchangeable.
  A length has a bucket for every SLICE of its pieces, so one that holds most of all pieces is ranked by many tasks.
* An empty table gives an empty result; null ids are allowed; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, pick
from .tokens import encoder

CAPACITY, END = 4096, 1
#: Pieces of a length that are ranked together.
SLICE = 10_000


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Length -> number of pieces, to a plan: (length, first rank, first sequence, sequences, pieces in each, offset).

    The pieces of an entry take ranks in order: sequence by sequence, within a sequence by offset. The number of
    sequences and the pieces in each multiply to the ranks that the entry covers.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # what is left -> runs (first sequence, number)
    left: list[int] = []  # the keys of room, sorted
    plan, opened = [], 0

    def put(r: int, run: tuple[int, int]) -> None:
        if r not in room:
            room[r] = []
            insort(left, r)
        room[r].append(run)

    for length in sorted(counts, reverse=True):
        n, rank = counts[length], 0
        while n:
            at = bisect_left(left, length)
            if at < len(left):
                r = left[at]
                first, many = room[r].pop()
                if not room[r]:
                    del room[r], left[at]
            else:
                # what is left of the length opens sequences, full ones first
                r = capacity
                fit = capacity // length
                first, many = opened, max(1, n // fit)
                opened += many
            each = min(r // length, n)
            if n < each * many:
                keep_ = n // each
                if keep_:
                    put(r, (first + keep_, many - keep_))
                    many = keep_
                else:
                    put(r, (first + 1, many - 1)) if many > 1 else None
                    many = 1
            plan.append((length, rank, first, many, each, capacity - r))
            rank += each * many
            n -= each * many
            if r - each * length > 0:
                put(r - each * length, (first, many))
    return plan


def _cut(path: str, end: int, capacity: int, with_ids: bool):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for b in batches:
            of, start, length, crc, every = [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                ids = np.append(coder.ids(text).astype("<u4"), np.uint32(end))
                for k in range(0, len(ids), capacity):
                    part = ids[k : k + capacity]
                    of.append(i)
                    start.append(k)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        every.append(part.tobytes())
            start = np.array(start, np.int64)
            columns = [b.column("doc_id").take(pa.array(of, pa.int64())), pa.array((start // capacity).astype(np.int32)), pa.array(start), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(every, pa.binary())] * with_ids, names)

    return run


def _slots(plan: np.ndarray):
    """Rows (length, rank) -> where their slot is; the plan is sorted by length and first rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (plan[:, 0] << 48) | plan[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            own = plan[np.searchsorted(keys, (length << 48) | rank, side="right") - 1]
            past = rank - own[:, 1]
            names = [c for c in b.schema.names if c != "rank"]
            place = [pa.array(own[:, 2] + past // own[:, 4]), pa.array(own[:, 5] + past % own[:, 4] * length)]
            yield pa.RecordBatch.from_arrays([*map(b.column, names), *place], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, end: int = END, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; ``with_ids`` adds ids (u32 each)."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    rows = rows.mapInArrow(_cut(tokenizer, end, capacity, with_ids), schema)
    rows = keep(rows.withColumn("h", F.xxhash64("doc_id", "piece", "ids_crc32")), "pieces")
    # at most CAPACITY rows reach the driver, and are broadcast
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = np.array(sorted(best_fit(counts, capacity)), np.int64).reshape(-1, 6)
    slices = docs.sparkSession.createDataFrame([(k, n // SLICE + 1) for k, n in counts.items()], "length long, slices long")
    rows = rows.join(F.broadcast(slices), "length").withColumn("bucket", F.expr("pmod(h, slices)"))
    cells = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("own", F.row_number().over(within)).join(cells, ["length", "bucket"])
    ranked = ranked.select(*names, (F.col("before") + F.col("own") - 1).alias("rank"))
    return ranked.mapInArrow(_slots(plan), f"{schema}, sequence_id long, offset long")


def sequences(docs: DataFrame, tokenizer: str, end: int = END, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed sequences: sequence_id, doc_ids in order, ids (u32 each, at most ``capacity``)."""
    pieces = pack(docs, tokenizer, end, capacity, id_col, text_col, with_ids=True)
    # at most ``capacity`` pieces meet
    parts = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda all_, p: F.concat(all_, p["ids"]))
    return parts.select("sequence_id", F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"), ids.alias("ids"))

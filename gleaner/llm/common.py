"""Helpers that the training-data operators share: column picking, tables in the shared folder, sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it, and a word as a run of anything else.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


#: Characters or bytes of a text that are cut into words at once.
PIECE = 4 << 20


def pieces(text, space):
    """A text in pieces of about PIECE characters (or bytes), cut at, and without, a single ``space``."""
    at, n = 0, len(text)
    while n - at > PIECE:
        cut = text.find(space, at + PIECE)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:] if at else text


def pick(df: DataFrame, **columns: str | None) -> DataFrame:
    """Select columns under new names by exact name; other columns, even of clashing names, do no harm.

    ``None`` instead of a name gives a column of nulls.
    """
    names = df.columns
    for name in columns.values():
        if name is not None and name not in names:
            raise ValueError(f"no column {name!r} among {names}")
    flat = df.toDF(*[f"c{i}" for i in range(len(names))])
    return flat.select(*[(F.lit(None) if n is None else F.col(f"c{names.index(n)}")).alias(k) for k, n in columns.items()])


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The frame with columns c0, c1, ... and where each (first) name went; undo with ``toDF(*df.columns)``."""
    names = df.columns
    return df.toDF(*[f"c{i}" for i in range(len(names))]), {n: f"c{names.index(n)}" for n in names}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; one of our own only in a local session without it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all its machines share")
        root = "file://" + tempfile.mkdtemp(prefix="gleaner-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/gleaner-{name}-{uuid.uuid4().hex}"


#: Words of 64 bits in a sieve at most: what is broadcast has no more rows than this.
SIEVE = 1 << 20


def sieve(flat: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The frame with a column g_hit that is true for every row whose ``column`` is among ``ids`` (one column), and for few others.

    The ids set bits of a table of at most SIEVE words, which is broadcast; so rows that can't be among the ids are known
    without a shuffle, and only the others need an exact join. With very many ids all rows may be hit, never too few.
    """
    (name,) = ids.columns
    words = min(SIEVE, 1 << max(10, (ids.count()).bit_length()))
    hashed = lambda c: F.xxhash64(F.lit(17), c.cast("string"))
    own = ids.select(hashed(F.col(name)).alias("h")).select(F.expr(f"pmod(shiftright(h, 6), {words})").alias("g_word"), F.expr("shiftleft(1L, int(h & 63))").alias("b"))
    table = own.groupBy("g_word").agg(F.bit_or("b").alias("g_bits"))
    rows = flat.withColumn("g_hash", hashed(F.col(column))).withColumn("g_word", F.expr(f"pmod(shiftright(g_hash, 6), {words})"))
    hit = F.expr("coalesce(shiftright(g_bits, int(g_hash & 63)) & 1, 0) = 1")
    return rows.join(F.broadcast(table), "g_word", "left").select(*flat.columns, hit.alias("g_hit"))


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write the frame as Parquet in the shared folder and read it back: cuts the lineage, outlives executors."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def discard(*kept: DataFrame) -> None:
    """Delete tables that ``keep`` wrote and no later step reads, through Spark's own file system layer."""
    for df in kept:
        context = df.sparkSession.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished steps now, not when the driver next collects garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus

"""Exact duplicates: frequent digests are settled on the map side, the others by an ordinary shuffle.

Texts are equal when they are identical after deleting ASCII white space. Only DataFrame functions are used.

* A text of null counts as empty; all empty texts are one group.
* Of equal texts the row with the most code points in the original text stays, then the smallest id (null ids last),
  then, for repeated rows, the first one written; every group keeps exactly one row.
* An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, keep, numbered, pick, sieve

#: A digest that more than this share of the rows carries is surely found by the frequent-items pass, which tracks at
#: most 1 / SUPPORT digests; so what is broadcast has at most that many rows, whatever the input.
SUPPORT = 0.001


def digest(text: Column) -> Column:
    """SHA-256 of the text without ASCII white space, as 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES + "+", ""), 256))


def _winner() -> Column:
    return F.min(F.struct(-F.col("n"), F.isnull("doc_id"), "doc_id", "row"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The digests go to a table in the shared folder first (about 50 bytes a row), as they are read three times:
    Misra-Gries counters (``freqItems``) give a superset of the frequent digests; one aggregation verifies them and
    finds each one's winner; the winners, at most 1/support rows, are broadcast and their groups never shuffled.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    rows = keep(rows.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"), digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
    found = rows.select(F.hex("digest").alias("d")).freqItems(["d"], support).select(F.explode("d_freqItems").alias("d"))
    frequent = found.where("d is not null").select(F.unhex("d").alias("digest"))
    heavy = rows.join(F.broadcast(frequent), "digest", "left_semi").groupBy("digest").agg(_winner().alias("w"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    marked = rows.join(F.broadcast(heavy), "digest", "left")
    rest = marked.where("w is null").select("digest", "doc_id", "n", "row")
    winners = rest.groupBy("digest").agg(_winner().alias("w"), F.count(F.lit(1)).alias("group_size"))
    both = marked.where("w is not null").unionByName(rest.join(winners, "digest"))
    return both.select(
        "doc_id",
        F.col("w.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("w.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns.

    Only rows whose id may belong to a copy that goes are shuffled; there a row is found again by id and digest.
    """
    flat, at = numbered(docs)
    verdicts = keep(groups(docs, id_col, text_col).select("doc_id", "kept", F.unhex("text_sha256").alias("digest")), "verdicts")
    sifted = sieve(flat, at[id_col], verdicts.where("not kept").select("doc_id"))
    unsure = sifted.where("g_hit").drop("g_hit").withColumn("g_digest", digest(F.col(at[text_col])))
    stays = verdicts.where("kept").select(F.col("doc_id").alias("g_id"), F.col("digest").alias("g_kept"))
    own = F.col(at[id_col]).eqNullSafe(F.col("g_id")) & (F.col("g_digest") == F.col("g_kept"))
    unsure = unsure.join(stays, own, "left_semi")
    if verdicts.groupBy("doc_id", "digest").count().where("count > 1").take(1):
        # rows that share id and digest can't be told apart by the join: the longest stays
        best = F.max_by(F.struct(*flat.columns), F.length(F.coalesce(F.col(at[text_col]), F.lit(""))))
        unsure = unsure.groupBy(at[id_col], "g_digest").agg(best.alias("best")).select("best.*")
    return sifted.where("not g_hit").select(*flat.columns).unionByName(unsure.select(*flat.columns)).toDF(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""

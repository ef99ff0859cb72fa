"""SimHash near duplicates with a Gray-order hierarchical index.

Fingerprints: ASCII letters are lower-cased, words are runs of anything but ASCII white space, shingles are three words
joined by single spaces (repeats included; with fewer words the whole sequence). A fingerprint bit is 1 if it is set in
over half of the shingles' XXH64 (seed 42). Fingerprints that differ in at most two bits are linked.

Search: copies of a fingerprint become one class first. Of three blocks of a fingerprint (21, 21 and 22 bits) two that differ
in at most two bits agree on one, so every pair meets in one of three tables, each dealt over the partitions by one
block. A partition's share of a table, all keys together, is one index: its fingerprints, turned so that the block comes
first, are sorted by Gray rank; runs of them form nodes that hold the bits all their members share (mask and pattern),
upper nodes hold the bits that their children share. A query adds up the differing bits on its way down, and a whole
group is pruned as soon as the sum passes two. A partition never emits its pairs: only a spanning forest of its links
leaves. A block that more than HOT fingerprints have is dealt again by three parts of the other bits, one of which every
pair within it shares.

* Null and empty texts, and texts of white space only, have fingerprint zero, which links like any other.
* Repeated rows and ties share a class; null ids are allowed: the component's id is its smallest non-null id.
* An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, numbered, pick, pieces, sieve
from .components import components

BITS = 2
SHINGLE = 3
#: Entries of a node of the index, and (query, node) pairs at a time.
FANOUT, FRONTIER = 8, 1 << 17
#: Bits of the blocks that key the three tables, and of the parts by which a block is dealt again that many fingerprints share.
BLOCKS, PARTS = (21, 21, 22), (14, 14)
HOT = 100_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    import xxhash

    h = xxhash.xxh64_intdigest
    n, ones, last = 0, np.zeros(64, np.int64), []
    data = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    for piece in pieces(data, b" "):
        # bytes.split() splits at ASCII white space only; the two words before go on into the next shingles
        words = last + piece.split()
        if len(words) < SHINGLE:
            last = words
            continue
        last = words[1 - SHINGLE :]
        hashes = np.fromiter((h(p, 42) for p in map(b"%b %b %b".__mod__, zip(words, words[1:], words[2:]))), np.uint64, len(words) - 2)
        for i in range(0, len(hashes), 1 << 16):
            some = hashes[i : i + (1 << 16)]
            ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(some)
    if not n:
        return h(b" ".join(last), 42) if last else 0
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _prints(texts: pd.Series) -> pd.Series:
    out = np.fromiter((fingerprint(t) for t in texts), np.uint64, len(texts))
    return pd.Series(out.view(np.int64))


def fingerprint_of(text: Column) -> Column:
    """The fingerprint's bits as a signed long."""
    return F.pandas_udf(_prints, "long")(text)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each word in the Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """A static index of one group's distinct fingerprints.

    Level 0 holds the fingerprints in Gray order, a node of a level above stands for FANOUT neighbours below it:
    ``mask`` has the bits on which all its members agree and ``pattern`` their values. A child keeps only what its
    parent has not factored out, so differences on the way down add up without counting a bit twice.
    """

    def __init__(self, prints: np.ndarray):
        self.prints = prints[np.argsort(gray_rank(prints), kind="stable")]
        full = np.full(len(prints), ~np.uint64(0))
        levels = [(full, self.prints)]
        while len(levels[-1][0]) > FANOUT:
            mask, pattern = levels[-1]
            starts = np.arange(0, len(mask), FANOUT)
            every = np.bitwise_and.reduceat(pattern, starts)
            some = np.bitwise_or.reduceat(pattern, starts)
            levels.append((np.bitwise_and.reduceat(mask, starts) & ~(every ^ some), every))
        self.levels = []
        for k, (mask, pattern) in enumerate(levels):
            own = mask.copy()
            if k + 1 < len(levels):
                own &= ~levels[k + 1][0][np.arange(len(mask)) // FANOUT]
            self.levels.append((own, pattern))

    def pairs(self, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (i, j), i < j, in Gray order of all pairs that differ in at most ``bits`` bits, in pieces."""
        n, top = len(self.prints), len(self.levels[-1][0])
        step = max(1, FRONTIER // (FANOUT * FANOUT))
        for at in range(0, n, step):
            q = np.arange(at, min(n, at + step))
            query, node = np.repeat(q, top), np.tile(np.arange(top), len(q))
            spent = np.zeros(len(query), np.uint8)
            yield from self._down(len(self.levels) - 1, query, node, spent, bits)

    def _down(self, level: int, query: np.ndarray, node: np.ndarray, spent: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        mask, pattern = self.levels[level]
        spent = spent + np.bitwise_count((self.prints[query] ^ pattern[node]) & mask[node])
        # a pair is found from its earlier place: nodes that end before the query are of no use
        ok = (spent <= bits) & ((node + 1) * FANOUT**level > query)
        query, node, spent = query[ok], node[ok], spent[ok]
        if level == 0:
            ok = node > query
            yield query[ok], node[ok]
            return
        below = len(self.levels[level - 1][0])
        for at in range(0, len(query), FRONTIER // FANOUT):
            s = slice(at, at + FRONTIER // FANOUT)
            child = (node[s, None] * FANOUT + np.arange(FANOUT)).ravel()
            ok = child < below
            yield from self._down(level - 1, np.repeat(query[s], FANOUT)[ok], child[ok], np.repeat(spent[s], FANOUT)[ok], bits)


def forest(n: int, pieces: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest place that each of n places reaches, from links in pieces."""
    root = np.arange(n)
    for i, j in pieces:
        while len(i):
            a, b = root[i], root[j]
            ok = a != b
            if not ok.any():
                break
            i, j, a, b = i[ok], j[ok], a[ok], b[ok]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (up := root[root] != root).any():
                root[up] = root[root[up]]
    return root


def links(prints: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints, found by their index."""
    index = GrayIndex(prints)
    root = forest(len(prints), index.pairs(bits))
    far = np.flatnonzero(root != np.arange(len(prints)))
    return index.prints[far], index.prints[root[far]]


def turned(p: np.ndarray, by: int) -> np.ndarray:
    """Words with their bits moved up cyclically."""
    return p if by % 64 == 0 else (p << np.uint64(by % 64)) | (p >> np.uint64(64 - by % 64))


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by t: a partition's share of each table, which may run over several batches, is one index."""
    table, held = None, []

    def close() -> Iterator[pd.DataFrame]:
        up = sum(BLOCKS[:table])
        own = np.unique(np.concatenate(held))
        if len(own) > 1:
            u, v = links(turned(own.view(np.uint64), up))
            yield pd.DataFrame({"u": turned(u, 64 - up).view(np.int64), "v": turned(v, 64 - up).view(np.int64)})

    for b in batches:
        t, p = b["t"].to_numpy(), b["p"].to_numpy()
        cuts = np.r_[0, np.flatnonzero(t[1:] != t[:-1]) + 1, len(t)]
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if s == e:
                continue
            if t[s] != table:
                if held:
                    yield from close()
                table, held = int(t[s]), []
            held.append(p[s:e])
    if held:
        yield from close()


def near(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints (column p) -> (p, component): the smallest linked fingerprint, for linked ones only."""
    turn = lambda by: F.shiftleft("p", by).bitwiseOR(F.shiftrightunsigned("p", 64 - by)) if by else F.col("p")
    tables = [F.struct(F.lit(t).alias("t"), turn(sum(BLOCKS[:t])).alias("q"), F.lit(64 - n).alias("rest")) for t, n in enumerate(BLOCKS)]
    dealt = prints.select("p", F.explode(F.array(*tables)).alias("x")).select("x.*", "p").withColumn("k", F.expr("shiftrightunsigned(q, rest)"))
    hot = keep(dealt.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT), "hot-blocks").select("t", "k")
    one = F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("more")))
    if hot.take(1):
        # one of three parts of the other bits is the same in any two that are to meet; at most all rows / HOT keys are hot
        low, mid = (F.lit((1 << n) - 1) for n in PARTS)
        parts = [F.col("q").bitwiseAND(low), F.shiftrightunsigned("q", PARTS[0]).bitwiseAND(mid), F.expr(f"shiftrightunsigned(shiftleft(q, 64 - rest), 64 - rest + {sum(PARTS)})")]
        again = F.array(*[F.struct(F.lit(i).alias("part"), v.alias("more")) for i, v in enumerate(parts)])
        dealt = dealt.join(hot.withColumn("hot", F.lit(True)), ["t", "k"], "left").withColumn("x", F.explode(F.when(F.col("hot"), again).otherwise(one)))
    else:
        dealt = dealt.withColumn("x", F.explode(one))
    met = dealt.select("t", "k", "x.part", "x.more", "p").repartition("t", "k", "part", "more").select("t", "p").sortWithinPartitions("t")
    return components(met.mapInPandas(_search, "u long, v long")).withColumnRenamed("node", "p")


def _classified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: doc_id, p, component_id, and the component's lead as (id is null, id, -length, p)."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    rows = rows.select("doc_id", fingerprint_of(F.col("text")).alias("p"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    rows = keep(rows, "fingerprints")
    first = F.struct(F.isnull("doc_id").alias("none"), "doc_id", (-F.col("n")).alias("size"), "p")
    own = rows.groupBy("p").agg(F.min(first).alias("first"))
    linked = near(own.select("p"))
    of = keep(own.join(linked, "p", "left").select("p", "first", F.coalesce("component", "p").alias("component")), "classes")
    named = of.groupBy("component").agg(F.min("first").alias("lead"))
    named = of.join(named, "component").select("p", "lead")
    return rows.join(named, "p").select("doc_id", "p", F.col("lead.doc_id").alias("component_id"), "lead")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id."""
    found = _classified(docs, id_col, text_col)
    return found.select("doc_id", F.lower(F.lpad(F.hex("p"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group stays, the one with the smallest id, with all its columns.

    Of a group's rows with that same id the longest stays. A group whose ids are all null keeps one row. Rows of one id
    may belong to several groups: a row is known by its id and fingerprint.
    """
    flat, at = numbered(docs)
    leads = F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("p") == F.col("lead.p"))
    found = _classified(docs, id_col, text_col).select("doc_id", "p", leads.alias("leads"))
    often = keep(found.groupBy("doc_id", "p").agg(F.count(F.lit(1)).alias("n"), F.bool_or("leads").alias("leads")), "near-verdicts")
    # only rows whose id may go, or comes several times under one fingerprint, are shuffled
    sifted = sieve(flat, at[id_col], often.where("n > 1 or not leads").select("doc_id"))
    sure, unsure = sifted.where("not g_hit").select(*flat.columns), sifted.where("g_hit").select(*flat.columns)
    lead = often.where("leads").select(F.col("doc_id").alias("g_id"), F.col("p").alias("g_lead"), F.col("n").alias("g_n"))
    own = F.col(at[id_col]).eqNullSafe(F.col("g_id")) & (F.col("g_p") == F.col("g_lead"))
    # written, as both joins read the fingerprints
    unsure = keep(unsure.withColumn("g_p", fingerprint_of(F.col(at[text_col]))), "near-unsure")
    out = sure.unionByName(unsure.join(lead.where("g_n = 1"), own, "left_semi").select(*flat.columns))
    if not lead.where("g_n > 1").take(1):
        return out.toDF(*docs.columns)
    text = F.coalesce(F.col(at[text_col]), F.lit(""))
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in flat.columns]
    more = unsure.join(lead.where("g_n > 1"), own, "left_semi")
    best = more.groupBy(F.col(at[id_col]), "g_p").agg(F.max_by(F.struct(*flat.columns), F.struct(F.length(text), F.xxhash64(*cells))).alias("best"))
    return out.unionByName(best.select("best.*")).toDF(*docs.columns)

"""Removal of repeated byte strings, by difference-cover sampling and blockwise sorting of suffixes.

A byte goes if a string of WIDTH bytes covers it that also starts anywhere else in the corpus, judged on the input. Only
suffixes that agree on WIDTH bytes matter, so their order beyond equality is not needed and suffixes are ordered by
fingerprints of fixed prefixes.

1. Cover sample. Positions whose remainder modulo PERIOD lies in a difference cover are sampled: for any two positions
   there is a shift below PERIOD that takes both to sampled ones. So two equal strings of WIDTH bytes hold two equal
   blocks of WIDTH - PERIOD + 1 bytes at sampled positions. The blocks' fingerprints are sorted, one bucket of
   fingerprints at a time, and ranked: shared between texts, or not.
2. Suffix blocks. Only suffixes with a shared sampled block within the next PERIOD positions can be repeated. Their WIDTH-byte
   prefixes are dealt into buckets by a fingerprint and sorted within a bucket, one bucket at a time;
   a bucket holds about BUCKET entries, whatever the size of the corpus. Blocks and suffixes that a group of texts has
   several times are settled on the map side, and one entry per group goes on, so a passage that very many texts
   share does not fill a bucket.
3. Marking. Texts get back a bit for each suffix they sent and mark what repeated suffixes cover: the spans. Rows whose
   text has any are cut; the others keep their text without a shuffle.

Two prefixes are equal if 79 bits of two independent fingerprints are: 48 of a sum modulo 2^64 and 31 of a sum modulo a prime.
Among n different prefixes n^2 / 2^80 pairs agree by chance: 0.8 of them among 10^12.

Equal texts are found first by a hash: one of them takes part, all of WIDTH bytes or more lose everything. A key
that belongs to texts of different second hashes is replaced by the second, so texts count as equal by 128 bits.

A text of more than SEGMENT bytes takes part in segments that overlap by WIDTH - 1 bytes, so that each of its strings of
WIDTH bytes is in one of them: memory depends on SEGMENT and not on the longest text.

* A null text is empty; texts shorter than WIDTH bytes lose nothing. Matches never cross documents and overlaps count, also
  within one document. Repeated rows count as separate documents. Null ids are allowed; an empty table gives an
  empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, keep, partitions, pick, release, sieve

WIDTH = 400
#: A perfect difference set: every remainder modulo 273 is a difference of two of these 17. Found from the powers of a
#: generator of GF(16^3), see ``difference_cover``.
ORDER = 16
PERIOD = ORDER * ORDER + ORDER + 1
#: Entries of a bucket that is sorted at once, and bytes of a text whose fingerprints are computed at once.
BUCKET, CHUNK = 8 << 20, (1 << 20) - 1024
#: Bytes of a text that take part at once, of texts whose replies are gathered together, of texts whose sampled blocks are
#: dealt together, and suffixes dealt together.
SEGMENT, GATHER, GROUP, SENT = 16 << 20, 256 << 20, 32 << 20, 1 << 20
#: A prefix's two fingerprints: 48 bits of the one and 16 of the other, then what is left of the other.
PREFIX = np.dtype([("a", "<u8"), ("b", "<u2")])


@lru_cache(maxsize=1)
def difference_cover() -> np.ndarray:
    """Singer's difference set of the projective plane of order 16, by a search for a linear form in GF(2^12)."""
    poly = 0b1000001010011  # x^12 + x^6 + x^4 + x + 1, primitive
    power, log = [1], {1: 0}
    for k in range(1, 4095):
        v = power[-1] << 1
        v = v ^ poly if v >> 12 else v
        power.append(v)
        log[v] = k
    times = lambda a, b: 0 if not a or not b else power[(log[a] + log[b]) % 4095]

    def trace(v: int) -> int:  # from GF(16^3) to GF(16)
        a = v
        for _ in range(4):
            a = times(a, a)
        b = a
        for _ in range(4):
            b = times(b, b)
        return v ^ a ^ b

    cover = np.array([k for k in range(PERIOD) if trace(power[k]) == 0])
    assert len(set(((cover[:, None] - cover) % PERIOD).ravel().tolist())) == PERIOD
    return cover


class Prints:
    """Fingerprints of all strings of one width in a byte string: differences of sums of random words times powers."""

    def __init__(self, seed: int):
        self.word = np.random.default_rng([seed, 1]).integers(0, 1 << 64, 256, np.uint64)
        self.base = int(np.random.default_rng([seed, 2]).integers(0, 1 << 61)) * 8 + 5
        self.power = self._powers(self.base, 1 << 12)
        self.back = self._powers(pow(self.base, -1, 1 << 64), 1 << 12)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        k = 1
        while k < n:
            out[k : 2 * k] = out[: min(k, n - k)] * np.uint64(pow(base, k, 1 << 64))
            k *= 2
        return out

    def at(self, data: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
        """Fingerprints of data[p : p + width] for ascending places p."""
        out = np.empty(len(places), np.uint64)
        for start in range(0, max(len(data), 1), CHUNK):
            i, j = np.searchsorted(places, [start, start + CHUNK])
            if i == j:
                continue
            own = data[start : start + CHUNK + width]
            while len(self.power) < len(own) + 1:
                self.power = self._powers(self.base, 2 * len(self.power))
                self.back = self._powers(pow(self.base, -1, 1 << 64), 2 * len(self.back))
            total = np.zeros(len(own) + 1, np.uint64)
            np.cumsum(self.word[own] * self.power[: len(own)], out=total[1:])
            p = places[i:j] - start
            out[i:j] = (total[p + width] - total[p]) * self.back[p]
        # the lower bits of such sums are weaker: mix
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
        return out


class PrimePrints:
    """Fingerprints modulo the prime 2^31 - 1: no sum of a chunk leaves 64 bits."""

    PRIME = (1 << 31) - 1

    def __init__(self, seed: int):
        rng = np.random.default_rng([seed, 3])
        self.word = rng.integers(1, self.PRIME, 256, np.uint64)
        self.base = int(rng.integers(1 << 20, self.PRIME - 1))
        self.power = self.back = np.ones(1, np.uint64)

    def _powers(self, base: int, n: int) -> np.ndarray:
        out, k = np.ones(n, np.uint64), 1
        while k < n:
            out[k : 2 * k] = out[: min(k, n - k)] * np.uint64(pow(base, k, self.PRIME)) % np.uint64(self.PRIME)
            k *= 2
        return out

    def at(self, data: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
        """Fingerprints of data[p : p + width] for ascending places p."""
        out, q = np.empty(len(places), np.uint64), np.uint64(self.PRIME)
        for start in range(0, max(len(data), 1), CHUNK):
            i, j = np.searchsorted(places, [start, start + CHUNK])
            if i == j:
                continue
            own = data[start : start + CHUNK + width]
            if len(self.power) < len(own):
                n = 1 << (len(own) - 1).bit_length()
                self.power, self.back = self._powers(self.base, n), self._powers(pow(self.base, -1, self.PRIME), n)
            total = np.zeros(len(own) + 1, np.uint64)
            np.cumsum(self.word[own] * self.power[: len(own)] % q, out=total[1:])
            p = places[i:j] - start
            out[i:j] = (total[p + width] - total[p]) % q * self.back[p] % q
        return out


_PRINTS: dict[int, Prints] = {}
_PRIME_PRINTS: dict[int, PrimePrints] = {}


def prints(seed: int) -> Prints:
    if seed not in _PRINTS:
        _PRINTS[seed] = Prints(seed)
    return _PRINTS[seed]


def prefixes(data: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """Both fingerprints of the strings at ascending places."""
    out = np.empty(len(places), PREFIX)
    if len(places):
        if 2 not in _PRIME_PRINTS:
            _PRIME_PRINTS[2] = PrimePrints(2)
        more = _PRIME_PRINTS[2].at(data, places, width)
        out["a"] = prints(2).at(data, places, width) & np.uint64(0xFFFFFFFFFFFF0000) | more >> np.uint64(15)
        out["b"] = more & np.uint64(0x7FFF)
    return out


def sorted_prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether each in that order equals the one before it)."""
    first = values["a"].copy()
    order = np.argsort(first, kind="stable")
    v = first[order]
    same = np.r_[False, v[1:] == v[:-1]][: len(v)]
    b = values["b"][order]
    if (same[1:] & (b[1:] != b[:-1])).any():
        order = np.lexsort((values["b"], first))
        v, b = first[order], values["b"][order]
        same = np.r_[False, (v[1:] == v[:-1]) & (b[1:] == b[:-1])]
    return order, same


def samples(data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled positions of a text, and the fingerprints of their blocks."""
    block = width - PERIOD + 1
    cover = difference_cover()
    places = (np.arange(0, len(data), PERIOD)[:, None] + cover).ravel()
    places = places[places <= len(data) - block]
    return places, prints(1).at(data, places, block)


def candidates(data: np.ndarray, shared: np.ndarray, width: int) -> np.ndarray:
    """Places where a repeated string may start: a block that is shared, or repeated in this text, begins in the next PERIOD positions."""
    if len(data) < width:
        return np.empty(0, np.int64)
    places, found = samples(data, width)
    low = found & np.uint64(_LOW)
    values, counts = np.unique(low, return_counts=True)
    places = places[np.isin(low, np.union1d(values[counts > 1], shared))]
    last = len(data) - width
    step = np.zeros(last + 2, np.int64)
    np.add.at(step, np.clip(places - PERIOD + 1, 0, last + 1), 1)
    np.add.at(step, np.minimum(places, last) + 1, -1)
    return np.flatnonzero(np.cumsum(step[:-1]) > 0)


#: Of a block's fingerprint, a bucket's entries keep these bits; a chance agreement costs work, not correctness.
_LOW = (1 << 32) - 1


def _dealt(buckets: int, bucket: np.ndarray, values: np.ndarray, keys: list[int], of: np.ndarray) -> Iterator[tuple]:
    """Rows (bucket, keys, counts, values): the values of several texts (``of`` is ascending) that go to one bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, values, of = bucket[order], values[order], of[order]
    cuts = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]
    every = np.array(keys, np.int64)
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if s == e:
            continue
        own, counts = np.unique(of[s:e], return_counts=True)
        yield int(bucket[s]), every[own].tobytes(), counts.astype("<u4").tobytes(), values[s:e].tobytes()


#: Entries for a bucket have no part; rows with a part are replies that a group of texts gave itself, on their way.
_DEAL = "bucket int, part int, keys binary, counts binary, vals binary"
_DEAL_NAMES = ["bucket", "part", "keys", "counts", "vals"]
#: The tag of such replies, where a bucket's number stands in others.
_OWN = 0x7FFFFFFF


def _packed(rows: list[tuple], own: pa.RecordBatch | None = None) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    rows = [(r[0], None, *r[1:]) for r in rows]
    if own is not None:
        rows += [(part, part, keys, sizes, vals) for part, keys, sizes, vals in zip(*(own.column(c).to_pylist() for c in ("part", "keys", "sizes", "vals")))]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], _DEAL_NAMES)


def _sampled(width: int, buckets: int, parts: int, group: int):
    """(key, text) -> sampled blocks by bucket; a text that a task meets again is skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys: list[int] = []
        found: list[np.ndarray] = []
        size = 0

        def deal() -> pa.RecordBatch:
            of = np.repeat(np.arange(len(keys)), [len(f) for f in found])
            every = np.concatenate(found)
            # a block that several texts of the group have is settled here; one entry tells the other groups
            _, first, back, times = np.unique(every, return_index=True, return_inverse=True, return_counts=True)
            known = times[back] > 1
            own = _replies(_OWN, parts, np.array(keys, np.int64), np.bincount(of[known], minlength=len(keys)) * 4, (every[known] & np.uint64(_LOW)).astype("<u4").tobytes())
            sent = np.sort(first)
            every, of = every[sent], of[sent]
            rows = list(_dealt(buckets, ((every >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), (every & np.uint64(_LOW)).astype("<u4"), keys, of))
            keys.clear()
            found.clear()
            return _packed(rows, own)

        for b in batches:
            for key, text in zip(b.column("key").to_pylist(), b.column("text")):
                if key in seen or not text.is_valid:
                    continue
                if len(seen) > 1 << 18:
                    seen.clear()
                seen.add(key)
                data = np.frombuffer(text.as_buffer(), np.uint8)
                if len(data) < width:
                    continue
                own = samples(data, width)[1]
                # one entry for each different block, and for one that the text itself repeats another under a key
                # that is no other text's, so that it counts as shared
                own, times = np.unique(own, return_counts=True)
                keys.append(key)
                found.append(own)
                if (times > 1).any():
                    keys.append(~key)
                    found.append(own[times > 1])
                size += len(data)
                if size >= group:
                    yield deal()
                    size = 0
        if found:
            yield deal()

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[bytes]] | pa.RecordBatch]:
    """Rows sorted by bucket -> per bucket: keys, counts, and the runs of values; replies pass as they are."""
    now, keys, counts, vals = None, [], [], []

    def out():
        return now, np.frombuffer(b"".join(keys), np.int64), np.frombuffer(b"".join(counts), "<u4"), vals

    for b in batches:
        done = b.filter(b.column("part").is_valid())
        if done.num_rows:
            tags = pa.array([_OWN] * done.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([done.column("part"), tags, *map(done.column, ("keys", "counts", "vals"))], ["part", "bucket", "keys", "sizes", "vals"])
        b = b.filter(b.column("part").is_null())
        for bucket, k, c, v in zip(*(b.column(c).to_pylist() for c in ("bucket", "keys", "counts", "vals"))):
            if bucket != now:
                if keys:
                    yield out()
                now, keys, counts, vals = bucket, [], [], []
            keys.append(k)
            counts.append(c)
            vals.append(v)
    if keys:
        yield out()


def _shared(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Sort one bucket's blocks; tell each text which of its blocks another text has, too."""
    for group in _grouped(batches):
        if isinstance(group, pa.RecordBatch):
            yield group
            continue
        bucket, keys, counts, vals = group
        values = np.frombuffer(b"".join(vals), "<u4")
        of = np.repeat(keys, counts)
        order = np.argsort(values, kind="stable")
        v, k = values[order], of[order]
        starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        several = np.minimum.reduceat(k, starts) != np.maximum.reduceat(k, starts)
        flag = np.empty(len(v), bool)
        flag[order] = np.repeat(several, np.diff(np.r_[starts, len(v)]))
        ends = np.r_[0, np.cumsum(counts)]
        kept = np.diff(np.r_[0, np.cumsum(flag)][ends])
        yield _replies(bucket, parts, keys, kept * 4, values[flag].tobytes())


def _replies(bucket: int, parts: int, keys: np.ndarray, sizes: np.ndarray, blob: bytes) -> pa.RecordBatch:
    """What one bucket has to tell its texts, ``sizes`` bytes each, packed by the part that gathers a text's replies.

    So the number of rows is that of buckets times parts, not of buckets times texts.
    """
    some = np.flatnonzero(sizes)
    at = np.r_[0, np.cumsum(sizes)]
    part = (keys[some].view(np.uint64) % np.uint64(parts)).astype(np.int64)
    order = some[np.argsort(part, kind="stable")]
    cuts = np.searchsorted(np.sort(part), np.arange(parts + 1))
    rows = []
    for d in range(parts):
        own = order[cuts[d] : cuts[d + 1]]
        if len(own):
            rows.append((d, bucket, keys[own].tobytes(), sizes[own].astype("<u4").tobytes(), b"".join([blob[at[i] : at[i + 1]] for i in own.tolist()])))
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["part", "bucket", "keys", "sizes", "vals"])


_REPLIES = "part int, bucket int, keys binary, sizes binary, vals binary"


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replies sorted by part -> one row per text: key, buckets, sizes, vals."""
    names = ["key", "buckets", "sizes", "vals"]
    now, held = None, []

    def out() -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([np.frombuffer(k, np.int64) for _, k, _, _ in held])
        sizes = np.concatenate([np.frombuffer(c, "<u4") for _, _, c, _ in held])
        buckets = np.repeat(np.array([b for b, _, _, _ in held], "<u4"), [len(k) // 8 for _, k, _, _ in held])
        blob = b"".join(v for _, _, _, v in held)
        at = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
        order = np.argsort(keys, kind="stable")
        cuts = np.r_[0, np.flatnonzero(np.diff(keys[order])) + 1, len(keys)]
        for s in range(0, len(cuts) - 1, 4096):
            rows = []
            for i, j in zip(cuts[s : s + 4096].tolist(), cuts[s + 1 : s + 4097].tolist()):
                own = order[i:j]
                rows.append((int(keys[own[0]]), buckets[own].tobytes(), sizes[own].tobytes(), b"".join([blob[at[x] : at[x + 1]] for x in own.tolist()])))
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    for b in batches:
        for part, *rest in zip(*(b.column(c).to_pylist() for c in ("part", "bucket", "keys", "sizes", "vals"))):
            if part != now:
                if held:
                    yield from out()
                now, held = part, []
            held.append(rest)
    if held:
        yield from out()


def _gather(replies: DataFrame, parts: int) -> DataFrame:
    return replies.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_gathered, "key long, buckets binary, sizes binary, vals binary")


def _suffixes(width: int, buckets: int, parts: int, sent: int):
    """(key, text, shared) -> prefixes of the candidate suffixes by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, found, size = [], [], 0
            for key, text, shared in zip(b.column("key").to_pylist(), b.column("text"), b.column("shared")):
                own = _prefixes(text, shared, width)[2]
                if not len(own):
                    continue
                keys.append(key)
                found.append(own)
                size += len(own)
                if size >= sent:
                    yield _deal_suffixes(keys, found, buckets, parts)
                    keys, found, size = [], [], 0
            if found:
                yield _deal_suffixes(keys, found, buckets, parts)

    return run


def _prefixes(text: pa.Scalar, shared: pa.Scalar, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(text.as_buffer(), np.uint8)
    places = candidates(data, np.frombuffer(shared.as_buffer(), "<u4").astype(np.uint64), width)
    return data, places, prefixes(data, places, width)


def _bucket_of(found: np.ndarray, buckets: int) -> np.ndarray:
    # other bits than those that make up most of a sort key's order
    return ((found["a"] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _deal_suffixes(keys: list[int], found: list[np.ndarray], buckets: int, parts: int) -> pa.RecordBatch:
    sizes = np.array([len(f) for f in found])
    of = np.repeat(np.arange(len(keys)), sizes)
    every = np.concatenate(found)
    # a prefix that the group has several times is settled here; its first place tells the other groups
    order, again = sorted_prefixes(every)
    new = ~again
    sent = np.zeros(len(every), bool)
    sent[order[new]] = True
    same = ~new
    known = np.zeros(len(every), bool)
    known[order[same]] = True
    known[order[np.r_[same[1:], False]]] = True
    # runs of places that are known, (place in its text, length, whether sent)
    state = known.astype(np.int8) + (known & sent)
    cuts = np.flatnonzero(np.r_[True, (state[1:] != state[:-1]) | (of[1:] != of[:-1])])
    lengths = np.diff(np.r_[cuts, len(every)])
    real = state[cuts] > 0
    cuts, lengths = cuts[real], lengths[real]
    starts = cuts - (np.cumsum(sizes) - sizes)[of[cuts]]
    runs = np.column_stack([starts, lengths, state[cuts] > 1]).astype("<u4")
    own = _replies(_OWN, parts, np.array(keys, np.int64), np.bincount(of[cuts], minlength=len(keys)) * 12, runs.tobytes())
    every, of = every[sent], of[sent]
    return _packed(list(_dealt(buckets, _bucket_of(every, buckets), every, keys, of)), own)


def _repeated(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Sort one bucket's suffixes; a bit for each tells whether its prefix occurs again."""
    for group in _grouped(batches):
        if isinstance(group, pa.RecordBatch):
            yield group
            continue
        bucket, keys, counts, vals = group
        values = np.frombuffer(b"".join(vals), PREFIX)
        vals.clear()
        order, same = sorted_prefixes(values)
        flag = np.zeros(len(values), bool)
        flag[order[same]] = True
        flag[order[:-1][same[1:]]] = True
        ends = np.r_[0, np.cumsum(counts, dtype=np.int64)]
        hits = np.diff(np.r_[0, np.cumsum(flag)][ends])
        bits = [np.packbits(flag[s:e]).tobytes() if n else b"" for s, e, n in zip(ends[:-1].tolist(), ends[1:].tolist(), hits.tolist())]
        yield _replies(bucket, parts, keys, np.array([len(x) for x in bits], np.int64), b"".join(bits))


def covered(starts: np.ndarray, n: int, width: int) -> list[tuple[int, int]]:
    """Maximal runs that strings of ``width`` bytes at ascending ``starts`` cover."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > width)
    first, last = np.r_[starts[0], starts[cuts + 1]], np.r_[starts[cuts], starts[-1]] + width
    return list(zip(first.tolist(), np.minimum(last, n).tolist()))


def _marked(width: int, buckets: int, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for of, seg, text, shared, *reply in zip(b.column("of").to_pylist(), b.column("seg").to_pylist(), *(b.column(c) for c in ("text", "shared", "buckets", "sizes", "bits"))):
                data, places, found = _prefixes(text, shared, width)
                flag, sent = np.zeros(len(places), bool), np.ones(len(places), bool)
                from_, sizes, bits = (np.frombuffer(r.as_buffer(), kind) for r, kind in zip(reply, ("<u4", "<u4", np.uint8)))
                ends = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
                for k in np.flatnonzero(from_ == _OWN).tolist():
                    for start, length, was_sent in np.frombuffer(bits[ends[k] : ends[k + 1]].tobytes(), "<u4").reshape(-1, 3).tolist():
                        flag[start : start + length] = True
                        sent[start : start + length] = was_sent
                dealt = np.flatnonzero(sent)
                own = _bucket_of(found[dealt], buckets)
                order = np.argsort(own, kind="stable")
                cut = np.searchsorted(own[order], np.arange(buckets + 1))
                for k in np.flatnonzero(from_ != _OWN).tolist():
                    bucket = int(from_[k])
                    at = dealt[order[cut[bucket] : cut[bucket + 1]]]
                    flag[at] |= np.unpackbits(bits[ends[k] : ends[k + 1]], count=len(at)).astype(bool)
                runs = covered(places[flag], len(data), width)
                rows.append((of, [{"start": s + seg * segment, "end": e + seg * segment} for s, e in runs]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate([pa.int64(), _SPAN_LIST])], ["key", "spans"])

    return run


_SPANS = "array<struct<start: bigint, end: bigint>>"
_SPAN_LIST = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_bytes, spans, text) -> the same with spans of neighbouring segments joined, and what they leave of the text."""
    for b in batches:
        kept, every = [], []
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
            runs: list[list[int]] = []
            for span in spans:
                if runs and span["start"] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], span["end"])
                else:
                    runs.append([span["start"], span["end"]])
            cuts = [0, *(x for run in runs for x in run), len(text)]
            kept.append(b"".join(text[i:j] for i, j in zip(cuts[::2], cuts[1::2])))
            every.append([{"start": i, "end": j} for i, j in runs])
        yield pa.RecordBatch.from_arrays([*map(b.column, ("doc_id", "n_bytes")), pa.array(every, _SPAN_LIST), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return summary(deduplicated(docs, id_col, text_col, width))


def summary(found: DataFrame) -> DataFrame:
    """What ``deduplicated`` returns, in numbers: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def text_key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "text")


def _keyed(texts: DataFrame) -> tuple[DataFrame, Column]:
    """One row per text, without it (doc_id, key, n_bytes), and the key as an expression of the text."""
    rows = keep(texts.select("doc_id", text_key(7).alias("key"), text_key(8).alias("second"), F.octet_length("text").cast("long").alias("n_bytes")), "texts")
    # keys of different texts: about n^2 / 2^65 of n texts, so none but in very large corpora
    clash = [r["key"] for r in rows.groupBy("key").agg(F.min("second").alias("a"), F.max("second").alias("b")).where("a <> b").select("key").collect()]
    pick_key = lambda key, second: F.when(key.isin(clash), second).otherwise(key) if clash else key
    return rows.withColumn("key", pick_key(F.col("key"), F.col("second"))).drop("second"), pick_key(text_key(7), text_key(8))


def _segment_key(key: Column, seg: Column) -> Column:
    return F.when(seg == 0, key).otherwise(F.xxhash64(key, seg))


def _segments(texts: DataFrame, key: Column, width: int) -> DataFrame:
    """(doc_id, key, text) of the segments of all texts of ``width`` bytes or more."""
    n = F.octet_length("text")
    binary = F.col("text").cast("binary")
    cut = lambda i: F.struct(i.alias("seg"), F.when(n <= SEGMENT, binary).otherwise(F.substring(binary, i * SEGMENT + 1, F.lit(SEGMENT + width - 1))).alias("text"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((n - width) / SEGMENT).cast("int")), cut)
    rows = texts.where(n >= width).select("doc_id", key.alias("of"), F.explode(parts).alias("part"))
    return rows.select("doc_id", _segment_key(F.col("of"), F.col("part.seg")).alias("key"), F.col("part.text").alias("text"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans, kept.

    ``spans`` are the ascending removed ranges (start, end) of bytes, ``kept`` is the rest: bytes, as a span may cut a character.
    """
    if width < PERIOD + 16:
        raise ValueError(f"width must be at least {PERIOD + 16}")
    spark = docs.sparkSession
    # sizes and copies of all rows come first
    texts = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows, key = _keyed(texts)
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    density = len(difference_cover()) / PERIOD
    buckets = max(partitions(spark), int(total * density) // BUCKET + 1)
    parts = max(partitions(spark), total // GATHER + 1)
    blocks = _segments(texts, key, width).select("key", "text").mapInArrow(_sampled(width, buckets, parts, GROUP), _DEAL)
    blocks = blocks.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    tell = lambda f, parts: lambda batches: f(batches, parts)
    shared = keep(_gather(blocks.mapInArrow(tell(_shared, parts), _REPLIES), parts).select("key", F.col("vals").alias("shared")), "shared-blocks")
    release(spark)
    del blocks
    # who takes part: of equal texts the row of the smallest id, in segments that share a block
    counts = rows.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.max("n_bytes").alias("n_bytes"))
    places = counts.where(F.col("n_bytes") >= width).withColumn("seg", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_bytes") - width) / SEGMENT).cast("int"))))
    places = places.select(F.col("key").alias("of"), "seg", _segment_key(F.col("key"), F.col("seg")).alias("c_key"), "first_id")
    chosen = shared.join(places, F.col("key") == F.col("c_key")).select("key", "of", "seg", "first_id", "shared")
    full = _segments(texts, key, width).withColumnRenamed("key", "t_key")
    taking = full.join(chosen, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("t_key") == F.col("key"))).select("key", "of", "seg", "text", "shared")
    if rows.groupBy("doc_id", "key").count().where("count > 1").take(1):
        taking = taking.dropDuplicates(["key"])
    taking = keep(taking, "participants")
    discard(shared)
    del chosen, full
    release(spark)
    held = taking.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, parts = max(partitions(spark), held // BUCKET + 1), max(partitions(spark), held // GATHER + 1)
    suffixes = taking.select("key", "text", "shared").mapInArrow(_suffixes(width, buckets, parts, SENT), _DEAL).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    replies = keep(_gather(suffixes.mapInArrow(tell(_repeated, parts), _REPLIES), parts), "repeated")
    del suffixes
    release(spark)
    bits = replies.select(F.col("key").alias("r_key"), "buckets", "sizes", F.col("vals").alias("bits"))
    joined = taking.join(bits, F.col("key") == F.col("r_key")).select("of", "seg", "text", "shared", "buckets", "sizes", "bits")
    marks = joined.mapInArrow(_marked(width, buckets, SEGMENT), f"key long, spans {_SPANS}").where("size(spans) > 0")
    # a text's segments meet here
    marks = keep(marks.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")), "marks")
    discard(taking, replies)
    # a table of its own, so that the join with the rows may split a key that many rows share
    verdict = keep(counts.select("key", "copies").join(marks, "key", "left").where("copies > 1 or spans is not null"), "verdicts")
    discard(marks)
    every = texts.select("doc_id", key.alias("key"), F.octet_length("text").cast("long").alias("n_bytes"), F.col("text").cast("binary").alias("text"))
    sifted = sieve(every, "key", verdict.select("key"))
    none = F.array().cast(_SPANS)
    hit = sifted.where("g_hit").join(verdict, "key", "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= width)
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    hit = hit.select("doc_id", "n_bytes", F.when(whole, all_of_it).otherwise(F.coalesce("spans", none)).alias("spans"), "text")
    kind = hit.schema["doc_id"].dataType.simpleString()
    hit = hit.mapInArrow(_cut, f"doc_id {kind}, n_bytes long, spans {_SPANS}, kept binary")
    return sifted.where("not g_hit").select("doc_id", "n_bytes", none.alias("spans"), F.col("text").alias("kept")).unionByName(hit)

"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's features describe the line itself, the lines before and after it and how it fits into
the document: shares of character classes, word shape and repetition, differences to its neighbours. Weights tie
features to a line's label and neighbouring labels to each other. Labels exist for documents only: a first model
takes each line by itself under its document's label; lines that it finds on the other side change theirs, the surest
first and up to half of the document's bytes, and the chain is trained on what results. So good lines in bad documents, and the
places where good and bad meet, are what the chain learns its transitions from. A document's quality is the mean of its lines' forward-backward marginals, weighted
by length, put through a logistic curve fitted on documents that the chain was not trained on; the curve's
score is that of a good document if both classes were as frequent.

Training reads at most SAMPLE labelled documents of each class, chosen by a seeded hash of the id, with all their lines, in
runs of RUN neighbouring ones; everything else covers all rows, all lines and whole texts. A text longer than CHUNK is
taken piece by piece, with what earlier pieces had in memory, to the same result.

* A null or empty text is one empty line. A text without line breaks is one line; lines longer than SPAN bytes
  count as several of at most SPAN bytes, so that a long text without breaks still has neighbours.
* Labels that are null or of null ids are ignored; an id labelled twice counts as good only if all labels say so.
* With no labelled document of one class every score is that of the other class (1 without any label).
* Repeated rows get equal scores; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, pick, remainder
from .toxicity import logistic

SAMPLE, RUN, SEED = 1500, 64, 13
BAR, HELD = 0.7, (4, 2)
#: Bytes of the longest line, bytes of text whose features are computed at once.
SPAN, CHUNK = 1000, 4 << 20
STEPS, RATE, RIDGE = (200, 220), 0.08, 1e-3
#: Lines whose features are joined with their neighbours' at once.
ROWS = 1 << 15

#: Classes of bytes: lower, upper, digit, space, end of sentence, other ASCII punctuation, parts of other letters.
_CLASS = np.full(256, 5, np.uint8)
_CLASS[[*range(97, 123)]] = 0
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(48, 58)]] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[44, 46]] = 4
_CLASS[128:] = 6
CLASSES = 7
_SPREAD = np.random.default_rng(99).integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)


def lines_of(data: np.ndarray) -> np.ndarray:
    """Where the lines of a text start; none is longer than SPAN bytes."""
    starts = np.r_[0, np.flatnonzero(data[:-1] == 10) + 1] if len(data) else np.zeros(1, np.int64)
    sizes = np.diff(np.r_[starts, len(data)])
    parts = np.maximum(1, -(-sizes // SPAN))
    if (parts > 1).any():
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.repeat(starts, parts) + within * SPAN
    return starts


class Met:
    """Words and lines that earlier pieces of a text had, as sorted arrays."""

    def __init__(self):
        self.words = np.empty(0, np.uint64)
        self.lines = np.empty(0, np.uint64)

    @staticmethod
    def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
        at = np.searchsorted(known, values)
        return (at < len(known)) & (known[np.minimum(at, max(len(known) - 1, 0))] == values) if len(known) else np.zeros(len(values), bool)

    def had(self, words: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which were there before; from now on all of them were."""
        found = self._among(words, self.words), self._among(lines, self.lines)
        self.words, self.lines = np.union1d(self.words, words), np.union1d(self.lines, lines)
        return found


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, line lengths, lines of each text) of several texts, without neighbours."""
    if len(texts) == 1 and len(texts[0]) > CHUNK:
        return _by_pieces(texts[0])
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    base = np.r_[0, np.cumsum(sizes)[:-1]]
    starts = [lines_of(data[b : b + n]) + b for b, n in zip(base.tolist(), sizes.tolist())]
    many = np.array([len(s) for s in starts])
    own, n = _features(data, np.concatenate(starts), np.repeat(np.arange(len(texts)), many))
    return own, n, many


def _by_pieces(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(text, np.uint8)
    starts = lines_of(data)
    cuts = np.unique(np.searchsorted(starts, np.arange(0, len(data), CHUNK), side="left"))
    ends, met, parts = [*cuts[1:].tolist(), len(starts)], Met(), []
    for i, j in zip(cuts.tolist(), ends):
        if i < j:
            low, high = int(starts[i]), int(starts[j]) if j < len(starts) else len(data)
            parts.append(_features(data[low:high], starts[i:j] - low, np.zeros(j - i, np.int64), met))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.array([len(starts)])


def _features(data: np.ndarray, starts: np.ndarray, doc: np.ndarray, met: Met | None = None) -> tuple[np.ndarray, np.ndarray]:
    ends = np.r_[starts[1:], len(data)]
    n = (ends - starts).astype(np.float64)
    line_of = np.repeat(np.arange(len(starts)), ends - starts)
    kind = _CLASS[data]
    shares = np.stack([np.bincount(line_of[kind == c], minlength=len(starts)) for c in range(CLASSES)], axis=1) / np.maximum(n, 1)[:, None]
    # words: runs of anything but white space, cut at line starts
    solid = kind != 3
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = starts[(starts < len(data)) & (ends > starts)]
    first[inner] |= solid[inner]
    at = np.flatnonzero(first)
    if len(at):
        place = np.arange(len(data))
        in_word = place - np.maximum.accumulate(np.where(first, place, 0))
        hashes = (data.astype(np.uint64) + np.uint64(1)) * _SPREAD[np.minimum(in_word, 63)] * solid
        words = np.add.reduceat(hashes, at)
        length = np.add.reduceat(solid.astype(np.int64), at)
    else:
        words, length = np.empty(0, np.uint64), np.empty(0, np.int64)
    of = line_of[at]
    count = np.bincount(of, minlength=len(starts)).astype(np.float64)
    some = np.maximum(count, 1)
    mean = lambda x: np.bincount(of, weights=x, minlength=len(starts)) / some
    same = np.zeros(len(at))
    same[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((words, doc[of]))
    w, d = words[order], doc[of][order]
    seen = np.zeros(len(at))
    again = (w[1:] == w[:-1]) & (d[1:] == d[:-1])
    seen[order[1:][again]] = 1
    odd = np.zeros(len(at))
    if len(at):
        last = at + length - 1
        odd = (_CLASS[data[last]] == 5).astype(np.float64)
    lone = (length == 1) & (_CLASS[data[at]] == 5) if len(at) else np.empty(0)
    long_word = mean(length.astype(np.float64))
    spread = np.sqrt(np.maximum(0, mean(length.astype(np.float64) ** 2) - long_word**2))
    # lines that the text has had before
    total = np.bincount(of, weights=(words % np.uint64(1 << 40)).astype(np.float64), minlength=len(starts))
    order = np.lexsort((total, n, doc))
    copy = np.zeros(len(starts))
    copy[order[1:]] = (total[order[1:]] == total[order[:-1]]) & (n[order[1:]] == n[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]]) & (n[order[1:]] > 1)
    if met is not None:
        line = total.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ n.astype(np.uint64)
        old_words, old_lines = met.had(words, line)
        seen[old_words] = 1
        copy[old_lines & (n > 1)] = 1
    own = np.column_stack([shares, np.log1p(n) / 5, np.log1p(count) / 4, np.minimum(long_word, 30) / 10, np.minimum(spread, 30) / 10, mean(same), mean(seen), mean(odd), mean(lone), copy, count == 0, (n > 0) & (n < 20)])
    return own, n


def with_neighbours(own: np.ndarray, many: np.ndarray, lines: slice = slice(None)) -> np.ndarray:
    """Add each line's neighbours' features and how far it is from their mean; at a border the line stands for them."""
    ends = np.cumsum(many)
    place = np.arange(len(own))[lines]
    firsts, lasts = np.zeros(len(own), bool), np.zeros(len(own), bool)
    firsts[ends - many] = lasts[ends - 1] = True
    first, last = firsts[lines], lasts[lines]
    self = own[lines]
    mean = (own[np.where(first, place, place - 1)] + own[np.where(last, place, place + 1)]) / 2
    edge = np.column_stack([first, last, first & last]).astype(float)
    return np.concatenate([self, mean, np.abs(self - mean), edge, np.ones((len(place), 1))], axis=1)


@dataclass
class Chain:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of a line's features for good against bad
    steps: np.ndarray  # 2 x 2 of neighbouring labels
    curve: tuple[float, float] = (0.0, 1.0)
    constant: float | None = None

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.centre) / self.scale) @ self.weights

    def marginals(self, emission: np.ndarray, many: np.ndarray) -> np.ndarray:
        """P(good) of each line by forward-backward over all texts at once, line by line of the longest."""
        return forward_backward(emission, many, self.steps)[0]

    def logits(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty(len(texts))
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= CHUNK):
                size += len(texts[to])
                to += 1
            own, n, many = line_features(texts[at:to])
            emission = [self.emissions(with_neighbours(own, many, slice(k, k + ROWS))) for k in range(0, len(own), ROWS)]
            good = self.marginals(np.concatenate(emission), many)
            out[at:to] = weighted(good, n, many)
            at = to
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * self.logits(texts), -50, 50)))


def weighted(good: np.ndarray, n: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Log-odds of the length-weighted mean of the lines' marginals."""
    doc = np.repeat(np.arange(len(many)), many)
    size = n + 1  # empty lines count a little
    mean = np.bincount(doc, good * size, len(many)) / np.bincount(doc, size, len(many))
    mean = np.clip(mean, 1e-4, 1 - 1e-4)
    return np.log(mean / (1 - mean))


def forward_backward(emission: np.ndarray, many: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of good, log partition of each text, and expected counts of label pairs (summed).

    Texts are sorted by their number of lines, so that step k works on a prefix of them.
    """
    order = np.argsort(-many, kind="stable")
    sizes = many[order]
    first = (np.cumsum(many) - many)[order]
    longest = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(longest), side="left")  # texts with more than k lines
    score = np.zeros((len(emission), 2))
    score[:, 1] = emission
    alpha, beta = np.zeros_like(score), np.zeros_like(score)
    for k in range(longest):
        i = first[: alive[k]] + k
        alpha[i] = score[i]
        if k:
            p = alpha[i - 1][:, :, None] + steps
            top = p.max(axis=1)
            alpha[i] += top + np.log(np.exp(p - top[:, None, :]).sum(axis=1))
    for k in range(longest - 2, -1, -1):
        i = first[: alive[k + 1]] + k
        p = (score[i + 1] + beta[i + 1])[:, None, :] + steps
        top = p.max(axis=2)
        beta[i] = top + np.log(np.exp(p - top[:, :, None]).sum(axis=2))
    ends = (np.cumsum(many) - 1)[order]
    top = alpha[ends].max(axis=1)
    log_z = np.empty(len(many))
    log_z[order] = top + np.log(np.exp(alpha[ends] - top[:, None]).sum(axis=1))
    both = alpha + beta - np.repeat(log_z, many)[:, None]
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -60, 60)))
    inner = np.ones(len(emission), bool)
    inner[np.cumsum(many) - many] = False
    j = np.flatnonzero(inner)
    pair = alpha[j - 1][:, :, None] + steps + (score[j] + beta[j])[:, None, :] - np.repeat(log_z, many)[j][:, None, None]
    return good, log_z, np.exp(pair).sum(axis=0)


def _scaled(features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    centre, scale = features.mean(axis=0), features.std(axis=0)
    centre[-1], scale[scale < 1e-6] = 0.0, 1.0
    return centre, scale


def _descend(gradient: Callable[[np.ndarray], np.ndarray], x: np.ndarray, steps: int) -> np.ndarray:
    """Adam."""
    m1, m2 = np.zeros(len(x)), np.zeros(len(x))
    for t in range(1, steps + 1):
        g = gradient(x)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        x = x - RATE * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    return x


def alone(features: np.ndarray, y: np.ndarray) -> Chain:
    """A chain without transitions: each line by itself, both classes of the same weight."""
    centre, scale = _scaled(features)
    z = (features - centre) / scale
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    w = _descend(lambda w: z.T @ (weight * (1 / (1 + np.exp(-np.clip(z @ w, -30, 30))) - y)) + RIDGE * w, np.zeros(z.shape[1]), STEPS[0])
    return Chain(centre, scale, w, np.zeros((2, 2)))


def train(features: np.ndarray, many: np.ndarray, y: np.ndarray) -> Chain:
    """Maximum likelihood of line labels y with a ridge."""
    centre, scale = _scaled(features)
    z = (features - centre) / scale
    inner = np.ones(len(z), bool)
    inner[np.cumsum(many) - many] = False
    j = np.flatnonzero(inner)
    told = np.zeros((2, 2))
    np.add.at(told, (y[j - 1].astype(int), y[j].astype(int)), 1)

    def gradient(x: np.ndarray) -> np.ndarray:
        good, _, pairs = forward_backward(z @ x[:-4], many, x[-4:].reshape(2, 2))
        return np.r_[z.T @ (good - y) / len(z), ((pairs - told) / max(len(j), 1)).ravel()] + RIDGE * x

    x = _descend(gradient, np.zeros(z.shape[1] + 4), STEPS[1])
    return Chain(centre, scale, x[:-4], x[-4:].reshape(2, 2))


def runs_of(many: np.ndarray, run: int | None = None) -> np.ndarray:
    """Texts of so many lines, cut into runs of neighbouring lines: the runs' lengths."""
    run = run or RUN
    parts = -(-many // run)
    out = np.full(parts.sum(), run)
    out[np.cumsum(parts) - 1] = many - (parts - 1) * run
    return out


def told_lines(emission: np.ndarray, n: np.ndarray, many: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Line labels under document labels: lines that look like the other class by themselves change sides, the surest
    first, until half of a document's bytes have."""
    doc = np.repeat(np.arange(len(many)), many)
    y = labels[doc].astype(float)
    against = np.where(y == 1, -emission, emission)
    order = np.lexsort((-against, doc))
    size = (n + 1)[order]
    gone = np.cumsum(size)
    gone -= np.repeat((gone - size)[np.cumsum(many) - many], many)
    ok = (against[order] > 0) & (2 * gone <= np.bincount(doc, n + 1, len(many))[doc[order]])
    y[order[ok]] = 1 - y[order[ok]]
    return y


def trained(features: np.ndarray, n: np.ndarray, many: np.ndarray, labels: np.ndarray) -> Chain:
    """A chain from document labels, by way of line labels."""
    first = alone(features, np.repeat(labels, many).astype(float))
    return train(features, runs_of(many), told_lines(first.emissions(features), n, many, labels))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held: tuple[int, int] = HELD, sample: int = SAMPLE) -> Chain:
    own = pick(labels, doc_id=id_col, y=label_col).where("doc_id is not null and y is not null")
    own = own.where(remainder(F.col("doc_id"), held[0]) != held[1]).groupBy("doc_id").agg(F.min("y").cast("int").alias("y")).withColumn("h", F.xxhash64("doc_id", F.lit(SEED)))
    chosen = keep(own.where("y = 0").orderBy("h", "doc_id").limit(sample).unionByName(own.where("y = 1").orderBy("h", "doc_id").limit(sample)), "labelled")
    # at most 2 SAMPLE ids are broadcast
    texts = pick(docs, doc_id=id_col, text=text_col).join(F.broadcast(chosen), "doc_id")
    texts = keep(texts.select("h", "y", "text"), "labelled-texts")

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for h, y, text in zip(b["h"], b["y"], b["text"]):
                x, n, many = line_features([(text or "").encode("utf-8", "replace")])
                rows.append((h, y, with_neighbours(x, many).astype(np.float32).tobytes(), n.tolist()))
            yield pd.DataFrame(rows, columns=["h", "y", "x", "n"])

    rows = texts.mapInPandas(featured, "h long, y int, x binary, n array<double>").collect()
    rows.sort(key=lambda r: (r["h"], r["y"], bytes(r["x"])))
    y = np.array([r["y"] for r in rows], int)
    none = Chain(np.zeros(1), np.ones(1), np.zeros(1), np.zeros((2, 2)))
    if min((y == 0).sum(), (y == 1).sum()) < 4:
        none.constant = 0.0 if len(y) and not y.any() else 1.0
        return none
    many = np.array([len(r["n"]) for r in rows])
    x = np.concatenate([np.frombuffer(r["x"], np.float32).reshape(len(r["n"]), -1) for r in rows]).astype(np.float64)
    n = np.concatenate([r["n"] for r in rows])
    # the curve comes from chains that have not seen a document: two halves, each scored by the other's chain
    half = np.arange(len(rows)) % 2
    logits = np.empty(len(rows))
    for h in (0, 1):
        part = np.repeat(half, many) == h
        chain = trained(x[~part], n[~part], many[half != h], y[half != h])
        logits[half == h] = weighted(chain.marginals(chain.emissions(x[part]), many[half == h]), n[part], many[half == h])
    chain = trained(x, n, many, y)
    chain.curve = logistic(logits, y.astype(float), np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())))
    return chain


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    chain = fit(docs, labels, id_col, text_col, label_col)

    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(chain.scores([(t or "").encode("utf-8", "replace") for t in texts]))

    rows = pick(docs, doc_id=id_col, text=text_col)
    rows = rows.select("doc_id", (remainder(F.col("doc_id"), HELD[0]) == HELD[1]).alias("held_out"), F.pandas_udf(scored, "double")("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= BAR).cast("int"))

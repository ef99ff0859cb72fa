"""Toxicity by maximum-scoring segments over token log-odds, calibrated by extreme-value statistics.

Tokens are runs of letters, lower-cased. A token's log-odds are those of an occurrence in a toxic against one in a clean
document, under a hierarchical Dirichlet (here Beta) prior: a stem (a token's first four letters) is shrunk towards the
classes' shares of all tokens, a token towards its stem, so an inflection never seen scores as its stem does. A constant
drift is taken off each token, and one linear scan (Ruzzo and Tompa) over all occurrences finds all maximal-scoring
segments of a text. Occurrences of one token within one segment are not independent: n of them add sqrt(n) times its
score to the segment's; other segments don't matter. Karlin-Altschul
statistics under the clean documents' scores turn a segment's score S in a text of m tokens into
``lambda S - ln(K m)``, minus the logarithm of its expected number; the values of significant segments add up to the
document's evidence, and a logistic curve makes it a score: that of toxicity if both classes were as frequent. The
curve is fitted on scores from log-odds of the other half of the labelled documents.

Fitting reads at most SAMPLE labelled documents of each class, chosen by a seeded hash of the id; everything else covers
all rows and whole texts.

* Null and empty texts have no segment and get the curve's value for no evidence.
* Labels that are null or of null ids are ignored; an id labelled twice counts as toxic if any label says so.
* With no labelled document of one class every score is that of the other class (0 without any label).
* Repeated rows get equal scores; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, numbered, pick, pieces, remainder

#: Labelled documents read of each class at most, and the seed of their choice.
SAMPLE, SEED = 5000, 5
#: Letters of a stem, strengths of the two priors, drift per token, and the least documents a token or stem must occur in.
STEM, STEM_PRIOR, WORD_PRIOR, DRIFT, LEAST = 4, 8.0, 8.0, 0.5, 2
#: Tokens and stems whose log-odds are smaller than this carry no evidence.
FAINT = 0.8
#: A segment is significant if fewer than this many of its score are expected in a clean text of that length.
EXPECTED = 0.05
BAR, HELD = 0.7, (3, 1)

_WORDS = re.compile(r"[^\W\d_]+")
_CACHE = 150_000
#: Tokens of a piece of a text from which on only the scoring ones are kept in memory.
LONG = 100_000


def tokens(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def placed(scores: list[float]) -> list[tuple[int, int, float]]:
    """(first place, end, score) of all maximal-scoring segments (Ruzzo and Tompa), in one pass."""
    left: list[float] = []  # running total before each candidate
    right: list[float] = []  # running total at its end
    lower: list[int] = []  # the nearest earlier candidate that starts from a lower total
    first: list[int] = []
    end: list[int] = []
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        start, total, place = total, total + s, i
        k = len(left) - 1
        while True:
            while k >= 0 and left[k] >= start:
                k = lower[k]
            if k < 0 or right[k] >= total:
                break
            start, below, place = left[k], lower[k], first[k]
            del left[k:], right[k:], lower[k:], first[k:], end[k:]
            k = below
        left.append(start)
        right.append(total)
        lower.append(k)
        first.append(place)
        end.append(i + 1)
    return [(i, j, b - a) for i, j, a, b in zip(first, end, left, right)]


def segments(scores: list[float]) -> list[float]:
    """Scores of all maximal-scoring segments."""
    return [s for _, _, s in placed(scores)]


def damped(words: list[str], scores: list[float], i: int, j: int, score: float) -> float:
    """A segment's score when n occurrences of a token in it add sqrt(n) times the token's score."""
    times: dict[str, int] = {}
    for w, s in zip(words[i:j], scores[i:j]):
        if s > 0:
            n = times[w] = times.get(w, 0) + 1
            score -= s * (1 - math.sqrt(n) + math.sqrt(n - 1))
    return score


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0
    log_k: float = 0.0
    curve: tuple[float, float] = (0.0, 0.0)
    constant: float | None = None
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def weight(self, token: str) -> float:
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= _CACHE:
                self.known.clear()
            found = self.words.get(token)
            found = self.known[token] = (self.stems.get(token[:STEM], 0.0) if found is None else found) - DRIFT
        return found

    def scan(self, text: str | None) -> tuple[int, list[float], list[float]]:
        """Number of tokens, their scores, and the damped scores of the maximal segments."""
        words: list[str] = []
        scores: list[float] = []
        for piece in pieces(text or "", " "):
            own = tokens(piece)
            weights = list(map(self.known.get, own))
            if None in weights:
                weights = [self.weight(w) for w in own]
            # only tokens of a positive score are looked at again
            words += own if len(own) < LONG else [w if s > 0 else "" for w, s in zip(own, weights)]
            scores += weights
        if not scores or max(scores) <= 0:
            return len(words), scores, []
        return len(words), scores, [damped(words, scores, *found) for found in placed(scores)]

    def passages(self, text: str | None) -> list[tuple[int, int, float]]:
        """(first, end, value) of each significant segment, in code points of the lower-cased text."""
        if self.constant is not None:
            return []
        found = list(_WORDS.finditer((text or "").lower()))
        words = [f.group() for f in found]
        scores = [self.weight(w) for w in words]
        least = self.log_k + math.log(max(len(words), 1) / EXPECTED)
        values = [(i, j, self.rate * damped(words, scores, i, j, s) - least) for i, j, s in placed(scores)]
        return [(found[i].start(), found[j - 1].end(), v) for i, j, v in values if v > 0]

    def evidence(self, m: int, found: list[float]) -> float:
        least = self.log_k + math.log(max(m, 1) / EXPECTED)
        return math.log1p(sum(max(0.0, self.rate * s - least) for s in found))

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        m, _, found = self.scan(text)
        a, b = self.curve
        return 1.0 / (1.0 + math.exp(-min(50.0, max(-50.0, a + b * self.evidence(m, found)))))


def log_odds(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> tuple[dict[str, float], dict[str, float]]:
    """(token or "^" + stem, times in toxic, in clean documents), tokens of both classes -> weights of tokens and of stems."""
    toxic, clean = max(toxic, 1), max(clean, 1)
    base = math.log(toxic / clean)
    share = toxic / (toxic + clean)
    stem_share, stems, words = {}, {}, {}
    for name, t, c in counts:
        if name[0] == "^":
            p = stem_share[name[1:]] = (t + STEM_PRIOR * share) / (t + c + STEM_PRIOR)
            w = math.log(p / (1 - p)) - base
            if abs(w) >= FAINT:
                stems[name[1:]] = w
    for name, t, c in counts:
        if name[0] != "^":
            p = stem_share.get(name[:STEM], share)
            w = math.log((t + WORD_PRIOR * p) / (c + WORD_PRIOR * (1 - p))) - base
            if abs(w) >= FAINT:
                words[name] = w
            elif name[:STEM] in stems:
                words[name] = 0.0
    return words, stems


def karlin(values: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of sum p(s) exp(rate s) = 1 for scores of negative mean."""
    p = counts / counts.sum()
    if not (values > 0).any():
        return 1.0
    low, high = 0.0, 1.0
    f = lambda r: float((p * np.exp(np.minimum(r * values, 700))).sum()) - 1
    while f(high) < 0 and high < 64:
        high *= 2
    low = 1e-6
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return max(high, 1e-3)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Intercept and slope by Newton steps with a small ridge."""
    z = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        h = z.T @ (z * (weight * p * (1 - p))[:, None]) + ridge * np.eye(2)
        step = np.linalg.solve(h, z.T @ (weight * (y - p)) - ridge * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(max(b[1], 0.0))


def _sampled(labels: DataFrame, id_col: str, label_col: str, held: tuple[int, int], sample: int) -> DataFrame:
    own = pick(labels, doc_id=id_col, y=label_col).where("doc_id is not null and y is not null")
    own = own.where(remainder(F.col("doc_id"), held[0]) != held[1]).groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    own = own.withColumn("h", F.xxhash64("doc_id", F.lit(SEED)))
    parts = [own.where(F.col("y") == y).orderBy("h", "doc_id").limit(sample) for y in (0, 1)]
    return keep(parts[0].unionByName(parts[1]), "labelled")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held: tuple[int, int] = HELD, sample: int = SAMPLE) -> Model:
    chosen = _sampled(labels, id_col, label_col, held, sample)
    half = F.pmod(F.col("h"), F.lit(2)).cast("int")
    # at most 2 SAMPLE ids are broadcast
    texts = pick(docs, doc_id=id_col, text=text_col).join(F.broadcast(chosen.select("doc_id", "y", half.alias("half"))), "doc_id")
    texts = keep(texts.select("y", "half", "text"), "labelled-texts")
    size = {(r["half"], r["y"]): r["n"] for r in texts.groupBy("half", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not all(size.get((h, y)) for h in (0, 1) for y in (0, 1)):
        toxic, clean = (sum(size.get((h, y), 0) for h in (0, 1)) for y in (1, 0))
        return Model(constant=1.0 if toxic and not clean else 0.0)

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for y, half, text in zip(b["y"], b["half"], b["text"]):
                words = Counter(tokens(text))
                stems: Counter[str] = Counter()
                for w, n in words.items():
                    stems["^" + w[:STEM]] += n
                # the bare "^" has the number of tokens
                out += [(y, half, name, n) for name, n in (*words.items(), *stems.items(), ("^", words.total()))]
            yield pd.DataFrame(out, columns=["y", "half", "name", "n"])

    cells = [(h, y) for h in (0, 1) for y in (1, 0)]
    own = lambda h, y, n: F.sum(F.when((F.col("half") == h) & (F.col("y") == y), n).otherwise(0))
    counted = texts.select("y", "half", "text").mapInPandas(named, "y int, half int, name string, n long").groupBy("name")
    counted = counted.agg(*[own(h, y, F.col("n")).alias(f"n{h}{y}") for h, y in cells], *[own(h, y, 1).alias(f"d{h}{y}") for h, y in cells])
    often = counted.where(f"name = '^' or d01 + d11 >= {LEAST} or d00 + d10 >= {LEAST}")
    counts = [tuple(r) for r in often.select("name", *[f"n{h}{y}" for h, y in cells]).collect()]
    size = dict(zip(cells, next(c[1:] for c in counts if c[0] == "^")))
    counts = [c for c in counts if c[0] != "^"]
    # the curve is fitted on scores of documents that the log-odds behind them have not seen
    folds = [Model(*log_odds([(n, *(c[2:] if h else c[:2])) for n, *c in counts], size[h, 1], size[h, 0])) for h in (0, 1)]
    model = Model(*log_odds([(n, c[0] + c[2], c[1] + c[3]) for n, *c in counts], size[0, 1] + size[1, 1], size[0, 0] + size[1, 0]))

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for y, half, text in zip(b["y"], b["half"], b["text"]):
                m, scores, found = folds[1 - half].scan(text)
                values, n = np.unique(np.round(np.array(scores, float), 2), return_counts=True)
                out.append((y, m, found, values.tolist(), n.tolist()))
            yield pd.DataFrame(out, columns=["y", "m", "found", "values", "counts"])

    second = texts.select("y", "half", "text").mapInPandas(scanned, "y int, m long, found array<double>, values array<double>, counts array<long>")
    second = keep(second, "scanned")
    flat = second.where("y = 0").select(F.explode(F.arrays_zip("values", "counts")).alias("x")).groupBy("x.values").agg(F.sum("x.counts").alias("n")).collect()
    if flat:
        model.rate = karlin(np.array([r[0] for r in flat]), np.array([r[1] for r in flat], float))
    rows = [(r["y"], r["m"], list(r["found"])) for r in second.select("y", "m", "found").collect()]
    # K from the number of clean segments above a level: E = K m exp(-rate S)
    clean = [(m, found) for y, m, found in rows if y == 0]
    every = sorted((model.rate * s for _, found in clean for s in found), reverse=True)
    tokens_read = sum(m for m, _ in clean) or 1
    level = every[: max(1, len(every) // 10)][-1] if every else 0.0
    model.log_k = math.log(max(1, len(every) // 10) / tokens_read) + level
    y = np.array([r[0] for r in rows], float)
    x = np.array([model.evidence(m, found) for _, m, found in rows])
    model.curve = logistic(x, y, np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())))
    model.known = {}
    return model


def _scorer(model: Model):
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(model.score, na_action=None).astype(float)

    return score


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, id_col, text_col, label_col)
    rows = pick(docs, doc_id=id_col, text=text_col)
    rows = rows.select("doc_id", (remainder(F.col("doc_id"), HELD[0]) == HELD[1]).alias("held_out"), _scorer(model)("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= BAR).cast("int"))


def passages(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per input row: doc_id, passages: start, end and value of every significant toxic passage.

    Places count code points of the lower-cased text; a document's evidence is the logarithm of one and the values' sum.
    """
    model = fit(docs, labels, id_col, text_col, label_col)

    @F.pandas_udf("array<struct<start: int, end: int, value: double>>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": i, "end": j, "value": v} for i, j, v in model.passages(t)], na_action=None)

    return pick(docs, doc_id=id_col, text=text_col).select("doc_id", found("text").alias("passages"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that score below the bar, with all their columns."""
    model = fit(docs, labels, id_col, text_col)
    flat, at = numbered(docs)
    return flat.where(_scorer(model)(F.col(at[text_col])) < BAR).toDF(*docs.columns)

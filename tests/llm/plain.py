"""Plain versions that the operators are compared with: loops over Python values, nothing of the operators' own search."""

import math
import re
from collections import Counter

from gleaner.llm import mixing, toxicity

from .test_exact_and_near import plain_print

SPACES = r"[\x20\x09-\x0D]"


def best_segments(scores):
    """(start, end) of the best segment, then of the best ones left and right of it."""
    best, at = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-12:
                best, at = total, (i, j + 1)
    if at is None:
        return []
    i, j = at
    return best_segments(scores[:i]) + [at] + [(a + j, b + j) for a, b in best_segments(scores[j:])]


def toxic_score(model, text):
    """A document's score from the model's weights, its rate and level, and its curve."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    own = [model.words[w] if w in model.words else model.stems.get(w[: toxicity.STEM], 0.0) for w in words]
    own = [s - toxicity.DRIFT for s in own]
    total = 0.0
    for i, j in best_segments(own):
        times = Counter(w for w, s in zip(words[i:j], own[i:j]) if s > 0)
        score = sum(s for s in own[i:j] if s <= 0) + sum(math.sqrt(n) * next(s for v, s in zip(words[i:j], own[i:j]) if v == w) for w, n in times.items())
        total += max(0.0, model.rate * score - model.log_k - math.log(len(words) / toxicity.EXPECTED))
    a, b = model.curve
    return 1 / (1 + math.exp(-(a + b * math.log1p(total))))


def odds(texts):
    """(toxic, text) -> weights of tokens and stems by their occurrences."""
    counts = {y: Counter(w for t, text in texts if t == y for w in re.findall(r"[^\W\d_]+", (text or "").lower())) for y in (0, 1)}
    documents = {y: Counter(w for t, text in texts if t == y for w in set(re.findall(r"[^\W\d_]+", (text or "").lower()))) for y in (0, 1)}
    size = {y: sum(counts[y].values()) for y in (0, 1)}
    share, base = size[1] / (size[0] + size[1]), math.log(size[1] / size[0])
    return counts, documents, share, base


def survivors(rows):
    """(doc_id, text) of unique ids -> what exact and near dedup leave, in two steps: sets of ids."""
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(SPACES, "", t or ""), []).append((-len(t or ""), i))
    once = {min(g)[1] for g in groups.values()}
    left = [(i, plain_print(t)) for i, t in rows if i in once]
    comp = {i: i for i, _ in left}
    changed = True
    while changed:
        changed = False
        for i, p in left:
            for j, q in left:
                if bin(p ^ q).count("1") <= 2 and comp[j] < comp[i]:
                    comp[i], changed = comp[j], True
    return once, set(comp.values())


def targets(rows):
    """(source, text) -> quota of each source by the weights 1, 2, 3, repeating."""
    sizes = {}
    for s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: 1 + k % 3 for k, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), set(order), {}
    while free:
        unit = left / sum(weights[s] for s in free)
        full = [s for s in free if weights[s] * unit > mixing.MOST * sizes[s]]
        if not full:
            return out | {s: weights[s] * unit for s in free}
        for s in full:
            out[s] = float(mixing.MOST * sizes[s])
            left -= out[s]
            free.discard(s)
    return out

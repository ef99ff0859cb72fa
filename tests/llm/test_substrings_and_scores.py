import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import common, quality, substrings, toxicity

SCHEMA = "doc_id long, text string, TEXT2 string, n long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


def plain_removal(rows, width):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + width] for b in texts for i in range(len(b) - width + 1))
    out = []
    for (i, _), b in zip(rows, texts):
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] > 1:
                gone[k + 1 : k + 1 + width] = True
        own = gone[1:-1]
        left = bytes(x for x, g in zip(b, own) if not g)
        out.append((i, len(b), int(own.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def test_difference_cover():
    d = substrings.difference_cover()
    assert len(d) == substrings.ORDER + 1
    assert Counter(((d[:, None] - d) % substrings.PERIOD).ravel().tolist()) == {0: len(d), **dict.fromkeys(range(1, substrings.PERIOD), 1)}


@pytest.mark.parametrize("width, segment, clash", [(400, 16 << 20, False), (300, 16 << 20, True), (400, 700, False)])
def test_removal(spark, monkeypatch, width, segment, clash):
    """Against a plain version; also with texts cut into segments, and where most texts have one key."""
    monkeypatch.setattr(substrings, "GROUP", 4000)
    monkeypatch.setattr(substrings, "SENT", 1000)
    monkeypatch.setattr(substrings, "SEGMENT", segment)
    if clash:
        real = substrings.text_key
        monkeypatch.setattr(substrings, "text_key", lambda seed: real(seed) if seed != 7 else F.pmod(real(seed), F.lit(3)))
    rng = np.random.default_rng(0)
    text = lambda n: "".join(rng.choice(list("abcdé \n"), n))
    x, y = text(900), text(2000)
    rows = [(0, x[:500] + "zz" + x[500:]), (1, "q" + x[100:505]), (2, x[100:500]), (3, x[100:499]), (4, None), (5, ""), (6, "a" * 401), (7, "a" * 400), (8, "b" * 400)]
    rows += [(9, x[300:720] + "kk" + x[300:720]), (10, text(450) * 2), (11, "ab" * 205), (None, "null id " + x[:450]), (12, "dup" * 200), (12, "dup" * 200)]
    rows += [(20 + i, text(int(rng.integers(0, 900))) + y[int(rng.integers(0, 900)) : int(rng.integers(900, 2000))] + text(50)) for i in range(40)]
    rows += [(100 + i, y) for i in range(30)] + [(200, text(30_000)), (201, y * 6)]
    got = substrings.remove(docs(spark, rows).repartition(3), width=width).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_removal(rows, width)


def test_prefixes():
    """Both fingerprints depend on the string alone, and ties of the first are settled by the rest."""
    rng = np.random.default_rng(3)
    data = rng.integers(0, 4, 3_000_000).astype(np.uint8)
    data[2_500_000:2_500_700] = data[100:800]
    places = np.r_[np.arange(0, 400), np.arange(1_048_000, 1_049_000), np.arange(2_500_000, 2_500_300)]
    found = substrings.prefixes(data, places, 400)
    assert (found[100:400] == found[1400:1700]).all() and len(np.unique(found)) == 1400
    alone = substrings.prefixes(data[1_048_500 : 1_048_900], np.array([0]), 400)
    assert alone[0] == found[400 + 500]
    p, x = substrings.PrimePrints(5), bytes(rng.integers(0, 256, 50, np.uint8))
    plain = sum(int(p.word[b]) * pow(p.base, i, p.PRIME) for i, b in enumerate(x[7:40])) % p.PRIME
    assert p.at(np.frombuffer(x, np.uint8), np.array([7]), 33)[0] == plain
    v = np.array([(5, 1), (5, 2), (4, 9), (5, 1)], substrings.PREFIX)
    order, same = substrings.sorted_prefixes(v)
    assert v[order].tolist() == [(4, 9), (5, 1), (5, 1), (5, 2)] and same.tolist() == [False, False, True, False]


def test_removed_spans_and_kept_text(spark):
    rng = np.random.default_rng(1)
    text = lambda n: "".join(rng.choice(list("abcdé \n"), n))
    x = text(900)
    rows = [(0, x), (1, "q" + x[:500] + "zz" + x[450:] + "é"), (2, "own " + text(600)), (3, None), (4, "b" * 400), (5, "b" * 400), (None, "short"), (7, "short")]
    got = substrings.deduplicated(docs(spark, rows).repartition(2)).collect()
    source = {i: (t or "").encode() for i, t in rows}
    assert sorted(map(str, source)) == sorted(str(r["doc_id"]) for r in got)
    for r in got:
        data, ends = source[r["doc_id"]], [0, *(x for s in r["spans"] for x in s), r["n_bytes"]]
        assert ends == sorted(ends) and r["n_bytes"] == len(data)
        assert bytes(r["kept"]) == b"".join(data[i:j] for i, j in zip(ends[::2], ends[1::2]))
    digests = sorted(((r["doc_id"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in got), key=repr)
    assert digests == [(i, n, sha) for i, _, _, n, sha in plain_removal(rows, 400)]
    assert {r["doc_id"]: bytes(r["kept"]) for r in got}[1] == "qzzé".encode()


def test_removal_of_nothing(spark):
    assert substrings.remove(docs(spark, [])).count() == 0
    got = substrings.remove(docs(spark, [(1, "short"), (2, "short")])).collect()
    assert {tuple(r) for r in got} == {(i, 5, 0, 0, hashlib.sha256(b"short").hexdigest()) for i in (1, 2)}
    with pytest.raises(ValueError):
        substrings.remove(docs(spark, []), width=200)


def plain_segments(scores):
    """The best segment, then the same left and right of it."""
    best, at = 0, None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > best:
                best, at = s, (i, j)
    return [] if at is None else [*plain_segments(scores[: at[0]]), best, *plain_segments(scores[at[1] :])]


def test_segments():
    rng = np.random.default_rng(0)
    for _ in range(200):
        scores = rng.integers(-5, 5, int(rng.integers(0, 25))).tolist()
        # a sum of 0 may end a segment early or not; odd fractions rule ties out
        scores = [s + 1 / (k + 7) / 64 for k, s in enumerate(scores)]
        assert np.allclose(toxicity.segments(scores), plain_segments(scores))
    assert len(toxicity.segments([5.0, -9.0] * 50_000)) == 50_000


def test_all_passages_count():
    words = [a + b for a in "bcdf" for b in "aeu"]
    model = toxicity.Model(dict.fromkeys(words, 2.0), {}, 1.0, -3.0, (-3.0, 2.0))
    gap, bar = ["so"] * 60, lambda m: -3.0 + np.log(m / toxicity.EXPECTED)
    found = lambda t: [s for s in model.scan(" ".join(t))[2] if s > bar(len(t))]
    assert np.allclose(found(words + gap + words), [12 * 1.5] * 2)
    # words met alone before, each too weak by itself, don't hide the passage
    alone = [x for w in words for x in (w, *gap)]
    assert found(alone) == [] and np.allclose(found(alone + words), [12 * 1.5])
    assert model.score(" ".join(alone + words)) > 0.7 > model.score(" ".join(alone))
    once, often = (sum(model.scan(" ".join(["ba"] * n))[2]) for n in (1, 60))
    assert np.isclose(often, once * np.sqrt(60))


def test_passages_and_scores_agree(spark):
    rows, labels = corpus(200)
    rows += [(900, None), (901, "")]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs(spark, rows), table)
    text = dict(rows)
    got = {r["doc_id"]: r["passages"] for r in toxicity.passages(docs(spark, rows), table).collect()}
    assert got[900] == got[901] == [] and sum(map(bool, got.values())) >= 30
    a, b = model.curve
    for i, found in got.items():
        assert np.isclose(1 / (1 + np.exp(-(a + b * np.log1p(sum(p["value"] for p in found))))), model.score(text[i]))
        assert all("zorg" in text[i].lower()[p["start"] : p["end"]] for p in found if i % 5 == 0 and p["value"] > 5)


def test_scans_by_pieces(monkeypatch):
    words = {a + b: 1.5 for a in "bcdf" for b in "aeu"} | {"ba": -1.0}
    rng = np.random.default_rng(0)
    text = " ".join(rng.choice([*words, "so", "Be", "fu\nna"], 700))
    whole = toxicity.Model(dict(words), {}).scan(text)
    monkeypatch.setattr(toxicity, "LONG", 3)
    for piece in (1, 50):
        monkeypatch.setattr(common, "PIECE", piece)
        assert toxicity.Model(dict(words), {}).scan(text) == whole


def test_odds_are_those_of_occurrences(spark):
    line = "all the same words are in both kinds of text here"
    rows = [(i, " ".join([line, *["vex"] * (8 if i % 2 else 1)])) for i in range(80)]
    table = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, rows), table)
    assert model.words["vex"] > 1 and model.words.get("same", 0.0) == 0.0


def corpus(n=400, seed=0):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("aeiourstlnd"), int(rng.integers(2, 7)))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        line = lambda: " ".join(rng.choice(words, int(rng.integers(4, 12)))).capitalize() + "."
        lines = [line() for _ in range(int(rng.integers(2, 9)))]
        toxic, good = i % 5 == 0, i % 3 != 0
        if toxic:
            lines[0] += " you " + " ".join("zorg" + "".join(rng.choice(list("xyz"), 3)) for _ in range(3))
        if not good:
            lines = [re.sub(r"\S+", lambda m: m[0].upper() + "!!", x) for x in lines]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scores(spark, module):
    rows, labels = corpus()
    more = [(None, None), (5000, ""), (5001, "x" * 30_000), (5002, " \n\n \n"), (3, rows[3][1])]
    table = spark.createDataFrame([*labels, (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    got = module.score(docs(spark, rows + more).repartition(3), table).toPandas()
    assert len(got) == len(rows) + len(more) and got["score"].between(0, 1).all()
    assert (got["predicted"] == (got["score"] >= 0.7)).all()
    place = 2 if module is toxicity else 1
    truth = {r[0]: r[place] for r in labels}
    held = got[got["held_out"] & got["doc_id"].isin(list(truth))]
    assert len(held) > 50 and np.mean([truth[i] == p for i, p in zip(held["doc_id"], held["predicted"])]) >= 0.95
    import zlib

    modulus, left = module.HELD
    assert all(h == (zlib.crc32(str(int(i)).encode()) % modulus == left) for i, h in zip(got["doc_id"], got["held_out"]) if i == i)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scores_without_labels(spark, module):
    rows, _ = corpus(20)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = module.score(docs(spark, rows), none).toPandas()
    assert len(got) == 20 and got["score"].nunique() == 1
    assert module.score(docs(spark, []), none).count() == 0


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    many = np.array([3, 1, 4])
    e, steps = rng.standard_normal(8), rng.standard_normal((2, 2))
    good, log_z, pairs = quality.forward_backward(e, many, steps)
    total_pairs, at = np.zeros((2, 2)), 0
    for k, n in enumerate(many):
        own = e[at : at + n]
        z, marg = 0.0, np.zeros(n)
        counts = np.zeros((2, 2))
        for code in range(2**n):
            y = [(code >> i) & 1 for i in range(n)]
            p = np.exp(sum(own[i] * y[i] for i in range(n)) + sum(steps[a, b] for a, b in zip(y, y[1:])))
            z += p
            marg += p * np.array(y)
            for a, b in zip(y, y[1:]):
                counts[a, b] += p
        assert np.allclose(good[at : at + n], marg / z) and np.isclose(log_z[k], np.log(z))
        total_pairs += counts / z
        at += n
    assert np.allclose(pairs, total_pairs)


def test_line_features_do_not_depend_on_the_batch():
    texts = [t.encode() for t in ("", "one line", "a b a b\n\nAB!! 12\n", "x" * 2500, "é\nÉ |", "\n")]
    whole, n, many = quality.line_features(texts)
    alone = [quality.line_features([t])[0] for t in texts]
    assert np.allclose(whole, np.concatenate(alone)) and many.tolist() == [len(a) for a in alone]
    assert many.tolist()[3] == 3 and n.sum() == sum(map(len, texts))


def test_long_texts_by_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    text = "\n".join(" ".join(rng.choice(words, int(rng.integers(0, 30)))) for _ in range(600)).encode() + b"\n" + b"y" * 4000
    chain = quality.Chain(np.zeros(1), np.ones(1), np.zeros(1), np.array([[0.5, 0.1], [0.0, 0.7]]))
    whole, n, many = quality.line_features([text])
    chain.weights = rng.standard_normal(quality.with_neighbours(whole, many).shape[1])
    want = chain.logits([text, b"short"])
    monkeypatch.setattr(quality, "CHUNK", 3000)
    monkeypatch.setattr(quality, "ROWS", 7)
    own, m, count = quality.line_features([text])
    assert np.allclose(own, whole) and np.array_equal(n, m) and count.tolist() == many.tolist()
    assert np.allclose(chain.logits([text, b"short"]), want)


def test_lines_of_a_document_differ():
    """Good lines within bad documents are told good, up to half of the bytes, and the chain learns both transitions."""
    emission = np.array([3.0, -2, -1, 2, 1, 1, -4, -5])
    y = quality.told_lines(emission, np.array([10.0, 10, 10, 10, 10, 1, 10, 10]), np.array([4, 4]), np.array([0, 1]))
    assert y.tolist() == [1, 0, 0, 1, 1, 1, 1, 0]
    assert quality.runs_of(np.array([3, 130, 64]), 64).tolist() == [3, 64, 64, 2, 64]
    rng = np.random.default_rng(2)
    many = np.full(200, 10)
    truth = np.concatenate([np.where(np.arange(10) < 4, 1, 0)[:: 1 if k % 4 == 1 else -1] if d % 2 else np.ones(10) for k, d in enumerate(range(200))])
    labels = np.array([1 - d % 2 for d in range(200)])
    x = np.column_stack([(2 * truth - 1) * 2 + rng.standard_normal(2000), np.ones(2000)])
    chain = quality.trained(x, np.ones(2000), many, labels)
    plain = quality.train(x, many, np.repeat(labels, many).astype(float))
    right = lambda c: ((c.marginals(c.emissions(x), many) > 0.5) == truth).mean()
    good = chain.marginals(chain.emissions(x), many) > 0.5
    assert right(chain) > max(0.9, right(plain)) and chain.steps[0, 0] + chain.steps[1, 1] > chain.steps[0, 1] + chain.steps[1, 0]
    mixed = [i for i in range(200) if 0 < good[10 * i : 10 * i + 10].mean() < 1]
    assert len(mixed) >= 80


def plain_quality(chain, text):
    """A document's score line by line: marginals by sums over all labellings, weighted by length."""
    own, n, many = quality.line_features([text.encode()])
    e = chain.emissions(quality.with_neighbours(own, many))
    z, good = 0.0, np.zeros(len(e))
    for code in range(2 ** len(e)):
        y = [(code >> i) & 1 for i in range(len(e))]
        p = np.exp(sum(a * b for a, b in zip(e, y)) + sum(chain.steps[a, b] for a, b in zip(y, y[1:])))
        z, good = z + p, good + p * np.array(y)
    mean = np.clip(sum((good / z) * (n + 1)) / sum(n + 1), 1e-4, 1 - 1e-4)
    return 1 / (1 + np.exp(-(chain.curve[0] + chain.curve[1] * np.log(mean / (1 - mean)))))


def test_quality_end_to_end(spark):
    rows, labels = corpus()
    rows += [(9000, ""), (9001, None), (9002, "One!!\nTwo!!\n\nfour words are here")]
    table = spark.createDataFrame([(i, q) for i, q, _ in labels], "doc_id long, quality int")
    chain = quality.fit(docs(spark, rows), table)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs(spark, rows), table).collect()}
    assert all(np.isclose(got[i], plain_quality(chain, t or ""), atol=1e-9) for i, t in rows)

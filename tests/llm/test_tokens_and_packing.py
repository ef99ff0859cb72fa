import itertools
import zlib

import numpy as np
import pytest

from gleaner.llm import common, mixing, packing, separators, tokenfile, tokens
from gleaner.llm.tokens import Encoder, public

BYTES, WORDS = public("byte_bpe_50k.json"), public("word_bpe_49k.json")
ODD = [
    "", " ", "  ", "a  b", "a\n\n\nb", " \n x", "don't it's I'LL", "x_y 12 3½ ²a", "Σίσυφος ΣΑΣ İx é é", "a b c\x1cd", "tail ", "\n", "a \tb",
    "foo\n bar", "foo\n\t bar", "\n \nfoo", "<|endoftext|> <|startoftext|>x", "’s ’t", "日本語 テキスト。", "x́ y", "a\n\nb c", "word." * 3000, "Hello, hello, HELLO!! world###",
]
SCHEMA = "doc_id long, text string, source string, TEXT2 string, length long"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def some(n=120, seed=0):
    rng = np.random.default_rng(seed)
    words = ["the", "tion", "Ered", "onea,", "wh.\nAn", "ñoé", "x###", "42"]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(1, 60)))), f"s{i % 4}") for i in range(n)]
    rows[5] = (5, "many words " * 9000, "s1")
    return rows + [(7, rows[7][1], "s3"), (900, None, None), (901, "", "s0"), (None, "no id", None), (902, " \n", "s1")]


@pytest.mark.parametrize("path", [BYTES, WORDS])
@pytest.mark.parametrize("piece", [1 << 22, 1, 17])
def test_encoder_equals_the_library(path, piece, monkeypatch):
    monkeypatch.setattr(common, "PIECE", piece)
    e = Encoder(path)
    for _ in range(2):  # the second time from the caches
        for t in ODD + [" ".join(ODD)] + [t for _, t, _ in some(30) if t]:
            assert e.ids(t).tolist() == e.whole.encode(t, add_special_tokens=False).ids, t[:50]
    assert len(e.ids(None)) == 0


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_latin_texts_are_split_without_the_whole_tokenizer(path, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 50)  # the halves change places
    signs = [chr(c) for c in (*range(0x180), *range(0x2010, 0x205F)) if not tokens._ODD.search(chr(c))]
    assert len(signs) > 400
    texts = [x for c in signs for x in (c, f"a{c}B", f"1{c}2", f" {c}  {c}", f"{c}{c}'s\n{c}")]
    rng = np.random.default_rng(3)
    texts += ["".join(rng.choice([*"aZé09 \n\t'.,!_-sÑ", "  ", "'ll", "…"], int(rng.integers(1, 20)))) for _ in range(3000)]
    e, reference = Encoder(path), Encoder(path).whole
    monkeypatch.setattr(e, "whole", None)
    for t in texts:
        assert e.ids(t).tolist() == reference.encode(t, add_special_tokens=False).ids, t
    assert len(e.pieces) <= 100 and len(e.pieces.old) <= 100


def test_code_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (rng.integers(0, 1 << 32, n, np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype("<u4")
        blob = tokenfile.encode(v)
        assert np.array_equal(tokenfile.decode(blob), v)
        assert len(blob) == 8 + -(-n // 4) + sum(max(1, -(-int(x).bit_length() // 8)) for x in v)
    assert np.array_equal(tokenfile.decode(tokenfile.encode(np.array([255, 256, 65535, 65536, 2**24, 2**32 - 1]))), [255, 256, 65535, 65536, 2**24, 2**32 - 1])
    ids, counts, ranks = tokenfile.read_block(tokenfile.write_block([None, -3, 2**60], np.array([1, 0, 2]), np.array([7, 8, 300])))
    assert ids == [None, -3, 2**60] and counts.tolist() == [1, 0, 2] and ranks.tolist() == [7, 8, 300]
    with pytest.raises(ValueError):
        tokenfile.read_block(b"something else entirely, and long enough")


@pytest.mark.parametrize("shuffled", [False, True])
def test_token_files(spark, shuffled):
    rows = some()
    d = docs(spark, rows).repartition(5) if shuffled else docs(spark, sorted(rows, key=lambda r: -1 if r[0] is None else r[0]))
    folder, files = tokenfile.write(d, BYTES, 2, block=1000)
    assert files.count() > 5
    got = tokenfile.read(spark, folder, files).orderBy("start").collect()
    e = Encoder(BYTES)
    ids = {}
    for i, t, _ in rows:
        x = np.append(e.ids(t).astype("<u4"), np.uint32(2))
        ids.setdefault(i, []).append((len(x), zlib.crc32(x.tobytes())))
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    for r in got:
        ids[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
    assert not any(ids.values())
    assert tokenfile.round_trip(docs(spark, []), BYTES, 2).count() == 0


@pytest.mark.parametrize("block", [7, 1000, 1 << 20])
def test_separator_scan(spark, block):
    rows = some(40)
    got = separators.count_tokens(docs(spark, rows).repartition(3), BYTES, 50256, block=block).collect()
    e = Encoder(BYTES)
    assert sorted(map(repr, ((r["doc_id"], r["n_tokens"]) for r in got))) == sorted(map(repr, ((i, len(e.ids(t))) for i, t, _ in rows)))
    by = {}
    for r in sorted(got, key=lambda r: (r["stream"], r["seq"])):
        assert r["start"] == by.get(r["stream"], 0)
        by[r["stream"]] = r["start"] + r["n_tokens"] + 1


def test_separator_scan_of_nothing(spark):
    assert separators.count_tokens(docs(spark, []), BYTES, 50256).collect() == []


def test_separator_scan_of_foreign_files(spark, tmp_path):
    np.array([5, 9, 9, 5], "<u2").tofile(tmp_path / "00000000-00000000.bin")
    np.array([5, 5, 5], "<u2").tofile(tmp_path / "00000000-00000001.bin")
    np.array([9, 1], "<u2").tofile(tmp_path / "00000000-00000002.bin")
    got = separators.scan(spark, f"file://{tmp_path}", 9).orderBy("seq").collect()
    assert [(r["seq"], r["start"], r["n_tokens"]) for r in got] == [(0, 0, 1), (1, 2, 0), (2, 3, 4), (3, 8, 1)]


def plain_best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in room if r >= n]
        room.append(min(fit) - n if fit else capacity - n)
        if fit:
            room.remove(min(fit))
    return len(room)


def test_plan_equals_best_fit_of_single_pieces():
    rng = np.random.default_rng(0)
    for k in range(150):
        cap = int(rng.integers(3, 60))
        lengths = rng.integers(1, cap + 1, 200) if k % 2 else np.minimum(cap, 1 + rng.exponential(cap / 4, 200).astype(int))
        counts = {int(n): int((lengths == n).sum()) for n in set(lengths.tolist())}
        used = {}
        for length, rank, first, many, each, offset in packing.best_fit(counts, cap):
            for s in range(first, first + many):
                used.setdefault(s, []).extend((offset + i * length, length) for i in range(each))
        assert len(used) == plain_best_fit(lengths.tolist(), cap)
        for parts in used.values():
            ends = np.cumsum([n for _, n in sorted(parts)])
            assert ends[-1] <= cap and [o for o, _ in sorted(parts)] == [0, *ends[:-1]]


def check_packing(rows, got, capacity=4096):
    e = Encoder(WORDS)
    want = []
    for i, t in rows:
        x = np.append(e.ids(t).astype("<u4"), np.uint32(1))
        want += [(i, k // capacity, k, len(x[k : k + capacity]), zlib.crc32(x[k : k + capacity].tobytes())) for k in range(0, len(x), capacity)]
    assert sorted(map(repr, ((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got))) == sorted(map(repr, want))
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert ends[-1] <= capacity and [o for o, _ in sorted(parts)] == [0, *ends[:-1]]
    assert len(by) == plain_best_fit([w[3] for w in want], capacity)


@pytest.mark.parametrize("size", [3, 50_000])
def test_packing(spark, monkeypatch, size):
    monkeypatch.setattr(packing, "SLICE", size)
    rows = some()
    check_packing([r[:2] for r in rows], packing.pack(docs(spark, rows).repartition(3), WORDS).collect())
    assert packing.pack(docs(spark, []), WORDS).count() == 0


def test_packed_sequences(spark):
    """The sequences themselves hold every document's ids, in whole pieces."""
    rows, e = some(60), Encoder(WORDS)
    got = packing.sequences(docs(spark, rows), WORDS).collect()
    pieces = packing.pack(docs(spark, rows), WORDS).collect()
    text = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in got}
    assert len(text) == len({r["sequence_id"] for r in pieces}) and all(len(x) <= 4096 for x in text.values())
    assert sum(map(len, text.values())) == sum(len(e.ids(t)) + 1 for _, t, _ in rows) == sum(r["length"] for r in pieces)
    assert sum(len(r["doc_ids"]) for r in got) == len(pieces)
    crcs = sorted(zlib.crc32(text[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]].tobytes()) for r in pieces)
    assert crcs == sorted(r["ids_crc32"] for r in pieces)


def test_order_of_runs(spark, monkeypatch):
    up, down = spark.range(0, 1000, 1, 7).toDF("doc_id"), spark.range(1000, 0, -1, 7).toDF("doc_id")
    for look in (1 << 16, 0):  # by the driver, and within ranges of ids
        monkeypatch.setattr(tokenfile, "LOOK", look)
        assert tokenfile.in_order(up) and not tokenfile.in_order(down) and tokenfile.in_order(up.where("doc_id < 0"))
        assert not tokenfile.in_order(up.unionByName(up))


def test_quotas():
    q = mixing.quotas({"a": 100, "b": 100, "c": 1000, "d": 5}, {"a": 1, "b": 2, "c": 3, "d": 1}, 1205)
    assert q["d"] == 15 and abs(sum(q.values()) - 1205) < 1e-9 and q["b"] == 300 and abs(q["c"] - 3 * q["a"]) < 1e-9
    assert mixing.quotas({}, {}, 0) == {} and mixing.quotas({"a": 0}, {"a": 1}, 0) == {"a": 0.0}


def test_flow_repeats_as_little_as_it_can():
    # the overlap serves b, as a has words of its own
    got = mixing.route({("a",): 100, ("a", "b"): 100, ("b",): 10}, {"a": 100, "b": 110})
    assert got == {("a",): 100, ("a", "b"): 100, ("b",): 10}
    got = mixing.route({("a",): 10, ("a", "b"): 100}, {"a": 300, "b": 5})
    assert sum(got.values()) == 305 and got["a",] <= 30
    assert mixing.route({("a",): 10}, {"a": 50.0}) == {("a",): 30}


def plain_route(patterns, quota, most=3):
    """By trying everything: the most words that can be placed, then the least cost. Words of patterns within a set of
    sources can't pass what the set takes; that is also enough."""
    names, best = list(patterns), None
    sets = [set(c) for k in range(1, len(quota) + 1) for c in itertools.combinations(quota, k)]
    for f in itertools.product(*[range(most * patterns[p] + 1) for p in names]):
        if all(sum(n for p, n in zip(names, f) if set(p) <= a) <= sum(quota[s] for s in a) for a in sets):
            cost = sum(k * min(patterns[p], max(0, n - k * patterns[p])) for p, n in zip(names, f) for k in range(most))
            best = max(best or (-1, 0), (sum(f), -cost))
    return best


def test_flow_equals_exhaustive_search():
    rng = np.random.default_rng(4)
    every = [("a",), ("b",), ("c",), ("a", "b"), ("b", "c"), ("a", "b", "c")]
    for _ in range(120):
        own = [every[i] for i in rng.choice(6, int(rng.integers(1, 5)), replace=False)]
        patterns = {p: int(rng.integers(1, 4)) for p in own}
        quota = {s: int(rng.integers(0, 9)) for s in "abc"}
        got = mixing.route(patterns, quota)
        sets = [set(c) for k in (1, 2, 3) for c in itertools.combinations("abc", k)]
        assert all(sum(n for p, n in got.items() if set(p) <= a) <= sum(quota[s] for s in a) for a in sets)
        cost = sum(k * min(patterns[p], max(0, n - k * patterns[p])) for p, n in got.items() for k in range(3))
        assert (sum(got.values()), -cost) == plain_route(patterns, quota)


def test_flow_of_many_sources():
    n = 20_000
    patterns = {(f"s{i:05d}",): 10 + i % 7 for i in range(n)} | {(f"s{i:05d}", f"s{i + 1:05d}"): 5 for i in range(n - 1)}
    got = mixing.route(patterns, {f"s{i:05d}": 12.0 for i in range(n)})
    assert sum(got.values()) == 12 * n and all(v <= 3 * patterns[p] for p, v in got.items())


def test_mix_comes_near_every_target(spark):
    """Sizes of all orders, one text of very many words, a source of a third of all rows, tables of patterns not broadcast."""
    rng = np.random.default_rng(9)
    rows = [(i, "w " * int(rng.integers(1, 60) if i % 10 else rng.integers(200, 1500)), f"s{min(i % 9, 6)}") for i in range(1500)] + [(5000, "word " * 40_000, "long"), (5001, None, None)]
    for small in (100_000, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(mixing, "SMALL", small)
            got = mixing.mix(docs(spark, rows)).toPandas()
        assert len(got) == len(rows) and got["copies"].between(0, 3).all()
        for name, part in got.groupby(got["sources"].map(tuple)):
            if name != ("0long",):  # one text only: all of it or nothing
                assert abs((part["size"] * part["copies"]).sum() - part["target"].iloc[0]) <= max(3, 0.001 * part["target"].iloc[0]), name


def test_mix(spark):
    rows = [(i, "w " * (i % 17 + 1), None if i % 5 == 0 else f"s{i % 3 if i % 2 else 0}") for i in range(900)] + [(2000, None, "s1"), (2001, "", "empty"), (7, "w " * 8, "s1")]
    a = mixing.mix(docs(spark, rows)).toPandas()
    b = mixing.mix(docs(spark, rows).repartition(7)).toPandas()
    key = lambda d: sorted(zip(d["doc_id"], d["size"], d["copies"], d["target"]))
    assert key(a) == key(b) and len(a) == len(rows)
    by = {i: len((t or "").split()) for i, t, _ in rows}
    assert all(by[r.doc_id] == r.size for r in a.itertuples()) and a["copies"].between(0, 3).all()
    for _, part in a.groupby(a["sources"].map(tuple)):
        assert abs((part["size"] * part["copies"]).sum() - part["target"].iloc[0]) <= 17
    assert a[a["size"] == 0]["copies"].sum() == 0
    out = mixing.mixed(docs(spark, rows)).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in out} == {i: n for i, n in a.groupby("doc_id")["copies"].sum().items() if n}
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.mixed(docs(spark, [])).count() == 0


def test_mix_of_overlapping_sources(spark):
    rows = [(i, "w " * 5, ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else ["b", None, "b"]) for i in range(300)] + [(999, "w", [])]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>")).toPandas()
    assert got[got["doc_id"] == 999]["copies"].item() == 0 and got["copies"].between(0, 3).all()
    assert abs((got["size"] * got["copies"]).sum() - 1501) <= 20

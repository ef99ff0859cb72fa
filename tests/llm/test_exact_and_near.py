import duckdb
import hashlib
import re

import numpy as np
import pandas as pd
import pytest
import xxhash

from gleaner.llm import common, components, embeddings, exact, simhash

SCHEMA = "doc_id long, text string, TEXT2 string, n long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


ODD = [
    (3, "a b"), (1, "ab"), (2, " a\tb\n"), (9, None), (8, ""), (7, " \x0b"), (None, "ab"), (5, "é e"), (6, "ée"),
    (11, "a b"), (12, "same"), (12, "same"), (13, "x" * 50_000), (14, "x" * 25_000 + " " + "x" * 25_000),
]


def plain_groups(rows):
    by = {}
    for k, (i, t) in enumerate(rows):
        body = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        by.setdefault(body, []).append((-len(t or ""), i is None, i if i is not None else 0, k))
    out = []
    for body, found in by.items():
        lead = min(found)
        for f in found:
            out.append((rows[f[3]][0], rows[lead[3]][0], len(found), hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("support", [0.001, 0.2])
def test_exact_groups(spark, support):
    got = exact.groups(docs(spark, ODD), support=support).toPandas()
    assert sorted(((None if r.doc_id != r.doc_id else int(r.doc_id), None if r.keep_id != r.keep_id else int(r.keep_id), r.group_size, r.text_sha256) for r in got.itertuples()), key=repr) == plain_groups(ODD)
    assert got["kept"].sum() == got["text_sha256"].nunique()


def test_exact_hot_group_and_empty_table(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(3000)]
    got = exact.groups(docs(spark, rows)).where("group_size > 1").toPandas()
    assert len(got) == 1000 and (got["keep_id"] == 0).all() and got["kept"].sum() == 1
    assert exact.groups(docs(spark, [])).count() == 0 and exact.drop_copies(docs(spark, [])).count() == 0


def test_drop_copies_keeps_columns(spark):
    d = docs(spark, ODD)
    kept = exact.drop_copies(d)
    assert kept.columns == d.columns
    assert sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted(map(repr, {r["keep_id"] for r in exact.groups(d).collect()}))
    clash = d.toDF("doc_id", "text", "text", "digest")
    assert exact.drop_copies(clash).count() == kept.count()


def plain_print(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for t in (None, "", " \n", "One", "one two", "A b C d e", "É\x1cx y z Z", "to be or not to be " * 30):
        assert simhash.fingerprint(t) == plain_print(t)


def test_fingerprints_by_pieces(monkeypatch):
    text = " ".join(f"Wort{i % 91} \n" if i % 7 else "x" * 40 for i in range(500))
    for piece in (1 << 22, 1, 5, 64):
        monkeypatch.setattr(common, "PIECE", piece)
        assert simhash.fingerprint(text) == plain_print(text)
        assert simhash.fingerprint("a b") == plain_print("a b") and simhash.fingerprint(" a  b c") == plain_print(" a  b c")
    assert list(common.pieces("", " ")) == [""]


def test_gray_index_finds_every_pair():
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 63, 40, np.uint64)
    prints = np.unique(np.concatenate([seeds ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(k > 3) << rng.integers(0, 64, 40).astype(np.uint64)) for k in range(8)]))
    for bits in (0, 1, 2, 3):
        index = simhash.GrayIndex(prints)
        found = {(int(i), int(j)) for a, b in index.pairs(bits) for i, j in zip(a, b)}
        d = np.bitwise_count(index.prints[:, None] ^ index.prints)
        assert found == {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= bits)) if i < j}


@pytest.mark.parametrize("hot", [1, 100_000])
def test_every_close_pair_meets(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = np.random.default_rng(2)
    at = lambda n: np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    seeds = rng.integers(0, 1 << 64, 300, np.uint64)
    block = (seeds[:100] & np.uint64((1 << 43) - 1)) | np.uint64(5 << 43)  # many of one block
    prints = np.unique(np.concatenate([seeds, seeds ^ at(300) ^ at(300), block, block ^ at(100) ^ at(100), seeds ^ at(300) ^ at(300) ^ at(300)]))
    close = np.bitwise_count(prints[:, None] ^ prints) <= 2
    comp = prints.view(np.int64).copy()
    while (new := np.where(close, comp, np.iinfo(np.int64).max).min(axis=1)).tolist() != comp.tolist():
        comp = new
    got = {r["p"]: r["component"] for r in simhash.near(spark.createDataFrame([(p,) for p in prints.view(np.int64).tolist()], "p long")).collect()}
    linked = close.sum(axis=1) > 1
    assert got == dict(zip(prints.view(np.int64)[linked].tolist(), comp[linked].tolist()))


def test_a_partition_is_one_index(spark, monkeypatch):
    """Every table's share goes through the tree, whatever its size."""
    made = []
    real = simhash.GrayIndex
    monkeypatch.setattr(simhash, "GrayIndex", lambda prints: made.append(len(prints)) or real(prints))
    prints = np.random.default_rng(3).integers(0, 1 << 63, 400)
    prints[1] = prints[0] ^ 3
    batch = lambda t, p: pd.DataFrame({"t": t, "p": p})
    out = pd.concat(simhash._search(iter([batch(0, prints[:100]), batch(0, prints[100:]), batch(2, prints[:2])])))
    assert made == [400, 2] and sorted(map(sorted, out[["u", "v"]].values.tolist())) == [sorted(prints[:2].tolist())] * 2


def test_simhash_classes(spark, monkeypatch):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for k in range(60):
        base = list(rng.choice(words, 400))
        rows.append((len(rows) + 1, " ".join(base)))
        for _ in range(k % 4):
            near = list(base)
            near[int(rng.integers(0, 400))] = "new"
            rows.append((len(rows) + 1, " ".join(near)))
    rows += [(1001, "very long text " * 400_000), (1000, None), (999, ""), (None, "one"), (998, "one"), (998, "one")]
    got = simhash.classes(docs(spark, rows)).toPandas()
    prints = np.array([plain_print(t) for _, t in rows], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints) <= 2
    ids = np.array([1 << 60 if i is None else i for i, _ in rows])
    comp = ids.copy()
    while (new := np.where(near, comp, 1 << 60).min(axis=1)).tolist() != comp.tolist():
        comp = new
    key = lambda i, p, c: (i if i == i and i is not None else -1, p, c)
    assert sorted(key(r.doc_id, r.fingerprint, r.component_id) for r in got.itertuples()) == sorted(key(i, f"{int(p):016x}", int(c)) for (i, _), p, c in zip(rows, prints, comp))
    kept = simhash.drop_near_copies(docs(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(comp.tolist()))
    assert simhash.classes(docs(spark, [])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 9), (9, 5), (7, 7), (300, 1)] + [(500, i) for i in range(501, 560)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and got[9] == got[5] == 5 and got[300] == 1 and 7 not in got
    assert {got[i] for i in range(500, 560)} == {500}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_links(rows, cosine=0.98):
    n, out = len(rows), {}
    ok = [v is not None and label is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                near[i, j] = near[j, i] = a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= cosine
    comp = np.array([r[0] for r in rows])
    np.fill_diagonal(near, True)
    while (new := np.where(near, comp, 1 << 60).min(axis=1)).tolist() != comp.tolist():
        comp = new
    for i in range(n):
        out[rows[i][0]] = (int(near[i].sum()) - 1, int(comp[i]))
    return out


@pytest.mark.parametrize("cell", [4096, 16])
def test_embedding_links(spark, monkeypatch, cell):
    monkeypatch.setattr(embeddings, "CELL", cell)
    rng = np.random.default_rng(2)
    rows = []
    for k in range(25):
        base = rng.standard_normal(32)
        for m in range(1 + k % 5):
            v = base + 0.12 * m * rng.standard_normal(32) if m < 4 else base * 3
            rows.append((len(rows), [float(x) for x in np.float32(v)], k % 2))
    rows += [(len(rows) + i, list(rows[0][1]), 0) for i in range(40)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 32, 0), (n + 2, [float("nan")] * 32, 0), (n + 3, [1.0, None] * 16, 0), (n + 4, list(rows[0][1]), None), (n + 5, [], 0), (n + 6, [1e30] * 32, 1), (n + 7, [1e-30] * 32, 1), (n + 8, [1.0, 1.0], 1), (n + 9, [float("inf")] * 32, 1), (n + 10, [2.0], 1), (n + 11, [3.0], 1)]
    got = embeddings.near(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).toPandas()
    want = plain_links([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows])
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.itertuples()} == want
    assert (got["kept"] == (got["vec_id"] == got["component_id"])).all()


def test_embedding_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 64))
    rows = [(int(i), [float(v) for v in a], 0) for i, a in enumerate(np.concatenate([x, x + 0.17 * rng.standard_normal(x.shape)]))]
    want = plain_links(rows)
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    total = sum(w[0] for w in want.values())
    assert total > 200 and sum(got.values()) >= 0.9 * total and all(got[i] <= want[i][0] for i in got)
    assert embeddings.near(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


@pytest.mark.parametrize("miss", [0, 1e-3])
def test_embedding_sql_on_links(spark, miss, tmp_path):
    """The registered query's SQL, on vectors that do link (the given tables hold no such pair)."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 64))
    some = np.concatenate([base, *(base + s * rng.standard_normal(base.shape) for s in (0.0, 0.05, 0.1, 0.15, 0.2, 0.3))]).astype(np.float32)
    table = pd.DataFrame({"vec_id": rng.permutation(len(some)), "embedding": some.tolist(), "label": (np.arange(len(some)) % 60 % 7).astype("int32")})
    table.to_parquet(tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    want = {r[0]: r[1:] for r in con.sql(f"select vec_id, n_links, component_id, kept from ({embeddings.ORACLE})").fetchall()}
    rows = spark.read.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near(rows, miss=miss).collect()}
    assert sum(w[0] for w in want.values()) > 400
    if not miss:
        assert got == want
    assert sum(g[0] for g in got.values()) >= 0.99 * sum(w[0] for w in want.values()) and all(got[i][0] <= want[i][0] for i in want)


def test_embedding_ids_and_columns(spark):
    """Null and repeated ids are rows of their own; other columns, of clashing names too, are ignored."""
    rows = [(None, [1.0, 2.0], "a", 1, "x"), (7, [2.0, 4.0], "a", 2, "y"), (7, [1.0, 2.0], "a", 3, "z"), (9, [1.0, 2.0], "b", 4, "x"), (None, [5.0, 1.0], "b", 5, "x"), (8, [-1.0, -2.0], "a", 6, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, cid long, Label2 string").toDF("vec_id", "embedding", "label", "cid", "t")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near(table).collect()), key=repr)
    assert got == sorted([(None, 2, 7, False), (7, 2, 7, True), (7, 2, 7, True), (9, 0, 9, True), (None, 0, None, True), (8, 0, 8, True)], key=repr)


def test_estimates_hold_their_bound():
    """The mean of the estimates' errors is near zero, and no pair at the threshold is dropped."""
    rng = np.random.default_rng(6)
    x = embeddings.unit(rng.standard_normal((400, 48)))
    y = embeddings.unit(x + 0.02 * rng.standard_normal(x.shape))
    every = np.concatenate([x, y])
    own = embeddings.codes(every)
    near = np.flatnonzero(np.einsum("ij,ij->i", x, y) >= 0.98)
    i, j = embeddings.estimated(*own, slice(0, 400), slice(400, 800), 0.98)
    assert len(near) > 300 and set(near.tolist()) <= {a for a, b in zip(i.tolist(), j.tolist()) if b == a + 400}
    bar = (np.unpackbits(own[0], axis=1, count=48) * 2.0 - 1) / np.sqrt(48)
    turned = every @ embeddings.rotation(48, embeddings.SEED).T
    off = (bar[:400] @ turned[:400].T) / own[1][:400, None] - x @ x.T
    assert abs(off[~np.eye(400, dtype=bool)].mean()) < 0.002


def test_exact_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(map(tuple, con.sql(f"select doc_id, keep_id, group_size, kept, text_sha256 from ({exact.ORACLE})").fetchall()))
    got = exact.groups(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want


def test_near_copies_of_repeated_and_null_ids(spark):
    a, b, c, d, e = (" ".join(f"{w}{i}" for i in range(60)) for w in ("ab", "cd", "ef", "gh", "ij"))
    # upper case leaves the fingerprint as it is; white space changes the length only
    rows = [(1, a), (1, b + " " * 9), (2, a.upper()), (0, b.upper()), (3, c), (3, d + "  "), (None, c.upper()), (None, e), (None, e.upper()), (4, "x"), (None, None), (None, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = simhash.drop_near_copies(table).collect()
    found = sorted(((r["doc_id"], (r["text"] or "").strip().lower()) for r in got), key=repr)
    assert found == sorted([(1, a), (0, b), (3, c), (3, d), (None, e), (4, "x"), (None, "")], key=repr)

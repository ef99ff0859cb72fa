"""Every registered query on the smallest tables, against plain versions of its contract."""

import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from gleaner.llm import queries as llm
from gleaner.llm import quality, toxicity
from gleaner.llm.tokens import Encoder, public

from . import plain
from .test_exact_and_near import plain_links, plain_print
from .test_substrings_and_scores import plain_removal
from .test_tokens_and_packing import check_packing


@pytest.fixture(scope="module")
def rows(sf):
    table = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    return [(r["doc_id"], r["text"]) for r in table]


def result(spark, sf, name):
    return llm.QUERIES[name](spark, sf).collect()


def test_op2(spark, sf, rows):
    e = Encoder(public("byte_bpe_50k.json"))
    assert {r["doc_id"]: r["n_tokens"] for r in result(spark, sf, "op2_token_counts")} == {i: len(e.ids(t)) for i, t in rows}


def test_op3(spark, sf, rows):
    check_packing(rows, result(spark, sf, "op3_best_fit_packing"))


def test_op4(spark, sf, rows):
    e, at, want = Encoder(public("byte_bpe_50k.json")), 0, {}
    for i, t in sorted(rows):
        ids = np.append(e.whole.encode(t or "", add_special_tokens=False).ids, 2).astype("<u4")
        want[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in result(spark, sf, "op4_token_files")} == want


def test_op5(spark, sf, rows):
    source = {r["doc_id"]: r["source"] for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    got, text = {r["doc_id"]: r for r in result(spark, sf, "op5_source_mix")}, dict(rows)
    want = plain.targets([(source[i], t) for i, t in rows])
    taken, size = Counter(), Counter()
    for i, r in got.items():
        assert r["size"] == len((text[i] or "").split()) and 0 <= r["taken"] <= 3 * r["size"] and abs(r["target"] - want[source[i]]) < 1e-6
        taken[source[i]] += r["taken"]
        size[source[i]] += r["size"]
    assert set(got) == set(text) and all(got[i]["source_size"] == size[source[i]] for i in got)
    # sources of a dozen documents: less than half of one that could come or go
    for s in want:
        spare = [got[i]["size"] for i in got if source[i] == s and got[i]["size"]]
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], max(spare, default=0) / 2) + 1, s
    assert np.mean([abs(taken[s] - want[s]) / max(want[s], 1) for s in want]) < 0.03


def test_op6(spark, sf, rows):
    assert sorted((tuple(r) for r in result(spark, sf, "op6_substring_dedup")), key=repr) == plain_removal(rows, 400)


def test_op9(spark, sf, rows):
    prints = {i: plain_print(t) for i, t in rows}
    comp = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            for j in prints:
                if comp[j] < comp[i] and (prints[i] ^ prints[j]).bit_count() <= 2:
                    comp[i], changed = comp[j], True
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in result(spark, sf, "op9_simhash_near_dedup")} == {i: (f"{prints[i]:016x}", comp[i]) for i in prints}


def test_op10(spark, sf):
    table = [(r["vec_id"], r["embedding"], r["label"]) for r in pq.read_table(f"{sf}/embeddings.parquet").to_pylist()]
    got = result(spark, sf, "op10_embedding_near_dedup")
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == plain_links(table)


@pytest.mark.parametrize("name, module, column", [("op1_quality", quality, "quality"), ("op8_toxicity", toxicity, "toxic")])
def test_op1_and_op8(spark, sf, rows, name, module, column):
    got = {r["doc_id"]: r for r in result(spark, sf, name)}
    modulus, left = module.HELD
    assert set(got) == {i for i, _ in rows}
    for i, r in got.items():
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(i).encode()) % modulus == left)
    truth = {r["doc_id"]: r[column] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    assert np.mean([got[i]["predicted"] == y for i, y in truth.items() if i in got and y is not None]) > 0.8


def test_op8_equals_plain_scores(spark, sf, rows):
    """The model's scan, statistics and curve, and its weights from counts."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, labels).collect()}
    short = [(i, t) for i, t in rows if len((t or "").split()) < 200]
    assert len(short) > 50 and all(abs(got[i] - plain.toxic_score(model, t)) < 1e-9 for i, t in short)
    text, modulus, left = dict(rows), *toxicity.HELD
    told = [(r["toxic"], text[r["doc_id"]]) for r in pq.read_table(f"{sf}/labels.parquet").to_pylist() if zlib.crc32(str(r["doc_id"]).encode()) % modulus != left]
    counts, documents, share, base = plain.odds(told)
    stems = {y: Counter() for y in (0, 1)}
    for y in (0, 1):
        for w, n in counts[y].items():
            stems[y][w[: toxicity.STEM]] += n
    checked = 0
    for w, weight in model.words.items():
        if not weight:
            continue
        s = w[: toxicity.STEM]
        t, c = stems[1][s], stems[0][s]
        # a stem that a single document of each half has is as if it were not there
        for p in ((t + toxicity.STEM_PRIOR * share) / (t + c + toxicity.STEM_PRIOR), share):
            want = np.log((counts[1][w] + toxicity.WORD_PRIOR * p) / (counts[0][w] + toxicity.WORD_PRIOR * (1 - p))) - base
            if abs(want - weight) < 1e-9:
                checked += 1
                break
    assert checked == sum(1 for v in model.words.values() if v) > 0
    p = np.array([0.2, 0.5, 0.3])
    rate = toxicity.karlin(np.array([1.0, -0.5, -1.0]), p * 100)
    assert abs((p * np.exp(rate * np.array([1.0, -0.5, -1.0]))).sum() - 1) < 1e-9

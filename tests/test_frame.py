import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import frame as O
from gleaner.sources import containers, npy, synthetic

from .data import arrays, frame


def table(spark, ids):
    return spark.createDataFrame([(i, c, [float(i)], 1.0) for i, c in enumerate(ids)], "row_id long, c long, x array<double>, y double")


def test_defaults(spark):
    with pytest.warns(UserWarning):
        f = O.build(table(spark, [5, 5, 4, 4, 5]), "x", config_id="c", y="y")
    got = {r["row_id"]: (r["is_energy"], r["w"], list(r["features"])) for r in f.collect()}
    assert [i for i, v in got.items() if v[0]] == [0, 2] and got[1][1:] == (1.0, [1.0, 1.0])
    with pytest.warns(UserWarning):
        alone = O.build(table(spark, [5, 5]), "x", intercept=False)
    assert {(r["row_id"], r["config_id"], r["is_energy"], r["y"]) for r in alone.collect()} == {(0, 0, True, None), (1, 1, True, None)}
    with pytest.raises(ValueError):
        O.build(table(spark, [1]), "x", dtype="float16")


def test_bad_rows_are_counted(spark):
    t = spark.createDataFrame([(0, 1, [1.0]), (1, 1, [float("nan")]), (2, None, [1.0]), (3, 1, None)], "row_id long, c long, x array<double>")
    with pytest.raises(O.BadRows, match="3 rows"):
        O.build(t, "x", config_id="c", is_energy=F.lit(True), check=True)


def test_float32_storage_is_close(spark):
    from gleaner.operators.factor import solve

    x, y, w, c, e = arrays(100, 5, 6, noise=1e-3)
    f = frame(spark, x, y, w, c, e)
    narrow = O.build(f, "features", config_id="config_id", is_energy="is_energy", y="y", w="w", intercept=False, dtype="float32")
    assert np.allclose(solve(f), solve(narrow), rtol=1e-5)


def test_boundaries(spark):
    with pytest.warns(UserWarning):
        f = O.build(table(spark, [7, 7, 3, 3, 3, 9]), "x", config_id="c")
    got = sorted(tuple(r) for r in O.boundaries(f, check=True).select("island", "config_id", "start_row", "n_rows").collect())
    assert got == [(0, 7, 0, 2), (1, 3, 2, 3), (2, 9, 5, 1)]
    with pytest.warns(UserWarning):
        mixed = O.build(table(spark, [0, 0, 1, 1, 0, 0]), "x", config_id="c")
    assert O.boundaries(mixed).count() == 3
    with pytest.raises(ValueError):
        O.boundaries(mixed, check=True)
    assert O.boundaries(mixed.limit(0)).count() == 0


def test_cells_do_not_change_results(spark, monkeypatch):
    ids = [int(i) for i in np.random.default_rng(0).integers(0, 4, 300)]
    with pytest.warns(UserWarning):
        f = O.build(table(spark, ids), "x", config_id="c")
    counts = spark.createDataFrame([(i, 1 + i % 7) for i in range(300)], "config_id long, n_rows long")
    whole = sorted(map(tuple, O.boundaries(f).collect())), sorted(map(tuple, O.range_ends(counts, 9).collect()))
    monkeypatch.setattr(O, "CELL", 11)
    assert (sorted(map(tuple, O.boundaries(f).collect())), sorted(map(tuple, O.range_ends(counts, 9).collect()))) == whole


def test_balanced_ranges(spark):
    assert O.balanced_ranges([10, 5, 20, 3, 12], 2) == [(0, 15), (15, 50)]
    assert O.balanced_ranges([10] * 4, 2) == [(0, 20), (20, 40)]
    assert [b - a for a, b in O.balanced_ranges([5] * 8, 4)] == [10] * 4
    assert O.balanced_ranges([1, 1, 98], 2) == [(0, 2), (2, 100)]
    assert len(O.balanced_ranges([10] * 3, 3)) == 3
    with pytest.raises(ValueError):
        O.balanced_ranges([10] * 3, 4)
    counts = spark.createDataFrame([(i, 10) for i in range(4)], "config_id long, n_rows long")
    assert [tuple(r) for r in O.range_ends(counts, 2).collect()] == [(1, 20, 1)]
    with pytest.raises(ValueError):
        O.range_ends(counts, 5)


@pytest.mark.parametrize("sizes, parts", [([1, 1, 98], 3), ([1, 1, 98], 2), ([98, 1, 1], 3), ([10, 5, 20, 3, 12], 2), ([1] * 9 + [500] + [1] * 5, 7), ([4] * 6, 6), ([50, 1, 1, 50, 1], 4)])
def test_range_ends_equal_balanced_ranges(spark, sizes, parts):
    counts = spark.createDataFrame([(7 * i, n) for i, n in enumerate(sizes)], "config_id long, n_rows long")
    got = sorted(map(tuple, O.range_ends(counts, parts).collect()))
    want = [(i, b) for i, (_, b) in enumerate(O.balanced_ranges(sizes, parts), 1)][:-1]
    ends = np.cumsum(sizes).tolist()
    assert got == [(i, b, 7 * ends.index(b)) for i, b in want]


def test_split_check(spark):
    f = frame(spark, *arrays(10, 4, 2)).withColumn("part", F.col("row_id") % 2)
    assert O.split_configs(f, F.col("part")).count() == 10
    assert O.split_configs(f, F.col("config_id") % 3).count() == 0
    O.check_respected(f, F.col("config_id") % 3)
    with pytest.raises(ValueError):
        O.check_respected(f, F.col("part"))


def test_npy_source(spark, tmp_path):
    x = np.random.default_rng(0).standard_normal((50, 10))
    paths = {}
    for name, a in {"x": x, "f": np.asfortranarray(x), "x32": x.astype(np.float32), "y": x[:, 0], "c": np.arange(50) // 5, "e": np.arange(50) % 5 == 0}.items():
        paths[name] = str(tmp_path / f"{name}.npy")
        np.save(paths[name], a)
    for name in ("x", "f"):
        got = npy.load(spark, paths[name], [(0, 20), (20, 50)])
        assert got.rdd.getNumPartitions() == 2
        assert np.array_equal(np.stack(got.orderBy("row_id").toPandas()["values"]), x)
        assert np.array_equal(npy.read_range(paths[name], 13, 29), x[13:29])
    assert dict(npy.load(spark, paths["x32"]).dtypes)["values"] == "array<float>"
    obs = npy.observations(spark, paths["x"], paths["y"], None, paths["c"], paths["e"])
    f = O.build(obs, "features", config_id="config_id", is_energy="is_energy", y="y")
    assert f.count() == 50 and f.where("is_energy").count() == 10 and O.width(f) == 11
    with pytest.raises(ValueError):
        containers.rows(spark, "x.csv")
    with pytest.raises(ValueError):
        containers.rows(spark, [1, 2])
    assert containers.rows(spark, x).count() == containers.rows(spark, paths["x"]).count() == 50


def test_npy_sink(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((101, 3))
    table = spark.createDataFrame([(i, x[i].tolist(), float(x[i, 0]), i % 7, i % 2 == 0) for i in rng.permutation(101).tolist()], "row_id long, x array<double>, y double, c long, e boolean").repartition(5)
    for name, want in {"x": x, "y": x[:, 0], "c": np.arange(101) % 7, "e": np.arange(101) % 2 == 0}.items():
        npy.save(table, str(tmp_path / f"{name}.npy"), name)
        assert np.array_equal(np.load(tmp_path / f"{name}.npy"), want)
    with pytest.raises(ValueError):
        npy.save(table.where("row_id <> 5"), str(tmp_path / "gap.npy"), "y")
    npy.save(table.limit(0), str(tmp_path / "none.npy"), "y")
    assert np.load(tmp_path / "none.npy").shape == (0,) and npy.load(spark, str(tmp_path / "none.npy")).count() == 0


def test_generator(spark):
    t = synthetic.observations(spark, 20, 5, 3)
    assert t.count() == 100 and t.where("is_energy").count() == 20
    a, b = (u.orderBy("row_id").toPandas() for u in (t, t.repartition(7)))
    assert a["y"].equals(b["y"])
    x, y = np.stack(a["features"]), a["y"].to_numpy()
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    assert np.abs(x @ beta - y).max() < 0.1 and abs(x.std() - 1) < 0.2


def test_tasks_of_lineitem_grow_with_its_rows(spark, sf, monkeypatch):
    """No task sorts or groups more rows than it may, whatever the session's number of shuffle partitions."""
    from gleaner.operators import frame as module
    from gleaner.plans import catalogue, frames

    want = {tuple(r) for r in catalogue.split_config_check(spark, sf).collect()}
    monkeypatch.setattr(module, "TASK", 200, raising=False)
    f = frames.lineitem(spark, sf)
    sizes = [n for n in f.select("row_id").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()]
    assert len(sizes) == -(-sum(sizes) // 200) and max(sizes) < 600
    assert want and {tuple(r) for r in catalogue.split_config_check(spark, sf).collect()} == want


def test_npy_arrays_meet_without_a_join(spark, tmp_path):
    """Arrays of different lengths are read side by side, as far as the shortest goes; all columns are saved in one go."""
    from pyspark.sql import functions as F

    rows = spark.range(1000).select("id", F.array(F.col("id") * 2.0).alias("x"), (F.col("id") * 0.5).alias("y"), (F.col("id") % 7).alias("c"))
    paths = {c: str(tmp_path / f"{c}.npy") for c in ("x", "y", "c")}
    npy.save(rows, paths["x"], "x", "id")
    npy.save(rows.where("id < 900"), paths["y"], "y", "id")
    obs = npy.observations(spark, paths["x"], paths["y"], None, paths["x"])
    assert "Join" not in obs._jdf.queryExecution().executedPlan().toString()
    found = obs.orderBy("row_id").collect()
    assert len(found) == 900 and all(r["features"] == [2.0 * i] and r["y"] == 0.5 * i and r["config_id"] == 2.0 * i for i, r in enumerate(found))
    assert npy.save_all(rows, paths, "id")["c"].shape == (1000,)
    assert npy.load(spark, paths["c"]).where("value != row_id % 7").count() == 0


def test_cells_of_many_bounds(spark):
    from gleaner.operators import frame as module
    from pyspark.sql import functions as F

    for many in (1, 2, 5, 40, 333):
        bounds = [3 * i for i in range(many)]
        found = spark.range(-2, 3 * many + 3).select("id", module._below(bounds, F.col("id")).alias("n")).collect()
        assert all(r["n"] == sum(b < r["id"] for b in bounds) for r in found)

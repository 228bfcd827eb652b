import os

import numpy as np
import pandas as pd
import pytest

from wortnetz.llm import embeddings


def brute(x, threshold):
    n = np.linalg.norm(x, axis=1)
    return (x @ x.T) / np.outer(n, n) >= threshold


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(60, 16))
    near = np.concatenate([base[:20] + rng.normal(size=(20, 16)) * s for s in (0.05, 0.15, 0.25, 0.4)])
    return np.float32(np.concatenate([base, near, base[:5], base[:1].repeat(30, axis=0)]))


def test_pairs_against_brute_force():
    x = vectors().astype(np.float64)
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    for threshold in (0.5, 0.9, 0.95):
        i, j = embeddings.near_pairs(x[:90], x[90:], axes, threshold)
        assert set(zip(i.tolist(), j.tolist())) == set(zip(*(v.tolist() for v in np.nonzero(brute(x, threshold)[:90, 90:]))))


def test_groups_links_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 16)  # many tiles
    x = vectors()
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [float("inf")], [None] + [1.0] * 15]
    rows += [(1000 + k, v, None) for k, v in enumerate(odd)] + [(None, x[0].tolist(), 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, links int").repartition(6)
    got = embeddings.embedding_dedup(df).collect()
    assert len(got) == len(rows)
    all_x = np.concatenate([x, x[:1]]).astype(np.float64)
    near = brute(all_x, 0.95)
    ids = [*range(len(x)), None]
    reach = near.copy()
    for _ in range(10):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    want = {(ids[k], int(near[k].sum()) - 1, min(i for i, r in zip(ids, reach[k]) if r and i is not None)) for k in range(len(ids))}
    want |= {(1000 + k, 0, 1000 + k) for k in range(len(odd))}
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_empty_and_all_odd(spark):
    schema = "vec_id long, embedding array<float>"
    assert embeddings.embedding_dedup(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in embeddings.embedding_dedup(spark.createDataFrame([(4, None)], schema)).collect()] == [(4, 0, 4, True)]


def by_sql(rows, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    return {tuple(r) for r in con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({embeddings.OP2_SQL})").fetchall()}


def test_all_lengths_are_compared(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(embeddings, "TILE", 16)
    rng = np.random.default_rng(4)
    rows = []
    for d, n in ((16, 200), (3, 90), (7, 40), (1, 9), (20, 2), (64, 70)):
        base = rng.normal(size=(n // 3 + 1, d))
        x = base[rng.integers(0, len(base), n)] + rng.normal(size=(n, d)) * rng.choice([0, 0.05, 0.2], (n, 1))
        rows += x.tolist()
    rng.shuffle(rows)
    rows = [(k, v) for k, v in enumerate(rows)]
    for most in (512, 5):
        monkeypatch.setattr(embeddings, "MOST_AXES", most)
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
        assert {tuple(r) for r in embeddings.embedding_dedup(df).select("vec_id", "n_links", "component_id", "kept").collect()} == by_sql(rows, tmp_path)


def test_huge_and_tiny_components(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1.01e200]), (3, [1e-200, 1e-200]), (4, [5e-324, 5e-324]), (5, [1.7e308, -1.7e308]), (6, [1.0, -1.0])]
    got = {tuple(r) for r in embeddings.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 3, 1, False), (5, 1, 5, True), (6, 1, 5, False)}


def test_long_vectors_and_one_that_a_third_shares(spark):
    rng = np.random.default_rng(2)
    long = rng.normal(size=(4, 20_000))
    rows = [(k, v.tolist()) for k, v in enumerate([*long, long[0] * 3])] + [(100 + k, [1.0, 2.0]) for k in range(1000)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[4] == (1, 0) and got[1] == (0, 1) and all(got[100 + k] == (999, 100) for k in range(1000))


def test_every_pair_of_tiles_has_one_owner():
    numbers = np.random.default_rng(0).integers(0, 1 << 62, 200)
    owned = np.stack([embeddings._owned(int(n), numbers) for n in numbers])
    assert ((owned ^ owned.T) | np.eye(200, dtype=bool)).all() and 80 < owned.sum(axis=1).mean() < 120


@pytest.mark.parametrize("n", [3, 200])
def test_axes_are_orthonormal_and_in_order(n):
    x = np.random.default_rng(1).normal(size=(n, 24)) * np.linspace(3, 0.1, 24)
    axes = embeddings.principal_axes(x)
    assert axes.shape == (24, min(n, 24)) and np.allclose(axes.T @ axes, np.eye(axes.shape[1]))
    spread = np.square(embeddings._unit(x) @ axes).sum(axis=0)
    assert (np.diff(spread) <= 1e-9).all() and spread.sum() == pytest.approx(n)


def test_every_length_has_a_rotation(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = [rng.normal(size=d).tolist() for d in [64] * 500 + [8] * 3 + [5]]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x)], "vec_id long, v array<double>")
    names = embeddings.rotations(df, str(tmp_path))
    axes = embeddings.Axes(str(tmp_path), names)
    assert {d: axes[d].shape for d in names} == {64: (64, 64), 8: (8, 3), 5: (5, 1)}


def test_the_query_fits_a_rotation_of_its_table(spark, monkeypatch):
    fitted = []
    known = embeddings.rotations
    monkeypatch.setattr(embeddings, "rotations", lambda rows, folder: fitted.append(known(rows, folder)) or fitted[-1])
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    assert embeddings.op2_embedding_dedup(spark, folder).count() == 500
    assert [sorted(x) for x in fitted] == [[64]]


def test_a_dense_group_gives_a_row_per_vector_and_task(tmp_path):
    rng = np.random.default_rng(6)
    n = 4096
    x = np.ones(16) + rng.normal(size=(n, 16)) * 1e-3
    rows = pd.DataFrame({"cid": np.arange(n), "n": np.ones(n, np.int64), "v": list(x), "d": 16})
    np.save(tmp_path / "a.npy", embeddings.principal_axes(x))
    axes = embeddings.Axes(str(tmp_path), {16: "a.npy"})
    tiles = pd.concat(embeddings._tiles(axes, str(tmp_path))(iter([rows])))
    assert len(tiles) == 4
    (tmp_path / "directory").mkdir()
    tiles.to_parquet(tmp_path / "directory" / "part.parquet")
    out = pd.concat(embeddings._compare(axes, str(tmp_path), str(tmp_path / "directory"), 0.95)(iter([tiles])))
    assert len(out) == 2 * n - 1 and (out[out["b"].isna()]["links"] == n - 1).all()
    assert {int(v) for v in out["a"]} == set(range(n))

"""Truncated decomposition against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wortnetz.operators import decomposition, matrix

SCHEMA = "row_id string, col_id string, value double"


def sparse(n, m, factors, seed=0):
    """Some strong factors and weak noise, most entries zero."""
    rng = np.random.default_rng(seed)
    strong = (rng.normal(size=(n, factors)) * np.linspace(9, 3, factors)) @ rng.normal(size=(factors, m))
    return np.where(rng.random((n, m)) < 0.9, strong + 0.1 * rng.normal(size=(n, m)), 0.0)


def coordinates(a):
    return [(f"r{i}", f"c{j}", float(a[i, j])) for i, j in zip(*np.nonzero(a))]


def cosines(v):
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    return unit @ unit.T


def embedded(df, n):
    got = {r["id"]: r["vec"] for r in df.collect()}
    assert set(got) == {f"r{i}" for i in range(n)}
    return np.array([got[f"r{i}"] for i in range(n)])


@pytest.fixture
def many_partitions(spark):
    """Partitions stay apart, and batches are small."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_leading_dimensions(spark, many_partitions):
    a = sparse(90, 60, 3)
    u, d, _ = np.linalg.svd(a, full_matrices=False)
    got = embedded(decomposition.truncated(spark.createDataFrame(coordinates(a), SCHEMA), 3), 90)
    assert got.shape == (90, 3)
    assert np.allclose(np.linalg.norm(got, axis=0), d[:3], rtol=1e-9)
    assert np.abs(cosines(got) - cosines(u[:, :3] * d[:3])).max() < 1e-6


def test_all_dimensions_keep_the_cosines_of_the_rows(spark):
    a = sparse(20, 12, 12)
    got = embedded(decomposition.truncated(spark.createDataFrame(coordinates(a), SCHEMA), 300), 20)
    assert got.shape == (20, 12) and np.abs(cosines(got) - cosines(a)).max() < 1e-9


def test_lower_rank_and_zeros(spark):
    a = np.outer([1.0, 2.0, 3.0, -1.0], [1.0, 0.0, 2.0]) + np.outer([0.0, 1.0, 1.0, 0.0], [0.0, 1.0, 0.0])
    got = embedded(decomposition.truncated(spark.createDataFrame(coordinates(a), SCHEMA), 3), 4)
    assert got.shape == (4, 2) and np.abs(cosines(got) - cosines(a)).max() < 1e-9
    zeros = spark.createDataFrame([("a", "x", 1.0), ("a", "x", -1.0), ("b", "y", 0.0), (None, "y", 1.0), ("c", "y", None)], SCHEMA)
    assert {(r["id"], tuple(r["vec"])) for r in decomposition.truncated(zeros, 3).collect()} == {("a", ()), ("b", ())}
    assert decomposition.truncated(spark.createDataFrame([], SCHEMA), 3).isEmpty()


def test_tree_of_triangles(spark):
    m = np.random.default_rng(4).normal(size=(50, 6))
    rows = decomposition.stored(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<double>").repartition(13, "id"))
    for fan in (2, 8):
        r = decomposition.triangle(rows, 6, fan)
        assert r.shape == (6, 6) and np.allclose(r.T @ r, m.T @ m)
    q, width = decomposition.orthonormal(rows.withColumn("vec", F.concat("vec", "vec")), 12)
    q = np.array([x["vec"] for x in q.collect()])
    assert width == 6 and np.allclose(q.T @ q, np.eye(6))


def test_embedding_of_common_answers(spark):
    counts = spark.createDataFrame([("a", "x", 9), ("a", "y", 4), ("b", "x", 6), ("b", "z", 7), ("c", "z", 5), ("d", "z", 2)], "cue string, response string, n long")
    got = {r["word"]: r["vec"] for r in matrix.svd_embedding(matrix.counts_matrix(counts, least=5), 300).collect()}
    want = np.array([[9.0, 0.0], [6.0, 7.0], [0.0, 5.0]])
    assert np.abs(cosines(np.array([got[w] for w in "abc"])) - cosines(want)).max() < 1e-9 and len(got) == 3

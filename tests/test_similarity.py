"""Similarity join and communities of similar rows, against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wortnetz.operators import similarity

SCHEMA = "row_id string, col_id string, value double"


def matrix(signs=(1,), rows=60, columns=25, seed=3):
    """Random rows; every third has one hot column, some are copies, some have the hot column alone."""
    rng = random.Random(seed)
    out = {}
    for r in range(rows):
        out[f"r{r:02}"] = {f"c{c}": float(rng.randint(1, 5) * rng.choice(signs)) for c in rng.sample(range(columns), rng.randint(1, 6))} | ({"hot": 4.0} if r % 3 == 0 else {})
    out |= {f"s{r}": dict(out["r05"]) for r in range(4)} | {f"t{r}": {"hot": 2.0 + r} for r in range(5)}
    return out


def coordinates(rows):
    return [(r, c, v) for r, entries in rows.items() for c, v in entries.items()]


def cosines(rows):
    dot = lambda x, y: sum(v * y.get(c, 0.0) for c, v in x.items())
    return {(a, b): dot(rows[a], rows[b]) / np.sqrt(dot(rows[a], rows[a]) * dot(rows[b], rows[b])) for a, b in itertools.combinations(sorted(rows), 2)}


def expanded(pairs, members):
    """Links between all rows."""
    of = {r["row_id"]: r["representative"] for r in members.collect()}
    known = {(r["a"], r["b"]): r["cosine"] for r in pairs.collect()}
    assert all(a < b for a, b in known)
    out = {}
    for a, b in itertools.combinations(sorted(of), 2):
        x, y = sorted((of[a], of[b]))
        if x == y:
            out[a, b] = 1.0
        elif (x, y) in known:
            out[a, b] = known[x, y]
    return out


@pytest.mark.parametrize("signs", [(1,), (1, -1)])
@pytest.mark.parametrize("threshold, block", [(0.2, 512), (0.5, 4), (0.9, 4), (1.0, 512)])
def test_all_pairs_and_no_others(spark, signs, threshold, block):
    rows = matrix(signs)
    got = expanded(*similarity.similar_rows(spark.createDataFrame(coordinates(rows), SCHEMA), threshold, block))
    want = {k: v for k, v in cosines(rows).items() if round(v, 9) >= threshold}
    assert len(want) > 10 and set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_a_cosine_of_the_threshold_is_a_link(spark):
    rows = {"a": {"x": 3.0, "y": 4.0}, "b": {"x": 7.0}, "c": {"y": 1.0}}
    pairs, _ = similarity.similar_rows(spark.createDataFrame(coordinates(rows), SCHEMA), 0.6)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {("a", "b"), ("a", "c")}
    pairs, _ = similarity.similar_rows(spark.createDataFrame(coordinates(rows), SCHEMA), 0.600001)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {("a", "c")}


def test_nulls_repeats_and_no_rows(spark):
    odd = [("a", "x", 1.0), ("a", "x", 2.0), ("b", "x", 3.0), ("c", "x", None), ("d", "x", float("nan")), ("e", "x", float("inf")), (None, "x", 1.0), ("f", None, 1.0), ("g", "x", 0.0), ("h", "y", 1.0), ("h", "x", -1.0), ("h", "x", 1.0)]
    pairs, members = similarity.similar_rows(spark.createDataFrame(odd, SCHEMA), 0.5)
    assert pairs.isEmpty()
    assert {tuple(r) for r in members.collect()} == {("a", "a", 2), ("b", "a", 2), ("h", "h", 1)}
    pairs, members = similarity.similar_rows(spark.createDataFrame([], SCHEMA), 0.5)
    assert pairs.isEmpty() and members.isEmpty() and similarity.clusters(pairs, members).isEmpty()
    with pytest.raises(ValueError):
        similarity.similar_rows(spark.createDataFrame([], SCHEMA), 0.0)


def test_a_hot_column_is_split_and_equal_rows_meet_once(spark):
    rows = {f"r{k:03}": {"hot": 10.0, f"own{k}": 1.0} for k in range(200)} | {f"s{k:03}": {"hot": 1.0} for k in range(300)}
    pairs, members = similarity.similar_rows(spark.createDataFrame(coordinates(rows), SCHEMA), 0.9, block=16)
    assert pairs.count() == 200 * 199 // 2 + 200  # the 300 equal rows are one
    assert members.where("representative = 's000'").count() == 300
    unit = similarity.normalize_rows(spark.createDataFrame([x for x in coordinates(rows) if x[0] <= "s000"], SCHEMA), "l2")
    leading = similarity.prefixes(unit, 0.9)
    blocks = leading.where("col_id = 'hot'").groupBy(F.pmod(F.xxhash64("row_id"), F.lit(13))).count()
    assert blocks.count() == 13 and blocks.agg(F.max("count")).first()[0] < 40


def test_link_counts(spark):
    rows = matrix()
    pairs, members = similarity.similar_rows(spark.createDataFrame(coordinates(rows), SCHEMA), 0.4)
    got = {r["row_id"]: (r["n_links"], r["strength"]) for r in similarity.link_counts(pairs, members).collect()}
    links = {k: v for k, v in cosines(rows).items() if round(v, 9) >= 0.4}
    for r in rows:
        mine = [v for k, v in links.items() if r in k]
        assert got[r] == (len(mine), pytest.approx(sum(mine)))


@pytest.mark.parametrize("small", [10**6, 20])
def test_clusters_of_planted_groups(spark, small):
    rng, rows = random.Random(1), {}
    for g in range(3):
        for k in range(8):
            rows[f"g{g}-{k}"] = {f"{g}-{c}": 1.0 + rng.random() for c in range(4)} | {"all": 0.5}
        rows |= {f"g{g}-copy{k}": dict(rows[f"g{g}-7"]) for k in range(3)}
    rows["lone"] = {"z": 1.0}
    pairs, members = similarity.similar_rows(spark.createDataFrame(coordinates(rows), SCHEMA), 0.02)
    assert pairs.where("substr(a, 1, 2) <> substr(b, 1, 2)").count() > 50  # weak links between the groups too
    got = {r["row_id"]: r["cluster"] for r in similarity.clusters(pairs, members, small=small).collect()}
    assert got == {r: "lone" if r == "lone" else f"{r[:2]}-0" for r in rows}

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wortnetz.functions import scalars
from wortnetz.operators import graph, ingest, lexical, matrix, models, publish, reshape, sampling, spelling, statistics
from wortnetz.session import stored


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_reshape(spark):
    df = spark.createDataFrame([(1, "a", None, "c", True, False, None)], "id long, r_1 string, r_2 string, r_3 string, f_1 boolean, f_2 boolean, f_3 boolean")
    long = reshape.wide_to_long(df, ["r", "f"], (1, 2, 3))
    assert rows(long) == [(1, 1, "a", True), (1, 2, None, False), (1, 3, "c", None)]
    assert reshape.long_to_wide(long, ["id"], "position", ["r", "f"], (1, 2, 3)).select(df.columns).collect() == df.collect()
    assert rows(reshape.unpivot_split(spark.createDataFrame([(1, 5, 6)], "id long, a_x int, b_y int"), ["id"], ["a_x", "b_y"], "_", ["k", "l"])) == [(1, "a", "x", 5), (1, "b", "y", 6)]
    assert reshape.cols_between(df, "r_2", "f_1") == ["r_2", "r_3", "f_1"] and reshape.cols_matching(df, "^f_") == ["f_1", "f_2", "f_3"]
    assert reshape.place(df, "new", F.lit(1), "id").columns[:3] == ["id", "new", "r_1"]
    assert rows(reshape.unique_of(df, "r_1", "r_3")) == [("a",), ("c",)]
    side = spark.createDataFrame([("a", 1, "b", 2), ("c", 3, None, None)], "w1 string, n1 int, w2 string, n2 int")
    assert rows(reshape.stack_side_by_side(side, [["w1", "n1"], ["w2", "n2"]], ["w", "n"])) == [("a", 1), ("b", 2), ("c", 3)]


def test_joins(spark):
    a, b = spark.createDataFrame([(1, "x", "l"), (2, "y", "l")], "pid long, s string, made string"), spark.createDataFrame([(1, "x", "r")], "id long, s string, made string")
    out = reshape.left_join_suffixed(a, b, {"pid": "id", "s": "s"}, ("_r", "_p"))
    assert out.columns == ["pid", "s", "made_r", "made_p"] and rows(out) == [(1, "x", "l", "r"), (2, "y", "l", None)]
    assert rows(reshape.membership(a, spark.createDataFrame([(1,), (1,)], "pid long"), "pid", "in_b").select("pid", "in_b")) == [(1, True), (2, False)]
    fix = spark.createDataFrame([("x", "X"), ("x", "Z")], "s string, new string")
    assert rows(reshape.lookup_replace(a, fix, "s", "new").select("pid", "s")) == [(1, "X"), (2, "y")]
    assert reshape.natural_join(a, b.select("s")).columns == ["s", "pid", "made"]


def test_sentinels_keep_one_row_per_trial(spark):
    t = spark.createDataFrame([(1, "Unbekanntes Wort", "ok", "?"), (2, "Keine Eingaben mehr", None, "b"), (3, "-", "c", "d")], "id long, response_1 string, response_2 string, response_3 string")
    got = ingest.mark_missing(t).orderBy("id").collect()
    assert [(r["response_1"], r["response_2"], r["response_3"], r["unknown_word"]) for r in got] == [(None, "ok", None, True), (None, None, "b", False), (None, "c", "d", False)]
    assert [r["no_further_response_3"] for r in got] == [True, False, False]


def test_scores_and_selection(spark):
    long = spark.createDataFrame([(1, "a b", False, False, True), (1, "a", False, False, None), (1, None, True, False, None), (2, "x", None, False, True), (3, None, True, True, None)], "id_p long, response string, unknown_word boolean, no_further_response boolean, ok boolean")
    people = spark.createDataFrame([(1, "DEU"), (1, "DEU"), (2, None), (3, "SCH"), (4, "SCH")], "id_p long, native_language string")
    got = {r["id_p"]: r for r in ingest.participant_scores(long, people, "ok").collect()}
    assert got[1]["score_n_gram"] == 0.5 and got[1]["score_unique_responses"] == 1 and got[1]["score_unknown_word"] == pytest.approx(1 / 3)
    assert got[2]["score_unknown_word"] is None and got[2]["score_native_speaker"] is False and got[3]["score_n_gram"] is None and got[4]["score_unknown_word"] is None
    report = {r["criterion"]: r for r in ingest.criteria_report(ingest.participant_scores(long, people, "ok"), spark.createDataFrame([(1,), (1,), (2,)], "id_p long")).collect()}
    assert report["score_n_gram"]["participants"] == 1 and report["score_n_gram"]["of_trials"] == 3


def test_cutoff_takes_the_least_of_ties(spark):
    t = spark.createDataFrame([(c, i) for c, n in (("a", 4), ("b", 2), ("c", 2)) for i in range(n)], "cue string, i int")
    assert rows(ingest.coverage_cutoff(t)) == [(2, 6, 0.75)]
    assert rows(ingest.coverage_cutoff(spark.createDataFrame([("a",)] * 100, "cue string"))) == [(70, 70, 0.7)]


def test_similar_pairs_against_all_pairs(spark):
    words = ["neid", "nied", "nie", "haus", "maus", "hau", "lang", "klang", "gesang", "x", "", "straße", "strasse"]
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string")
    every = df.select(F.col("w").alias("a")).crossJoin(df.select(F.col("w").alias("b"))).where("a <> b AND levenshtein(a, b) <= 2")
    assert rows(ingest.similar_pairs(df, df, "w", 2)) == rows(every)
    assert ("neid", "nied") in rows(ingest.similar_pairs(df, df, "w", 1, osa=True))
    assert ("neid", "nied") not in rows(ingest.similar_pairs(df, df, "w", 1))


def test_cues(spark):
    cues = spark.createDataFrame([("neid",), ("Spass",), ("gut",)], "cue string")
    kept, flagged = ingest.exclude_cues(spark.createDataFrame([("neid",), ("Spass",), ("fremd",)], "cue string"), cues, ["neid"], {"Spass": "Spaß"})
    assert rows(kept) == [("Spaß",)] and rows(flagged) == [("Spaß", False), ("gut", False), ("neid", True)]


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 AS g")
    for f in (lambda d: sampling.slice_sample(d, 5, ["g"], "id", 3), lambda d: sampling.sample_split(d, 100, "id", 3), lambda d: sampling.sample_groups(d, "g", [3, 500], "id", 3)):
        assert rows(f(df)) == rows(f(df.repartition(13)))
    assert sampling.slice_sample(df, 5, ["g"], "id", 3).count() == 35 and rows(sampling.slice_sample(df, 5, ["g"], "id", 3)) != rows(sampling.slice_sample(df, 5, ["g"], "id", 4))
    assert sampling.sample_groups(df, "g", [3, 500], "id", 3).count() in (145, 146)
    assert {r["part"]: r["count"] for r in sampling.sample_split(df, 100, "id", 3).groupBy("part").count().collect()} == {"train": 50, "test": 50}


def test_order(spark):
    df = spark.createDataFrame([("a", 3), ("b", None), ("c", 3), ("d", 1)], "w string, n int")
    assert rows(sampling.slice_max(df, [], "n", 1)) == [("a", 3), ("c", 3)]
    assert [r["w"] for r in sampling.top_n(df, 4, "n", "w").collect()] == ["a", "c", "d", "b"]
    assert rows(sampling.numbered(df, "w")) == [("a", 3, 1), ("b", None, 2), ("c", 3, 3), ("d", 1, 4)]
    assert [r["chunk"] for r in sampling.chunks(spark.range(101), 50, "id").orderBy("id").collect()] == [1] * 50 + [2] * 50 + [3]
    assert sampling.numbered(spark.range(0), "id").count() == 0
    assert sampling.head_share(spark.range(10), 0.15, F.desc("id")).collect()[0][0] == 9


def test_spelling(spark):
    d = spark.createDataFrame([("Straße",), ("Haus",), ("USA",), ("groß",), ("Weg",), ("weg",)], "word string")
    df = spark.createDataFrame([("Haus weg",), ("haus",), ("straße",), (None,), ("Haus xx",), ("",)], "w string")
    assert rows(spelling.multiword_ok(df, "w", d)) == rows(spark.createDataFrame([("Haus weg", True), ("haus", False), ("straße", False), (None, None), ("Haus xx", False), ("", False)], "w string, o boolean"))
    assert {r["w"]: r["spelling_ok"] for r in spelling.any_casing_ok(df, "w", d).collect()}["haus"] is True
    assert spelling.multiword_ok(df, "w", d, custom=spark.createDataFrame([("xx",)], "word string")).where("spelling_ok").count() == 2
    bad = spark.createDataFrame([("strasse gross",), ("usa",), ("WEG",), ("nichts",), (None,)], "w string")
    assert {r["w"]: r["improved"] for r in spelling.improve_phrases(bad, "w", d).collect()} == {"strasse gross": "Straße groß", "usa": "USA", "WEG": "Weg", "nichts": "nichts", None: None}


def test_words_are_looked_up_in_their_rows(spark, monkeypatch):
    d = spark.createDataFrame([("Haus",), ("weg",), (None,), ("weg",)], "word string")
    df = spark.createDataFrame([(1, "Haus weg"), (2, "haus"), (3, "weg"), (4, None), (5, "Haus xx"), (6, ""), (7, "weg "), (8, "Haus weg")], "id int, w string")
    plain = rows(spelling.multiword_ok(df, "w", d))
    there = spelling.multiword_ok(df, "w", d, most=2)
    assert rows(there) == plain and {r["id"]: r["spelling_ok"] for r in there.collect()} == {1: True, 2: False, 3: True, 4: None, 5: False, 6: False, 7: False, 8: True}
    assert "hashpartitioning" not in there._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="more than 1 words"):
        spelling.multiword_ok(df, "w", d, most=1).collect()
    monkeypatch.setattr(spelling, "BROADCAST_WORDS", 1)
    assert rows(spelling.multiword_ok(df, "w", d, most=2)) == plain


def test_phrases_are_improved_in_their_rows(spark, monkeypatch):
    d = spark.createDataFrame([("Straße",), ("Haus",), ("USA",), ("groß",), ("Weg",), ("weg",)], "word string")
    bad = spark.createDataFrame([("strasse gross",), ("usa",), ("WEG",), ("nichts",), (None,), ("",), ("haus ",), ("x haus",), ("usa",)], "w string")
    plain = rows(spelling.improve_phrases(bad, "w", d))
    there = spelling.improve_phrases(bad, "w", d, most=2)
    assert rows(there) == plain and {r["w"]: r["improved"] for r in there.collect()}["haus "] == "Haus "
    assert "hashpartitioning" not in there._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(spelling, "BROADCAST_WORDS", 0)
    assert rows(spelling.improve_phrases(bad, "w", d, most=2)) == plain


def test_audit(spark):
    df = spark.createDataFrame([(1, "a", "b", None), (2, "a", "a", True), (3, None, "b", None), (4, "a", None, False)], "id int, x string, y string, f boolean")
    assert [r["f"] for r in spelling.track(df, "x", "y", "f").orderBy("id").collect()] == [True, True, None, False]
    flags = spark.createDataFrame([(True, False, True), (None, None, False)], "a boolean, b boolean, c boolean")
    assert [r[0] for r in flags.select(spelling.corrections({"a": "first", "b": "second", "c": "third"})).collect()] == ["first,third", None]
    long = spark.createDataFrame([(1, "c", 1, "a", False), (1, "c", 2, None, None), (1, "c", 3, "z", False), (2, "d", 1, "ok", True)], "id_r long, cue string, position int, response string, spelling_ok boolean")
    assert rows(spelling.mask_one(long)) == [(1, "c", "WORD", None, "z", "a"), (1, "c", "a", None, "WORD", "z")]
    fixes = spark.createDataFrame([(1, "c", 3, "Z"), (9, "c", 3, "Q")], "id_r long, cue string, position int, model string")
    assert ("Z",) in rows(spelling.apply_corrections(long, fixes).select("response"))
    e = lambda r: tuple(spelling.correction_eval(spark.createDataFrame(r, "original string, gold string, model string")).first())
    assert e([("x", "y", "y"), ("x", "y", "q"), ("a", "a", "a"), ("a", "a", "b")]) == (0.5, 0.5, 0.5)
    assert e([("a", "a", "a")]) == (None, 0.0, 1.0) and e([("a", None, "a"), ("a", "a", "a")]) == (None, None, None)


def test_titles(spark):
    t = spark.createDataFrame([("haus", True, "Haus"), ("haus", True, "Hausbau"), ("x", False, None), ("y", True, "y")], "word string, wikipedia_page boolean, title string")
    assert rows(spelling.title_corrections(spark.createDataFrame([("haus",), ("x",), ("y",)], "word string"), "word", t)) == [("Haus",), ("x",), ("y",)]


def coo(spark, m):
    return spark.createDataFrame([(f"r{i}", f"r{j}", float(v)) for i, row in enumerate(m) for j, v in enumerate(row) if v], "row_id string, col_id string, value double")


def dense(df, n):
    out = np.zeros((n, n))
    for r in df.collect():
        out[int(r["row_id"][1:]), int(r["col_id"][1:])] = r["value"]
    return out


M = np.array([[4, 1, 0, 0], [1, 0, 2, 0], [0, 3, 5, 1], [2, 0, 0, 0]], float)


def test_matrices(spark):
    c = coo(spark, M)
    p = M / M.sum(1, keepdims=True)
    assert np.allclose(dense(matrix.normalize_rows(c), 4), p)
    assert np.allclose(dense(matrix.normalize_rows(c, "l2"), 4), M / np.linalg.norm(M, axis=1, keepdims=True))
    joint = M / M.sum()
    with np.errstate(divide="ignore"):
        want = np.maximum(0, np.log2(joint / np.outer(joint.sum(1), joint.sum(0))))
        assert np.allclose(dense(matrix.ppmi_joint(c), 4), want)
        assert np.allclose(dense(matrix.ppmi_colmean(matrix.normalize_rows(c)), 4), np.maximum(0, np.log2(p * 4 / p.sum(0))))
    k = np.linalg.inv(np.eye(4) - 0.75 * p)
    for method in ("dense", "series"):
        assert np.allclose(dense(matrix.katz(matrix.normalize_rows(c), 0.75, tol=1e-12, max_terms=200, method=method), 4), k, atol=1e-8)
    with pytest.raises(ValueError):
        matrix.katz(c, 0)
    unit = M / np.linalg.norm(M, axis=1, keepdims=True)
    pairs = spark.createDataFrame([("r0", "r1"), ("r2", "r3"), ("r0", "none")], "a string, b string")
    assert rows(matrix.cosine_pairs(c, pairs))[0][2] == 0 and {(r[0], r[1]): pytest.approx(r[2]) for r in rows(matrix.cosine_pairs(c, pairs))}[("r0", "r1")] == (unit @ unit.T)[0, 1]
    negative = spark.createDataFrame([("r0", "r1", -1.0), ("r1", "r0", 0.0)], "row_id string, col_id string, value double")
    assert matrix.normalize_rows(negative).count() == 0


def test_embeddings(spark):
    v = spark.createDataFrame([("a", [3.0, 4.0]), ("z", [0.0, 0.0])], "word string, vec array<double>")
    assert rows(matrix.l2_normalize(v)) == [("a", [0.6, 0.8]), ("z", [0.0, 0.0])]
    for limit in (4000, 2):
        old, matrix.DENSE_ROWS = matrix.DENSE_ROWS, limit
        try:
            e = {r["word"]: np.array(r["vec"]) for r in matrix.svd_embedding(coo(spark, M), 3).collect()}
        finally:
            matrix.DENSE_ROWS = old
        u, d, _ = np.linalg.svd(M)
        want = (u * d)[:, :3]
        x = np.stack([e[f"r{i}"] for i in range(4)])
        assert np.allclose(x @ x.T, want @ want.T, atol=1e-6)


EDGES = [("a", "b", 2), ("b", "c", 1), ("c", "a", 3), ("c", "d", 1), ("d", "e", 4), ("e", "d", 2), ("f", "f", 5), ("g", "h", 1)]


def edges(spark):
    return spark.createDataFrame(EDGES, "src string, dst string, weight long")


def test_graph_measures(spark):
    g = edges(spark)
    assert rows(graph.sizes(g)) == [(8, 8, 19)]
    assert dict(rows(graph.strengths(g)))["f"] == 10 and graph.mean_strength(g).first()[0] == 38 / 8
    c = {r["id"]: r["clustering"] for r in graph.local_clustering(g).collect()}
    assert c["a"] == 1 and c["c"] == pytest.approx(1 / 3) and c["e"] is None and c["f"] is None
    assert dict(rows(graph.weak_components(g))) == dict(a="a", b="a", c="a", d="a", e="a", f="f", g="g", h="g")
    want = dict(a="a", b="a", c="a", d="d", e="d", f="f", g="g", h="h")
    assert dict(rows(graph.strong_components(g))) == want == dict(rows(graph.strong_components(g, small=0)))
    inside, gone, sizes = graph.largest_component(g, "strong")
    assert {r["src"] for r in inside.collect()} == {"a", "b", "c"} and gone.count() == 5 and sizes.count() == 5


def test_distances(spark):
    g = edges(spark).where("src < 'f'")
    length = {(s, d): 5 - w for s, d, w in EDGES if s < "f"}
    names = "abcde"
    dist = {(x, y): 0 if x == y else math.inf for x in names for y in names}
    for (s, d), n in length.items():
        dist[s, d], dist[d, s] = min(dist[s, d], n), min(dist[d, s], n)
    for k in names:
        for x in names:
            for y in names:
                dist[x, y] = min(dist[x, y], dist[x, k] + dist[k, y])
    for small in (100, 0):
        assert {(r["a"], r["b"]): r["distance"] for r in graph.distances(g, small=small).collect()} == dist
    assert graph.mean_distance(g).first()[0] == pytest.approx(sum(dist.values()) / 25)
    assert graph.mean_distance(edges(spark)).first()[0] == math.inf


def test_communities_and_controls(spark):
    two = [(f"a{i}", f"a{j}", 1) for i in range(5) for j in range(i)] + [(f"b{i}", f"b{j}", 1) for i in range(5) for j in range(i)] + [("a0", "b0", 1)]
    g = stored(spark.createDataFrame(two, "src string, dst string, weight long"))
    m = {r["id"]: r["community"] for r in graph.louvain(g).collect()}
    assert len(set(m.values())) == 2 and len({m[f"a{i}"] for i in range(5)}) == 1
    assert graph.modularity(g, graph.louvain(g)).first()[0] == pytest.approx(20 / 21 - 0.5)
    r = stored(graph.random_graph(g, 1))
    assert (r.count(), r.distinct().count(), r.where("src = dst").count()) == (21, 21, 0) and r.agg(F.sum("weight")).first()[0] == 21
    assert graph.lattice(spark, 5, 2).count() == 7 and graph.lattice_graph(g, 3, 1).count() == 24
    assert "modularity" in graph.graph_metrics(g, directed=False).columns


def test_random_graph_draws_distinct_pairs(spark):
    for n in (2, 3, 7):  # all ranks give all pairs, each once
        got = [(r["p"], r["q"]) for r in graph.permuted_pairs(spark.range(n * (n - 1)), "id", n, 5).collect()]
        assert sorted(got) == [(p, q) for p in range(n) for q in range(n) if p != q]
    n, m = 100, 3000
    ring = [(k % n, (k % n + 1 + k // n) % n, k) for k in range(m)]
    g = stored(spark.createDataFrame(ring, "src long, dst long, weight long"))
    r = stored(graph.random_graph(g, 3))
    got = rows(r)
    assert len(got) == len({x[:2] for x in got}) == m and all(a != b for a, b, _ in got) and sorted(w for *_, w in got) == list(range(m))
    for end in (0, 1):  # degrees of m draws from n vertices: mean 30, standard deviation below 5.5
        degree = np.bincount([x[end] for x in got], minlength=n)
        assert degree.min() > 8 and degree.max() < 55 and 3 < degree.std() < 7
    assert sorted(rows(graph.random_graph(g.repartition(7), 3))) == sorted(got) and sorted(rows(graph.random_graph(g, 4))) != sorted(got)
    with pytest.raises(ValueError):
        graph.random_graph(spark.createDataFrame([(1, 1, 1), (1, 2, 1), (2, 1, 1)], "src long, dst long, weight long"), 1)


def test_statistics(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=200)
    y, z = x + rng.normal(size=200), x * 0.3 + rng.normal(size=200)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, y, z)] + [(1.0, None, 2.0)], "x double, y double, z double")
    r = np.corrcoef(x, y)[0, 1]
    t = statistics.correlation_tests(df, "x", "y").first()
    assert t["n"] == 200 and t["r"] == pytest.approx(r) and t["ci_lower"] == pytest.approx(math.tanh(math.atanh(r) - 1.959963984540054 / math.sqrt(197))) and t["p_value"] < 1e-9
    assert statistics.steiger_tests(df, "x", "y", "z").first()["p_value"] < 0.05
    flipped = statistics.absolute(spark.createDataFrame([(-0.5, -0.6, -0.4)], "r double, ci_lower double, ci_upper double"))
    assert rows(flipped) == [(0.5, 0.4, 0.6)]
    assert rows(statistics.spread(spark.createDataFrame([(1.0, 2.0), (4.0, 2.0)], "a double, b double"), ["a", "b"])) == [(0.75, 0.0, 0.75)]
    k = statistics.kernel_density(df, "x", -4, 4, 33, 0.4).orderBy("x").collect()
    want = [np.exp(-(((p["x"] - np.append(x, 1.0)) / 0.4) ** 2) / 2).mean() / (0.4 * math.sqrt(2 * math.pi)) for p in k]
    assert np.allclose([p["density"] for p in k], want, atol=0.01)


def test_ridge(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    y = x @ [1.0, -2.0, 0.5, 0.0] + rng.normal(size=300) * 0.3
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(300)] + [(999, None, 1.0)], "id long, v array<double>, y double")
    predictions, best = models.ridge_cv(df, "y", "v", "id", penalties=(1e-6, 1.0, 100.0), folds=3)
    assert best == 1e-6 and models.r_squared(predictions).first()[0] > 0.95
    row = models.bootstrap_rsq(predictions, "id", 200).first()
    assert row["ci_lower"] < row["rsq"] < row["ci_upper"]


def test_ridge_grid_equals_its_cells(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 5))
    y = np.column_stack([x @ [1.0, -2.0, 0.5, 0.0, 0.0], x @ [0.0, 0.0, 0.0, 1.0, 1.0]]) + rng.normal(size=(400, 2)) * 0.5
    data = [(i, x[i].tolist(), float(y[i, 0]) if i % 3 else None, float(y[i, 1]) if i % 7 else None, None) for i in range(400)] + [(999, None, 1.0, 1.0, None)]
    df = spark.createDataFrame(data, "id long, v array<double>, a double, b double, none double").repartition(5)
    sets = {"head": [0, 1], "tail": [4, 2, 3], "all": range(5)}
    options = {"penalties": (1e-6, 0.1, 1.0), "folds": 4}
    grid = models.ridge_grid(df, ["a", "b", "none"], sets, "v", "id", **options)
    got = {}
    for r in grid.collect():
        got.setdefault((r["word_property"], r["data"], r["penalty"]), {})[r["id"]] = (r["label"], r["prediction"])
    want = {}
    for prop in ("a", "b"):
        for name, places in sets.items():
            cut = df.withColumn("v", F.when(F.col("v").isNotNull(), F.array(*(F.get("v", F.lit(p)) for p in places))))
            predictions, penalty = models.ridge_cv(cut, prop, "v", "id", **options)
            want[prop, name, penalty] = {r["id"]: (r["label"], r["prediction"]) for r in predictions.collect()}
    assert got.keys() == want.keys() and len(want) == 6
    for cell in want:
        assert got[cell].keys() == want[cell].keys() and all(np.allclose(got[cell][k], v) for k, v in want[cell].items())
    table = {(r["word_property"], r["data"]): r for r in models.ridge_table(df, ["a", "b", "none"], sets, "v", "id", 50, **options).collect()}
    assert len(table) == 6 and table["a", "head"]["rsq"] > 0.7 > table["a", "tail"]["rsq"] and table["b", "tail"]["rsq"] > 0.7 > table["b", "head"]["rsq"]
    assert all(r["ci_lower"] <= r["ci_upper"] for r in table.values())
    none = df.where("id < 0")
    assert models.ridge_grid(none, ["a"], sets, "v", "id").count() == models.ridge_table(none, ["a"], sets, "v", "id", 5).count() == 0


def test_chosen_penalty_is_the_one_of_plain_cross_validation(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 12)) * np.linspace(0.2, 3, 12)
    y = x @ rng.normal(size=12) * 0.3 + rng.normal(size=150) * 3
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(150)], "id long, v array<double>, y double")
    grid, folds = (1e-6, 0.01, 0.1, 0.5, 2.0, 8.0), 5
    predictions, best = models.ridge_cv(df, "y", "v", "id", penalties=grid, folds=folds)
    u = {r["id"]: (r["u"], r["f"]) for r in df.select("id", models.uniform(1984, "id").alias("u"), F.floor(models.uniform(1985, "id") * folds).alias("f")).collect()}
    train = np.array([u[i][0] < models.TRAIN_SHARE for i in range(150)])
    fold = np.array([u[i][1] for i in range(150)])
    z = (x - x[train].mean(0)) / x[train].std(0, ddof=1)

    def fit(rows, p):
        a, b = z[rows] - z[rows].mean(0), y[rows] - y[rows].mean()
        w = np.linalg.solve(a.T @ a / len(a) + p / y[rows].std() * np.eye(12), a.T @ b / len(a))
        return y[rows].mean() - z[rows].mean(0) @ w, w

    def error(p):
        out = 0.0
        for k in range(folds):
            c, w = fit(train & (fold != k), p)
            out += ((y - c - z @ w)[train & (fold == k)] ** 2).sum()
        return out

    assert best == min(grid, key=error) and best not in (grid[0], grid[-1])
    c, w = fit(train, best)
    assert all(np.isclose(r["prediction"], (c + z @ w)[r["id"]]) for r in predictions.collect()) and predictions.count() == (~train).sum()


def test_resamples_are_exact(spark):
    for rows_ in (1, 63, 64, 65, 500):  # every resample has as many rows as the table, and each row is drawn alike
        c = np.hstack([models.drawn_copies(rows_, k, 400, 9, 64) for k in range(-(-rows_ // 64))])
        assert c.shape == (400, rows_) and (c.sum(1) == rows_).all() and abs(c.mean(0) - 1).max() < 0.3
    assert abs(c.var() - 1 + 1 / 500) < 0.03 and abs(np.corrcoef(c[:, 0], c[:, 499])[0, 1]) < 0.2
    rng = np.random.default_rng(5)
    x = rng.normal(size=300)
    y = x + rng.normal(size=300)
    df = spark.createDataFrame([(g, i, float(x[i]), float(y[i] if g == "p" else y[-i])) for g in ("p", "q") for i in range(300 if g == "p" else 90)] + [(None, 1, 1.0, 2.0)], "g string, id long, label double, prediction double")
    sums = stored(models.resample_sums(df, "id", 200, 1, ["g"], 64))
    assert {(r["g"], r["n"]) for r in sums.collect()} == {("p", 300.0), ("q", 90.0), (None, 1.0)} and sums.count() == 600
    again = models.resample_sums(df.repartition(7), "id", 200, 1, ["g"], 64)
    key = lambda r: (str(r[0]), r[1])
    assert np.allclose([list(r)[2:] for r in sorted(sums.collect(), key=key)], [list(r)[2:] for r in sorted(again.collect(), key=key)])
    got = models.bootstrap_rsq(df.where("g = 'p'"), "id", 2000).first()
    draws = rng.integers(0, 300, size=(4000, 300))
    plain = np.quantile([np.corrcoef(x[d], y[d])[0, 1] ** 2 for d in draws], [0.025, 0.975])
    assert np.allclose([got["ci_lower"], got["ci_upper"]], plain, atol=0.015) and got["rsq"] == pytest.approx(np.corrcoef(x, y)[0, 1] ** 2)


def test_published_trials(spark):
    t = spark.createDataFrame([(1, 7, 2.0, 48.2), (2, 7, 99.0, 48.2)], "id_r long, id_p long, age double, latitude double").selectExpr("id_r", "id_p", "CASE WHEN id_r = 1 THEN timestamp'2016-08-17 21:06:11' ELSE timestamp'2020-05-05 05:05:05' END AS created_at", "cast(age AS int) AS age", "'female' AS gender", "NULL AS education_label", "NULL AS native_language_label", "latitude", "16.3712 AS longitude")
    long = spark.createDataFrame([(i, "set2", "c", False, p, f"R{p}", f"r{p}", False, True, None) for i in (1, 2) for p in (1, 2, 3)], "id_r long, section string, cue string, unknown_word boolean, position int, response_corrected string, response string, no_further_response boolean, spelling_ok boolean, corrections string")
    people = spark.sql("SELECT 7L AS id, timestamp'2019-01-01 12:00:00' AS created_at UNION ALL SELECT 7L, timestamp'2018-01-01 12:00:00'")
    geo = spark.createDataFrame([(48.2, 16.37, "Wien", "W", "AT")] * 2, "latitude double, longitude double, locality string, region string, country string")
    got = publish.published(t, long, people, geo).orderBy("trial_id").collect()
    assert [str(r["created_at"]) for r in got] == ["2018-01-01 00:00:00", "2020-05-05 05:05:05"] and [r["age"] for r in got] == [2, None]
    assert got[0]["locality"] == "Wien" and got[0]["section"] == 2 and got[0]["response_corrected_3"] == "R3" and len(got) == 2
    trials = spark.createDataFrame([(c, i) for c, n in (("a", 3), ("b", 2), ("c", 1)) for i in range(n)], "cue string, k int").withColumn("trial_id", F.monotonically_increasing_id())
    trials = stored(trials)
    sample, plus, every = publish.fixed_size(trials, 2)
    assert (sample.count(), plus.count(), every.count()) == (4, 5, 6) and every.where("in_sample").count() == 4


def test_lexical(spark):
    long = spark.createDataFrame([("x", "a"), ("x", "a"), ("x", "b"), ("y", "c"), ("y", None)], "cue string, response string")
    counts = lexical.associations(long)
    assert rows(lexical.top_associations(counts, 1)) == [("x", "a", 2, 1), ("y", "c", 1, 1)]
    got = lexical.types_tokens(long, "response", spark.createDataFrame([("c",)], "cue string")).first()
    assert (got["n_types"], got["n_tokens"], got["n_hapax"], got["cue_types"], got["cue_tokens"]) == (3, 4, 2, 1, 0.25)
    assert rows(lexical.rank_curve(lexical.frequencies(long, "response"), "response"))[0][:3] == ("a", 2, 1)
    assert scalars.SCALES["twenty"] == (1.0, 20.0)


def test_unified(spark):
    a = spark.createDataFrame([(1, "q", "#Missing")], "id long, c string, r string")
    b = spark.createDataFrame([("w", "v")], "cue string, one string")
    out = ingest.unified({"nl": a, "en": b}, {"nl": {"trial_id": "id", "cue": "c", "response_1": "r"}, "en": {"cue": "upper(cue)", "response_1": "one", "response_2": "cast(NULL AS string)"}}, ["#Missing"])
    assert rows(out.select("trial_id", "cue", "response_1", "response_2", "dataset")) == [(1, "q", None, None, "nl"), (None, "W", "v", None, "en")]


def test_components_with_hubs(spark, monkeypatch):
    """Stars whose centre is the smallest, the largest and a middle vertex, chains and random links, few rows making a hub."""
    import random

    monkeypatch.setattr(graph, "HUB_ROWS", 4)
    rng = random.Random(5)
    links = [(0, k) for k in range(1, 300)] + [(k, 1299) for k in range(1000, 1299)] + [(k, 2150) for k in range(2000, 2300) if k != 2150]
    links += [(3000 + k, 3001 + k) for k in range(60)] + [(rng.randrange(4000, 4300), rng.randrange(4000, 4300)) for _ in range(200)]
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in links:
        p, q = sorted((root(a), root(b)))
        parent[q] = p
    got = dict(rows(graph.weak_components(spark.createDataFrame(links, "src long, dst long").repartition(7))))
    assert got == {v: root(v) for v in parent}


def test_ridge_path_is_that_of_the_library(spark):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 5)) * [1, 2, 0.5, 3, 1] + 4
    y = x @ [1.0, -2.0, 0.5, 0.0, 3.0] + rng.normal(size=200)
    df = spark.createDataFrame([(k % 3, x[k].tolist(), float(y[k])) for k in range(200)], "f int, x array<double>, y double").repartition(4)
    per = models.moments(df, "f", "x", "y")
    assert sorted(per) == [0, 1, 2]
    rows_ = df.select(array_to_vector("x").alias("features"), F.col("y").alias("label"))
    for p, w in zip((1e-4, 0.3, 20.0), models.ridge_path(sum(per.values()), (1e-4, 0.3, 20.0))):
        fit = LinearRegression(regParam=p, elasticNetParam=0.0, solver="normal", standardization=False).fit(rows_)
        assert np.allclose(w, [fit.intercept, *fit.coefficients], atol=1e-6)


def test_louvain_of_large_graphs(spark, monkeypatch):
    import random

    monkeypatch.setattr(graph, "MOVE_ROUNDS", 4)
    rng = random.Random(2)
    links = [(g * 20 + a, g * 20 + b) for g in range(8) for a in range(20) for b in range(a) if rng.random() < 0.5]
    links += [tuple(sorted(rng.sample(range(160), 2))) for _ in range(60)]
    edges = spark.createDataFrame([(f"v{a:03}", f"v{b:03}", 1) for a, b in links], "src string, dst string, weight long").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    edges = stored(edges)
    whole = graph.modularity(edges, stored(graph.louvain(edges))).first()[0]
    parts = stored(graph.louvain(edges, edges.count() - 1))  # one level in rounds, then a smaller graph in one task
    assert parts.count() == graph.vertices(edges).count() and dict(parts.dtypes) == {"id": "string", "community": "bigint"}
    assert graph.modularity(edges, parts).first()[0] > 0.95 * whole


def test_rounds_of_louvain_deal_links_out_once(spark, monkeypatch):
    plans = []

    def noted(df):
        if "moved" in df.columns:
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df)

    monkeypatch.setattr(graph, "stored", noted)
    monkeypatch.setattr(graph, "MOVE_ROUNDS", 2)
    edges = spark.createDataFrame([(a, b, 1) for g in range(3) for a in range(g * 4, g * 4 + 4) for b in range(g * 4, a)], "src long, dst long, weight long")
    found = {r["id"]: r["community"] for r in graph._moved(edges, 12).collect()}
    assert len(found) == 12 and all(found[a] // 4 == a // 4 for a in found)
    assert len(plans) == 3 and all("InMemoryRelation" in p for p in plans[1:])


def test_nearest_vectors_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(matrix, "QUERY_BLOCK", 7)
    monkeypatch.setattr(matrix, "TILE", 2)
    rng = np.random.default_rng(5)
    vectors = [[float(x) for x in v] for v in rng.normal(size=(120, 4))]
    for k, v in {3: [0.0] * 4, 10: None, 11: vectors[12], 13: vectors[12], 20: [1.0, None, 2.0, 3.0], 31: [1.0, 2.0], 44: vectors[40], 50: [float("nan")] * 4}.items():
        vectors[k] = v
    e = matrix.l2_normalize(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(3), "embedding")
    q = e.where("vec_id % 4 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    pairs = e.join(q, F.col("query") != F.col("vec_id")).select("query", "vec_id", F.round(matrix.dot("q", "embedding"), 6).alias("cosine"))
    best = lambda df: sorted(map(str, sampling.slice_max(df, ["query"], "cosine", 5).collect()))
    found = matrix.nearest(e, F.col("vec_id") % 4 == 0, 5)
    assert best(found) == best(pairs) and found.count() < pairs.count()


def test_membership_of_a_frequent_key_deals_no_rows_out(spark):
    df = spark.createDataFrame([(1, k) for k in range(50)] + [(None, 50), (3, 51)], "w long, k long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = reshape.membership(df, spark.createDataFrame([(1,), (1,), (2,)], "w long"), "w", "there")
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["k"] for r in out.where("there").collect()) == list(range(50)) and out.where("there IS NULL").isEmpty()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_random_graph_makes_digests_once(spark):
    g = spark.createDataFrame([(k, k + 1, 1) for k in range(20)], "src long, dst long, weight long")
    assert "md5" not in graph.random_graph(g, 1)._jdf.queryExecution().optimizedPlan().toString()


def test_components_read_their_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def noted(v):
        seen.add(1)
        return v

    edges = lambda: spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 1, 1), (5, 6, 1)], "src long, dst long, weight long").withColumn("src", noted("src"))
    assert {(r["id"], r["component"]) for r in graph.weak_components(edges()).collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)}
    assert seen.value == 4


def test_largest_component_reads_its_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def noted(v):
        seen.add(1)
        return v

    edges = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 1, 1), (5, 6, 1)], "src long, dst long, weight long").withColumn("src", noted("src"))
    assert graph.largest_component(edges, "strong")[0].count() == 3 and seen.value == 4


def test_rounds_of_louvain_move_a_row_per_vertex(spark, monkeypatch):
    plans = []

    def noted(df):
        if "moved" in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df)

    monkeypatch.setattr(graph, "stored", noted)
    ids = [-(2**63), -5, 0, 7, 40, 2**62, 100, 101, 102, 103]
    edges = spark.createDataFrame([(a, b, w) for w, part in ((1.5, ids[:6]), (0.5, ids[6:])) for a in part for b in part if a < b] + [(7, 7, 0.25), (None, 7, 1.0)], "src long, dst long, weight double")
    few = {r["id"]: r["community"] for r in graph.louvain(edges, 3).collect()}
    assert len(plans) > 2 and not any("Exchange" in p.partition("InMemoryTableScan")[0] for p in plans if "InMemoryTableScan" in p)
    assert set(few) == set(ids) and len({few[v] for v in ids[:6]}) == len({few[v] for v in ids[6:]}) == 1 and few[0] != few[100]
    monkeypatch.setattr(graph, "BROADCAST_VERTICES", 0)  # links are dealt out in each round
    assert {r["id"]: r["community"] for r in graph.louvain(edges, 3).collect()} == few
    nothing = graph.louvain(spark.createDataFrame([(1, 2, 0), (2, 3, 0)], "src long, dst long, weight long"), 1)  # no weight: each is its own
    assert len({r["community"] for r in nothing.collect()}) == 3

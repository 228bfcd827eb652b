"""The queries of plans.forms against their SQL, and small cases of what they use."""

import os

import pytest
from pyspark.sql import functions as F

from wortnetz.functions import text
from wortnetz.operators import graph, reshape
from wortnetz.plans import forms
from wortnetz.sources import enrich, readers

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    key = lambda r: sorted((k, str(v)) for k, v in r.items())
    wrong = []
    for name, query in forms.QUERIES.items():
        try:
            result = con.execute(forms.SQL[name])
            names = [c[0] for c in result.description]
            want = sorted(key(dict(zip(names, r))) for r in result.fetchall())
            got = sorted(key(r.asDict()) for r in query(spark, SF).collect())
            if got != want or not got:
                wrong.append((name, len(got), len(want), [x for x in got if x not in want][:1], [x for x in want if x not in got][:1]))
        except Exception as e:  # every query is tried
            wrong.append((name, str(e)[:300]))
    assert not wrong, wrong


def test_binds(spark):
    a = spark.createDataFrame([(2, "b"), (1, "a")], "k int, x string")
    b = spark.createDataFrame([("z",), (None,), ("y",)], "y string")
    assert sorted(map(tuple, reshape.bind_columns(a, ["k"], b, ["y"]).collect()), key=repr) == [(1, "a", None), (2, "b", "y"), (None, None, "z")]
    assert reshape.bind_present([None, a, None]).count() == 2
    assert [r[0] for r in a.orderBy("k").select(reshape.level(F.col("x"), ["b"])).collect()] == [None, 1]


def test_remove_first(spark):
    df = spark.createDataFrame([("a.b.c",), ("",), (None,), ("...",)], "x string")
    assert [r[0] for r in df.select(text.remove_first(F.col("x"), ".")).collect()] == ["ab.c", "", None, ".."]


def test_guess_separator(spark, tmp_path):
    (tmp_path / "a.csv").write_text('w;n\n"a;b";1,5\nx, y;2\n')
    (tmp_path / "b.csv").write_text("one\ntwo\n")
    (tmp_path / "c.csv").write_text("")
    assert [readers.guess_separator(spark, f"{tmp_path}/{x}.csv") for x in "abc"] == [";", ",", ","]


def test_secret(monkeypatch):
    monkeypatch.setenv("SOME_KEY", "abc")
    assert enrich.Secret("SOME_KEY").value() == "abc" and "abc" not in repr(enrich.Secret("SOME_KEY"))
    with pytest.raises(ValueError, match="OTHER_KEY"):
        enrich.Secret("OTHER_KEY").value()


def test_metrics_by(spark):
    links = [("x", 1, 2, 1), ("x", 2, 3, 4), ("x", 3, 1, 2), ("x", 3, 4, 1), ("y", 1, 2, 5), ("z", 1, 2, 1), ("z", 8, 9, 3), (None, 1, 2, 1)]
    edges = spark.createDataFrame(links, "part string, src long, dst long, weight long")
    for directed in (True, False):
        got = {r["part"]: r.asDict() for r in graph.metrics_by(edges, "part", directed).collect()}
        assert {k: (r["n_nodes"], r["n_edges"], r["n_components"], r["n_giant_component"]) for k, r in got.items()} == {"x": (4, 4, 1, 4), "y": (2, 1, 1, 2), "z": (4, 2, 2, 2)}
        assert got["x"]["aspl"] == 2 * (4 + 1 + 3 + 5 + 4 + 7) / 16  # lengths 4, 1, 3, 4 within the part
        for part in ("x", "z"):
            alone = graph.graph_metrics(edges.where(f"part = '{part}'").drop("part"), directed).first().asDict()
            assert {k: v for k, v in got[part].items() if k != "part"} == pytest.approx(alone)
    assert got["z"]["aspl"] == float("inf") and got["y"]["aspl"] == 0.5 and "modularity" in got["x"]

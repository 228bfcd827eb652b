import os

import pytest

import __spark_entry__
from wortnetz.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_names():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["cue", "response", "n", "rank"] and df.count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ["random_graph", "participant_scores", "coverage_cutoff", "multiword", "components_strong", "edges_undirected"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    df = catalogue.QUERIES[name](spark, SF)
    result = con.execute(catalogue.SQL[name])
    names = [c[0] for c in result.description]
    want = [dict(zip(names, r)) for r in result.fetchall()]
    key = lambda r: sorted((k, str(v)) for k, v in r.items())
    assert sorted(map(key, want)) == sorted(key(r.asDict()) for r in df.collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_pairs_of_words_are_not_dealt_out_to_be_checked(spark):
    plan = catalogue.QUERIES["multiword"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(response" not in plan and "SortMergeJoin" not in plan

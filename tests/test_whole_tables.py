"""Queries without SQL read their tables whole; on small tables, against brute force."""

import pytest

from wortnetz.functions import text
from wortnetz.plans import catalogue


def test_louvain_modularity_reads_every_order(spark, tmp_path):
    links = [(1, 2), (2, 3), (3, 1), (4, 5), (5, 6), (6, 4)]  # two triangles; no order's key is divisible by ten
    lines = [(k, n, p, 1) for k, link in enumerate(links, 1) for n, p in enumerate(link, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, 1, "1", None) for k in range(1, 7)], "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    best = max(modularity(links, split) for split in splits(range(1, 7)))
    assert best == 0.5
    assert catalogue.QUERIES["louvain_modularity"](spark, str(tmp_path)).first()[0] == pytest.approx(best)


def test_similar_cues_osa_takes_rare_and_accented_words(spark, tmp_path):
    english, french = "House the été a nation night Forms éét x", "hosue tête été en nations nuit formes à xylophone"
    spark.createDataFrame([(1, english, "en"), (2, french, "fr"), (3, "hause", "de")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(a, b) for a in english.lower().split() for b in french.lower().split() if a != b and text.osa(a, b) <= 2}
    assert {("house", "hosue"), ("éét", "été")} <= want
    assert {tuple(r) for r in catalogue.QUERIES["similar_cues_osa"](spark, str(tmp_path)).collect()} == want


def splits(nodes):
    """All ways to put nodes into communities."""
    first, *rest = nodes
    for split in splits(rest) if rest else [[]]:
        yield [[first], *split]
        for k in range(len(split)):
            yield [*split[:k], [first, *split[k]], *split[k + 1 :]]


def modularity(links, split):
    m = len(links)
    return sum(sum(a in c and b in c for a, b in links) / m - (sum((a in c) + (b in c) for a, b in links) / (2 * m)) ** 2 for c in split)


def test_geo_dedup_gives_zero_itself_no_place(spark, tmp_path):
    spark.createDataFrame([(1, 0.0, 0), (2, 0.1, 1), (3, 0.2, 0), (4, None, 0)], "c_custkey long, c_acctbal double, c_nationkey int").selectExpr("*", "'x' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, "A", 0), (1, "B", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(0, "R")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    got = {tuple(r) for r in catalogue.QUERIES["geo_dedup"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0, 0, None, None), (2, 0, 0, 2, "B"), (3, 0, 0, 2, "B"), (4, None, None, None, None)}

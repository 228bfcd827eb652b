import hashlib
import random
import re
from collections import Counter, defaultdict

from tests.llm.conftest import prose
from wortnetz.llm.exact_dedup import digests, exact_dedup, keep_first, tree_merge


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = []
    for bare, g in groups.items():
        best = min(g, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        out += [(i, best[0], len(g), hashlib.sha256(bare.encode()).hexdigest()) for i, _ in g]
    return Counter(out)


def test_against_brute_force_for_any_order_of_the_rounds(docs):
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    for order in (1, 2, 4):
        got = exact_dedup(docs, order=order).collect()
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
        assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter({r["text_sha256"]: 1 for r in got})


def test_one_row_of_each_group_stays_with_its_columns(docs):
    rows = keep_first(docs).collect()
    assert keep_first(docs).columns == docs.columns
    assert len(rows) == len({re.sub(r"\s", "", r["text"] or "") for r in docs.collect()})
    assert all(r["doc_id"] != 32 for r in rows if r["text"] == "")


def test_empty_table(no_docs):
    assert exact_dedup(no_docs).count() == 0 and keep_first(no_docs).count() == 0


def test_any_number_of_runs_gives_the_same_rows(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "concat(if(id % 3 = 0, 'hot', cast(id % 700 AS string)), repeat(' ', cast(id % 5 AS int))) AS text")
    want = brute([(r["doc_id"], r["text"]) for r in df.collect()])
    for n in (1, 2, 64):
        got = exact_dedup(df.repartition(n)).collect()
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    from pyspark.sql import functions as F

    plan = tree_merge(digests(df.repartition(64)).withColumn("rid", F.monotonically_increasing_id()))._jdf.queryExecution().executedPlan().toString()
    rounds = re.findall(r"Exchange hashpartitioning\(run#\d+, slice#\d+, \d+\)", plan)
    assert len(rounds) >= 2 and "SortAggregate" in plan  # after the first of three rounds, sorted runs are exchanged in slices


def test_very_long_texts(spark):
    text = prose(random.Random(2), 300_000)  # over 1 MB
    rows = [(1, text), (2, text.replace(" ", "\n")), (3, text + " "), (4, text[:-1])]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (3, 3), 2: (3, 3), 3: (3, 3), 4: (4, 1)}

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import prose
from wortnetz.llm import audit


def brute(rows, labels):
    """The contract, row by row and order by order."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    fails = []
    for i, text, part in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
        }
        fails.append((part or "", {f for f, x in bad.items() if x}, i in good, i in toxic))
    return fails


def expected(fails, names):
    out = {}
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        shapley = Counter()
        for order in itertools.permutations(names):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in x[1] for x in mine) - len(gone), sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def collected(df):
    rows = df.collect()
    out = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture
def rows(texts):
    rng = random.Random(3)
    more = [prose(rng, 60), prose(rng, 60) + " A & B", "WORD " * 60, prose(rng, 70).upper(), " ".join(map(str, range(60))), "no-break\u00a0space " * 30]
    all_texts = texts + more + more[:3]
    out = [(i, t, [None, "", "web", "hot", "hot"][i % 5]) for i, t in enumerate(all_texts)]
    return out + [(None, more[0], "web"), (None, more[0], "web"), (3, all_texts[3], "hot"), (3, all_texts[3], "hot"), (7, more[1], None)]


LABELS = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 50, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, None)]


def test_against_brute_force(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, part string, bits int").repartition(5)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = collected(audit.interactions(*audit.failing(docs, labels)))
    assert got == expected(brute(rows, LABELS), "ABCDE")
    assert {p for p, _, _ in got} == {"", "web", "hot"} and len(got) == 3 * 600


def test_empty_table_and_no_labels(spark, rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert audit.interactions(*audit.failing(docs.limit(0), none)).count() == 0
    got = collected(audit.interactions(*audit.failing(docs, none)))
    assert got == expected(brute(rows, []), "ABCDE") and not any(v[4] or v[5] for v in got.values())


def test_bitmaps_count_as_sets_do():
    rng = np.random.default_rng(1)
    part, bits, k = rng.integers(0, 70, 5000), rng.integers(0, 1 << 5, 5000), 3
    part = np.unique(part, return_inverse=True)[1]
    got = audit.bitmap_counts(part, bits, k)
    for p in range(part.max() + 1):
        b = bits[part == p]
        for i, (s, f) in enumerate(audit.steps(k)):
            gone = (b & s == 0) & (b >> f & 1 == 1)
            assert got[p, i].tolist() == [int((b & (s | 1 << f) == 0).sum()), int(gone.sum()), int((gone & (b >> k & 1 == 1)).sum()), int((gone & (b >> k + 1 & 1 == 1)).sum())]


def test_many_parts_other_filters_and_their_number(spark, monkeypatch):
    monkeypatch.setattr(audit, "HELD_PARTS", 10)
    data = [(f"p{i % 97}", (i * 37) % 32) for i in range(3000)]
    df = spark.createDataFrame(data, "part string, bits int").repartition(3)
    fails = [(p, {f for j, f in enumerate("xyz") if b >> j & 1}, bool(b & 8), bool(b & 16)) for p, b in data]
    assert collected(audit.interactions(df, "xyz")) == expected(fails, "xyz")
    total = df.count()
    assert audit.interactions(df, "xyz").where("step = 3").selectExpr("filter_order", "kept").groupBy("filter_order").sum().count() == math.factorial(3) and total == 3000
    with pytest.raises(ValueError):
        audit.interactions(df, "abcdefgh")


def test_one_text_of_most_rows_and_long_texts(spark):
    long = prose(random.Random(2), 250_000)  # over 1 MB
    rows = [(i, "same text", "hot") for i in range(1500)] + [(2000, long, "long"), (2001, long, "long")] + [(3000 + i, f"text {i}", "rest") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = collected(audit.interactions(*audit.failing(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))))
    assert got["hot", "EABCD", 1][:2] == [1, 1499] and got["long", "EABCD", 1][:2] == [1, 1] and got["rest", "EABCD", 1][:2] == [300, 0]

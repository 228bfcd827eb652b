import random

import numpy as np
import pandas as pd
import pytest

from tests.llm.conftest import prose
from wortnetz.llm import near, simhash


def family(rng, base, n, most):
    words = base.split()
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randint(1, most)):
            w[rng.randrange(len(w))] = rng.choice(["zig", "zag", "zug"])
        yield " ".join(w)


def sets(texts):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_prints_and_sketches(texts):
    p = near.prints([t or "" for t in texts])
    for k, t in enumerate(texts):
        assert int(np.int64(p["fp"][k]).view(np.uint64)) == simhash.fingerprint(t or "", 5)
        assert p["size"][k] == len(near.shingle_set(t or ""))
    rng = random.Random(0)
    a = prose(rng, 3000)
    for b in family(rng, a, 10, 150):
        x, y = near.shingle_set(a), near.shingle_set(b)
        assert near.estimate(near.sketch(x)[None], near.sketch(y)[None])[0] == pytest.approx(near.jaccard(x, y), abs=0.15)


def test_groups_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near, "TILE", 32)
    rng = random.Random(4)
    texts = [None, "", " ", "one", "one", "two words"]
    for n in (40, 80, 200, 400):
        for _ in range(6):
            base = prose(rng, n)
            texts += [base, *family(rng, base, 4, max(1, n // 60)), *family(rng, base, 2, n // 10)]
    rng.shuffle(texts)
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, size int").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(df).collect()}
    assert got.keys() == set(range(len(texts)))
    s = sets(texts)
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if similarity(s[i], s[j]) >= 0.8]
    caught = [got[i] == got[j] for i, j in linked]
    assert np.mean(caught) >= 0.95  # the index is approximate; what it finds is exact
    for c in set(got.values()):
        members = [k for k in got if got[k] == c]
        assert min(members) == c
        seen, todo = {c}, [c]
        while todo:
            i = todo.pop()
            fresh = [j for j in members if j not in seen and similarity(s[i], s[j]) >= 0.8]
            seen.update(fresh)
            todo += fresh
        assert seen == set(members)


def least_ids(s):
    """By brute force: of each set, the smallest position that links of similarity 0.8 or more reach."""
    low = list(range(len(s)))
    changed = True
    pairs = [(i, j) for i in range(len(s)) for j in range(i) if similarity(s[i], s[j]) >= 0.8]
    while changed:
        changed = False
        for i, j in pairs:
            if low[i] != low[j]:
                low[i] = low[j] = min(low[i], low[j])
                changed = True
    return low, pairs


def test_repeated_lines_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(near, "TILE", 32)
    rng = random.Random(11)
    texts = []
    for n in (304, 604):
        for times in (5, 10, 30):
            for _ in range(8):
                base = prose(rng, n)
                texts += [base, base + "\n" + "\n".join([prose(rng, 15)] * times)]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(df).collect()}
    low, pairs = least_ids(sets(texts))
    assert len(pairs) == 48
    assert sum(got[i] == got[j] for i, j in pairs) == 48
    assert [got[k] for k in range(len(texts))] == low


def test_refuted_links_do_not_split_groups(spark):
    rng = random.Random(2)
    families = []
    for _ in range(100):
        base = prose(rng, 300).split()
        families.append([])
        for _ in range(8):
            w = list(base)
            for k in range(rng.randint(3, 4)):
                w[rng.randrange(len(w))] = f"zig{rng.randrange(99)}"
            families[-1].append(" ".join(w))
    df = spark.createDataFrame([(8 * f + k, t) for f, family in enumerate(families) for k, t in enumerate(family)], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(df).collect()}
    wrong = [f for f, family in enumerate(families) if [got[8 * f + k] for k in range(8)] != [8 * f + c for c in least_ids(sets(family))[0]]]
    assert not wrong


def test_odd_rows(docs, no_docs):
    rows = near.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    blank = {r["doc_id"] for r in docs.collect() if not (r["text"] or "").strip()}
    assert len({r["component_id"] for r in rows if r["doc_id"] in blank and r["doc_id"] is not None}) == 1
    assert near.keep_one(docs).columns == docs.columns and near.near_duplicates(no_docs).count() == 0


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    rng = random.Random(9)
    a, b, c = (prose(rng, 200) for _ in range(3))
    rows = [(1, a), (None, a + " x"), (None, b), (None, b + " y"), (None, b), (7, c), (7, c + " z"), (7, a + " x y"), (8, c), (8, c), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for keep in (near.keep_one, simhash.keep_representatives):
        got = [(r["doc_id"], r["text"]) for r in keep(df).collect()]
        group = lambda t: next((k for k, x in enumerate((a, b, c)) if (t or "").startswith(x)), 3)
        if keep is near.keep_one:
            assert sorted((group(t), i) for i, t in got if i is not None) == [(0, 1), (2, 7)]
            assert sorted(group(t) for i, t in got if i is None) == [1, 3]
        assert len(set(got)) == len(got) and {(1, a), *((i, t) for i, t in got if i == 7)} <= set(got)
    triples = spark.createDataFrame([(1, a), (None, a + " x"), (None, b)], "doc_id long, text string")
    assert sorted(repr(tuple(r)) for r in near.keep_one(triples).collect()) == sorted(map(repr, [(1, a), (None, b)]))


def test_a_refuted_link_of_a_triangle_leaves_the_others(spark, monkeypatch):
    """Estimates that are too high put false links into the forest first; the true one they closed is verified later."""
    rng = random.Random(1)
    base = prose(rng, 400).split()
    bs, cs = list(base), list(base)
    for k in range(8):
        bs[k * 6], cs[200 + k * 6] = f"bb{k}", f"cc{k}"
    texts = [" ".join(x) for x in (bs, base, cs)]  # the ends are each near the middle alone
    s = sets(texts)
    assert similarity(s[0], s[1]) >= 0.8 and similarity(s[1], s[2]) >= 0.8 and similarity(s[0], s[2]) < 0.8
    monkeypatch.setattr(near, "estimate", lambda a, b: np.arange(len(a))[::-1] / 10 + 0.5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["component_id"] for r in near.near_duplicates(df).collect()} == {0}


def test_the_index_of_operator_4_is_descended(spark):
    rng = random.Random(12)
    base = prose(rng, 900)
    texts = [base, base + " one more", prose(rng, 900)]
    prints = near.prints(pd.Series(texts))
    entries = spark.createDataFrame([(int(h), int(f)) for h, f in zip(prints["set_hash"], prints["fp"])], "set_hash long, fp long")
    assert {frozenset(r) for r in near.indexed(entries).collect()} == {frozenset(int(h) for h in prints["set_hash"][:2])}


def test_very_long_texts(spark):
    text = prose(random.Random(4), 250_000)  # over 1 MB
    rows = [(1, text), (2, text + " and a little more"), (3, prose(random.Random(5), 250_000))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in near.near_duplicates(df).collect()} == {(1, 1), (2, 1), (3, 3)}
    assert {r["doc_id"]: r["component_id"] for r in simhash.simhash_dedup(df).collect()}[2] == 1

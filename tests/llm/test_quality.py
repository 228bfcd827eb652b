import random

import numpy as np
import pytest

from tests.llm.conftest import prose
from wortnetz.llm import quality


@pytest.fixture(scope="module")
def made():
    """(id, text, junk, toxic): texts whose kind is known; half of the toxic words are not in the list of insults."""
    rng = random.Random(8)
    rows = []
    for k in range(900):
        text, kind = prose(rng, rng.randint(30, 150)), k % 9
        words = text.split()
        if kind == 0:
            text = " ".join(w + rng.choice(["$$$", "%%%", "&&&", "###"]) for w in words)
        elif kind == 1:
            text = " ".join(w.upper() + "!!" for w in words)
        elif kind == 2:
            text = " ".join(w for w in words[:6] for _ in range(10))
        elif kind in (3, 4):
            pool = ["idiot", "moron", "scum"] if kind == 3 else [f"grobzz{x}" for x in ("an", "en", "ix", "ol")]
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(pool))
            text = " ".join(words)
        rows.append((k, text, kind < 3, kind in (3, 4)))
    return rows


def test_held_out_accuracy(spark, made):
    docs = spark.createDataFrame([(i, t, "x") for i, t, _, _ in made], "doc_id long, text string, keep string").repartition(4)
    labels = spark.createDataFrame([(i, int(x)) for i, _, _, x in made if i % 2], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == len(made)
    held = [(got[i], junk, toxic) for i, _, junk, toxic in made if not i % 2]
    assert np.mean([(r["junk_score"] > 0) == junk for r, junk, _ in held]) > 0.98
    assert np.mean([(r["toxic_score"] > 0) == toxic for r, _, toxic in held]) > 0.97
    assert np.mean([r["keep"] for r, junk, toxic in held if not junk and not toxic]) > 0.98


def test_odd_rows_have_a_result(spark, docs, no_docs):
    out = quality.classify(docs)
    assert out.columns == [*docs.columns, "junk_score", "toxic_score", "keep"]
    rows = out.collect()
    assert len(rows) == docs.count() and all(r["keep"] is not None for r in rows)
    assert all(r["keep"] for r in rows if not (r["text"] or "").strip())
    assert quality.classify(no_docs).count() == 0
    assert quality.classify(docs, no_docs.selectExpr("doc_id", "digest AS toxic")).count() == len(rows)


def test_em_finds_accuracies():
    rng = np.random.default_rng(0)
    bad = rng.random(20_000) < 0.2
    right = [0.95, 0.9, 0.8]
    votes = np.stack([np.where(rng.random(len(bad)) < a, bad, ~bad) for a in right], axis=1)
    counts = {}
    for v in votes:
        key = "".join(str(quality.BAD if x else quality.GOOD) for x in v)
        counts[key] = counts.get(key, 0) + 1
    posterior, accuracy, share = quality.em(counts, 300)
    assert np.abs(accuracy - right).max() < 0.04 and abs(share - 0.2) < 0.04
    assert posterior["111"] > 0.95 and posterior["222"] < 0.05
    assert quality.em({}) [0] == {}


def test_training_is_bounded(spark, made):
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in made], "doc_id long, text string")
    model = quality.fit(docs, train_rows=20)
    assert len(model.weights) < 100_000 and set(model.accuracies) == set(quality.HEADS)


def test_mined_words_against_brute_force(spark, made):
    rows = [(text, int(toxic)) for _, text, _, toxic in made]
    got = quality.mine(spark.createDataFrame(rows, "text string, toxic int").repartition(3))
    bad, good = ([quality.words_of(t) for t, x in rows if x == k] for k in (1, 0))
    count = lambda texts, w: sum(w in t for t in texts)
    want = {w for w in set().union(*bad) if (k := count(bad, w)) >= max(quality.LEAST_ROWS, quality.SUPPORT * len(bad)) and k >= quality.PURITY * (k + count(good, w))}
    assert got[0] == want and {f"grobzz{x}" for x in ("an", "en", "ix", "ol")} <= want and "grob" in got[1]


def test_insults_that_are_not_listed_are_found(spark, made):
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in made], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(x)) for i, _, _, x in made if i % 2], "doc_id long, toxic int")
    score = {r["doc_id"]: r["toxic_score"] for r in quality.classify(docs, labels).collect()}
    unlisted = [i for i, t, _, toxic in made if toxic and not i % 2 and not quality.words_of(t) & quality.INSULTS]
    assert unlisted and np.mean([score[i] > 0 for i in unlisted]) > 0.95


def test_an_id_of_many_rows_and_a_very_long_text(spark, made):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in made], "doc_id long, text string")
    many = spark.range(100_000).selectExpr("5L AS doc_id", "concat('the same id again ', id % 50) AS text")
    long = spark.createDataFrame([(5000, prose(rng, 300_000)), (5001, prose(rng, 300_000) + " idiot moron scum" * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(x)) for i, _, _, x in made if i % 2] * 3, "doc_id long, toxic int")
    got = quality.classify(docs.union(many).union(long), labels)
    assert got.count() == len(made) + 100_002 and got.where("doc_id = 5 AND NOT keep").count() == 0
    assert {r["doc_id"]: r["keep"] for r in got.where("doc_id >= 5000").collect()} == {5000: True, 5001: False}

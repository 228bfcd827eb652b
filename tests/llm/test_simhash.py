import random
import re

import numpy as np
import xxhash

from wortnetz.llm import simhash


def slow_print(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(s), 42) for s in ([w[i : i + words] for i in range(len(w) - words + 1)] or [w])]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, bits):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_fingerprints(texts):
    for words in (3, 5):
        for t in texts:
            assert simhash.fingerprint(t or "", words) == slow_print(t, words)


def test_long_texts_are_hashed_in_chunks(monkeypatch):
    text = " ".join(map(str, range(1000)))
    want = simhash.fingerprint(text, 3)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text, 3) == want


def test_index_finds_every_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, np.uint64)
    x = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(12)), rng.integers(0, 1 << 63, 500, np.uint64)]))
    rank = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    x = x[np.argsort(rank)]
    want = np.bitwise_count(x[:, None] ^ x[None, :]) <= 2
    i, j = simhash.close_pairs(x, x, same=True)
    assert {(a, b) for a, b in zip(i.tolist(), j.tolist())} == {(a, b) for a, b in zip(*np.nonzero(np.triu(want, 1)))}
    i, j = simhash.close_pairs(x[:300], x[300:])
    assert {(a, b) for a, b in zip(i.tolist(), j.tolist())} == {(a, b) for a, b in zip(*np.nonzero(want[:300, 300:]))}


def test_groups_of_prints_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)  # a family spreads over many blocks
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = set(base)
    for b in base[:10]:
        x = b
        for _ in range(25):
            x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints |= {rng.getrandbits(64) for _ in range(200)}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long").repartition(3)
    from wortnetz.llm.common import connected_components

    got = {r["node"]: r["component"] for r in connected_components(simhash.links(df)).collect()}
    want = components({signed(p): p for p in prints}, 2)
    size = {}
    for v in want.values():
        size[v] = size.get(v, 0) + 1
    groups = lambda m: {frozenset(k for k in m if m[k] == c) for c in set(m.values())}
    assert groups(got) == {g for g in groups(want) if len(g) > 1}


def test_documents_against_brute_force(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = simhash.simhash_dedup(docs, words=3).collect()
    assert len(got) == len(rows)
    prints = {k: slow_print(t, 3) for k, (_, t) in enumerate(rows)}
    comp = components(prints, 2)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[comp[k]] = min(low.get(comp[k], i), i)
    key = lambda t: tuple((v is None, v) for v in t)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    assert sorted(((r["doc_id"], r["fp"], r["component_id"]) for r in got), key=key) == sorted(((i, signed(prints[k]), low.get(comp[k])) for k, (i, _) in enumerate(rows)), key=key)


def test_representatives_and_empty_table(docs, no_docs):
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert simhash.simhash_dedup(no_docs).count() == 0 and simhash.keep_representatives(no_docs).count() == 0

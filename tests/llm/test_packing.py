import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import prose
from wortnetz.llm import packing


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(packing.default_paths()[0])


def test_ids_are_the_library_s(texts, library):
    encode = packing.tokens(*packing.default_paths())
    for t in [*texts, "a <|endoftext|> b", "x y z　", "it's I'LL 12 34", "a  b \n\n c\t\td "]:
        assert encode(t or "").tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_every_piece_once_and_gapless(docs, library):
    rows = packing.pack_documents(docs, capacity=64).collect()
    want = Counter()
    for r in docs.collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % 64 + 1
        for k, start in enumerate([0, *range(first, len(ids), 64)]):
            part = ids[start : first if not k else start + 64]
            want[r["doc_id"], k, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    sizes = np.array([r["length"] for r in rows])
    assert len(bins) <= packing.lower_bound(sizes, 64) + 1


def test_instances_of_any_size(spark):
    df = spark.range(500).selectExpr("id", "cast(1 + (id * 37) % 100 AS bigint) AS length", "0L AS `offset`")
    for instance in (50, 10_000):
        rows = packing.pack(df, capacity=100, instance=instance).collect()
        assert len(rows) == 500 and {r["id"] for r in rows} == set(range(500))
        total = Counter()
        for r in rows:
            total[r["sequence_id"]] += r["length"]
        assert max(total.values()) <= 100
    assert packing.pack(df.where("id < 0")).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, capacity=50)


def bins_of(owner):
    return {frozenset(np.flatnonzero(owner == b).tolist()) for b in np.unique(owner)}


def test_crossover_injects_whole_bins_and_keeps_every_item_once():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 700, 400)
    into, giver = (packing.best_fit(sizes, rng.permutation(400), 1000) for _ in range(2))
    child = packing.crossover(sizes, into, giver, 1000, rng)
    assert len(child) == 400 and np.bincount(child, sizes).max() <= 1000
    new = bins_of(child) - bins_of(into)
    full = {b for b in bins_of(giver) if sizes[list(b)].sum() >= packing.WELL_FILLED * 1000}
    assert new & full and len(bins_of(child)) <= len(bins_of(into))


def test_evolution_makes_the_result():
    rng = np.random.default_rng(0)
    sizes = rng.integers(20, 500, 600)
    founders = [packing.best_fit(sizes, rng.permutation(600), 1000) for _ in range(8)]
    best = packing.evolve(sizes, [], 1000, 1, 20, 6, 2)
    assert all(len(o.owner) == 600 and np.bincount(o.owner, sizes).max() <= 1000 for o in best)
    assert best[0].crossovers >= 1 and best[0].islands == 4
    assert len(np.unique(best[0].owner)) <= min(packing.lower_bound(sizes, 1000) + 1, *(len(np.unique(o)) for o in founders))
    # migrants take part in crossovers: their island shows in the children
    other = packing.evolve(sizes, [o._replace(islands=1) for o in best[:2]], 1000, 5, 20, 6, 1)
    assert any(o.islands == 3 for o in other)
    assert packing.fitness(sizes, other[0].owner, 1000) >= packing.fitness(sizes, best[0].owner, 1000)


def least_bins(sizes, capacity):
    """By trying every way."""

    def tries(k, room):
        if k == len(sizes):
            return len(room)
        out = tries(k + 1, (*room, capacity - sizes[k]))
        for b, r in enumerate(room):
            if r >= sizes[k]:
                out = min(out, tries(k + 1, (*room[:b], r - sizes[k], *room[b + 1 :])))
        return out

    return tries(0, ())


def test_tiny_instances_are_packed_as_well_as_can_be():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 6, 7, 8):
        for _ in range(8):
            sizes = rng.integers(1, 60, n)
            best = packing.evolve(sizes, [], 100, int(rng.integers(99)), 12, 4)[0]
            assert len(np.unique(best.owner)) == least_bins(sizes.tolist(), 100), sizes


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_whole_query_is_evolved_and_migrated(spark):
    rows = packing.op9_best_fit_packing(spark, "/root/testdata/sf0.01").select("length", "sequence_id", "crossovers", "islands").collect()
    part = [r for r in rows if r["length"] < packing.CAPACITY]
    assert part and all(r["crossovers"] >= 1 for r in part) and max(r["islands"] for r in part) > 1
    assert len({r["sequence_id"] for r in rows}) == packing.lower_bound(np.array([r["length"] for r in rows]), packing.CAPACITY)


def test_very_long_text(spark, library):
    text = prose(random.Random(8), 250_000)  # over 1 MB
    rows = packing.pack_documents(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")).where("doc_id = 1").orderBy("piece").collect()
    ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
    assert len(text) > 1 << 20 and [r["length"] for r in rows[1:]] == [packing.CAPACITY] * (len(rows) - 1)
    assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in rows)
    assert sum(r["length"] for r in rows) == len(ids)

import datetime as dt
import os
import random
import time

import pytest

from tests.llm.conftest import prose
from wortnetz.llm import shards
from wortnetz.llm.shards import Conflict, Shard, ShardStore, plan, shard, tier

MB = 1 << 20


def rows(df):
    return sorted(map(repr, df.collect()))


def listed(store):
    return store.shards(store.manifest()[1])


@pytest.mark.parametrize("arrivals", [1, 5])
def test_round_trip_of_any_rows(spark, docs, no_docs, tmp_path, arrivals):
    store = shard(docs, f"file://{tmp_path}/a", arrivals)
    assert rows(store.read()) == rows(docs) and store.read().columns == docs.columns
    assert rows(shard(no_docs, f"file://{tmp_path}/b", arrivals).read()) == []


def test_times_of_any_year_and_odd_types(spark, tmp_path):
    times = ["0001-01-01 00:00:00", "1500-01-01 01:02:03.000004", "1677-01-01 00:00:00", "1970-01-01 00:00:00", "2262-12-31 23:59:59.999999", "9999-12-31 23:59:59.999999"]
    kind = "t timestamp, n timestamp_ntz, d date, m map<string,int>, s struct<a:array<double>>, b binary, x decimal(38,10), `o.dd` string"
    df = spark.createDataFrame([(t, k) for k, t in enumerate([*times, None])], "t string, k int")
    df = df.selectExpr("cast(t AS timestamp) AS t", "cast(t AS timestamp_ntz) AS n", "cast(t AS date) AS d", "map('a', k) AS m", "named_struct('a', array(k / 3D, double('nan'))) AS s", "cast(t AS binary) AS b", "cast(k AS decimal(38,10)) AS x", "t AS `o.dd`")
    assert df.schema.simpleString() == spark.createDataFrame([], kind).schema.simpleString()
    store = ShardStore(spark, f"file://{tmp_path}/t")
    for _ in range(4):
        store.append(df.repartition(3))
    before, as_text = len(listed(store)), [f"cast(`{c}` AS string)" for c in df.columns]
    store.compact_all()
    assert len(listed(store)) < before
    assert rows(store.read().selectExpr(*as_text)) == sorted(rows(df.selectExpr(*as_text)) * 4)
    assert spark.conf.get("spark.sql.parquet.outputTimestampType") != "TIMESTAMP_MICROS"
    assert dt.datetime(9999, 12, 31, 23, 59, 59, 999999) in {r["n"] for r in store.read().select("n").collect()}


def test_versions_merges_and_vacuum(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", part_shards=5)
    for k in range(6):
        store.append(spark.range(k * 1000, k * 1000 + 1000).selectExpr("id", "repeat(cast(id AS string), 20) AS text").repartition(4))
    assert store.manifest()[0] == 6 and len(listed(store)) == 24
    size = sum(s.bytes for s in listed(store))
    after = store.compact_all(target=size // 3)
    assert len(listed(store)) < 8 and after > 6
    assert store.read().count() == 6000 and store.read(3).count() == 3000  # older versions stay readable until vacuum
    assert store.compact(target=size // 3) == after
    left = tmp_path / "s" / "merged" / "failed.parquet"
    left.write_bytes(b"half a file")
    store.vacuum()
    assert left.exists()  # it may belong to a writer that is still at work
    os.utime(left, (time.time() - 2 * shards.GRACE,) * 2)
    store.vacuum()
    assert not left.exists()
    assert store.versions() == [after] and store.read().selectExpr("sum(id)").first()[0] == sum(range(6000))
    files = [f for _, _, names in os.walk(tmp_path / "s") for f in names if f.endswith(".parquet")]
    assert len(files) == len(listed(store))


def test_shards_of_an_arrival_are_bounded(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s")
    store.append(spark.range(1000).toDF("id").coalesce(1), rows=100)
    assert [s.rows for s in listed(store)] == [100] * 10


def test_of_two_writers_one_wins(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s")
    base, parts, schema = store.manifest()
    store.append(spark.range(5).toDF("id"))
    with pytest.raises(Conflict):
        store.commit(base, parts, schema)
    assert store.read().count() == 5
    with pytest.raises(ValueError):
        store.append(spark.range(5).toDF("other"))


def test_a_merge_that_changes_a_row_is_not_committed(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s")
    for k in range(4):
        store.append(spark.range(k, k + 1).toDF("id"))
    base, parts, schema = store.manifest()
    known = listed(store)
    store.commit(base, store.write_parts([known[0]._replace(digest=known[0].digest + 1), *known[1:]]), schema)
    with pytest.raises(RuntimeError):
        store.compact()
    assert store.read().count() == 4


def test_very_long_texts(spark, tmp_path):
    text = prose(random.Random(1), 400_000)  # about 2 MB
    df = spark.createDataFrame([(k, text[k:]) for k in range(8)], "doc_id long, text string").repartition(4)
    store = shard(df, f"file://{tmp_path}/l", 4)
    assert rows(store.read()) == rows(df)


def test_plan_merges_like_sizes():
    assert plan([Shard("a", 30 * MB, 1), Shard("b", 40 * MB, 1)], 32 * MB) == []
    runs = plan([Shard(f"{k:03}", MB, 1) for k in range(100)], 32 * MB)
    assert sum(map(len, runs)) == 100 and all(24 * MB <= sum(s.bytes for s in r) <= 48 * MB for r in runs[:-1])
    assert plan([Shard("a", 5, 1)], 32 * MB) == [] and plan([], MB) == []
    assert plan([Shard("a", 20 * MB, 1), Shard("b", 10 << 10, 1)], 32 * MB) == []
    rng = random.Random(0)
    some = [Shard(str(k), int(4 ** rng.uniform(2, 13)), 1) for k in range(3000)]
    runs = plan(some, 32 * MB)
    assert runs and all(len({tier(s.bytes) for s in r}) == 1 for r in runs)


def test_small_arrivals_are_not_written_over_and_over():
    kept, written, arrived = [Shard("big", 20 * MB, 1)], 0, 0
    for k in range(200):
        kept.append(Shard(f"a{k}", 10 << 10, 1))
        arrived += 10 << 10
        while runs := plan(kept, 32 * MB):
            for i, r in enumerate(runs):
                size = sum(s.bytes for s in r)
                written += size
                kept = [s for s in kept if s not in r] + [Shard(f"m{k}-{i}-{size}", size, 1)]
    assert written < 10 * arrived and len(kept) < 20


def test_many_shards_are_planned_quickly():
    some = [Shard(f"{k:06}", (k % 5000 + 1) << 8, 1) for k in range(100_000)]
    began = time.perf_counter()
    assert sum(map(len, plan(some))) > 99_000
    assert time.perf_counter() - began < 2

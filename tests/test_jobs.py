import json
import logging
import os
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

from jobs import association_norms, registered, word_frequencies

SF = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parents[1]
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
SCHEMA = "doc_id long, text string, lang string"
FIRST = [(1, "The house, the HOUSE.", "en"), (2, "Das Haus über ß", "de"), (3, None, "en"), (4, "", ""), (5, "x1y x", None)]
SECOND = [(6, "the end", "en"), (7, "Haus", "de"), (8, "été", "fr"), (1, "The house, the HOUSE.", "en")]


def brute(rows):
    """(lang, word) -> (n, documents, share of documents)."""
    n, docs, of = Counter(), Counter(), Counter()
    for _, text, lang in rows:
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        of[lang or None] += 1
        n.update((lang or None, w) for w in words)
        docs.update((lang or None, w) for w in set(words))
    return {k: (n[k], docs[k], round(docs[k] / of[k[0]], 6)) for k in n}


def add(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def found(df):
    rows = df.collect()
    out = {(r["lang"], r["word"]): (r["n"], r["n_docs"], r["document_share"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture
def at(tmp_path):
    return {"source": str(tmp_path / "in"), "output": str(tmp_path / "out"), "checkpoint": str(tmp_path / "mark")}


def batches(spark, at):
    return {r[0] for r in spark.read.parquet(f"{at['output']}/counts").select("batch").distinct().collect()}


def test_a_second_run_takes_only_what_is_new(spark, at, caplog):
    caplog.set_level(logging.INFO, "jobs")
    add(spark, FIRST, at["source"])
    assert found(word_frequencies.run(spark, **at)) == brute(FIRST)
    assert batches(spark, at) == {0}
    add(spark, SECOND, at["source"])
    assert found(word_frequencies.run(spark, **at)) == brute(FIRST + SECOND)
    assert batches(spark, at) == {0, 1}
    said = [r.getMessage() for r in caplog.records]
    assert any("batch 0: read 5 documents" in x for x in said) and any("batch 1: read 4 documents" in x for x in said)
    assert found(word_frequencies.run(spark, **at)) == brute(FIRST + SECOND)  # nothing new
    assert batches(spark, at) == {0, 1}


def test_a_batch_that_broke_after_its_counts_were_written_counts_once(spark, at, monkeypatch):
    add(spark, FIRST, at["source"])
    word_frequencies.run(spark, **at)
    add(spark, SECOND, at["source"])
    known, times = word_frequencies.log.info, []

    def breaks(message, *args):
        times.append(message)
        if message.startswith("batch"):
            raise OSError("lost")
        known(message, *args)

    monkeypatch.setattr(word_frequencies.log, "info", breaks)
    with pytest.raises(Exception, match="lost"):
        word_frequencies.run(spark, **at)
    monkeypatch.undo()
    assert batches(spark, at) == {0, 1} and times
    assert found(word_frequencies.run(spark, **at)) == brute(FIRST + SECOND)


def test_many_batches_and_the_least_count(spark, at):
    for row in FIRST + SECOND:
        add(spark, [row], at["source"])
    got = found(word_frequencies.run(spark, **at, files_per_batch=2, least=2))
    assert got == {k: v for k, v in brute(FIRST + SECOND).items() if v[0] >= 2}
    assert len(batches(spark, at)) == 5


def test_a_table_without_rows_and_other_settings_stay(spark, at):
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    add(spark, [], at["source"])
    assert word_frequencies.run(spark, **at).count() == 0
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before


def test_frequencies_of_a_language(spark):
    counts = [("en", "a", 3, 2), ("en", "b", 1, 1), ("en", "", 4, 4)]
    rows = {r["word"]: r for r in word_frequencies.frequencies(spark.createDataFrame(counts, "lang string, word string, n long, n_docs long")).collect()}
    assert rows["a"]["per_million"] == 750000.0 and rows["a"]["document_share"] == 0.5 and rows["b"]["document_share"] == 0.25
    assert rows["a"]["zipf"] == pytest.approx(3 + 5.823909, abs=1e-6)  # log10(4 / 6e-6)


@needs_tables
def test_association_norms_again_and_on_grown_tables(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, "jobs")
    tables, out = tmp_path / "tables", str(tmp_path / "out")
    for name in ("orders", "lineitem", "part", "customer", "nation", "region"):
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        rows.where({"orders": "o_orderkey % 2 = 0", "lineitem": "l_orderkey % 2 = 0"}.get(name, "true")).write.parquet(f"{tables}/{name}.parquet")
    run = lambda **kw: association_norms.run(spark, str(tables), out, criteria=registered.CRITERIA, **kw)
    first = sorted(map(tuple, run().collect()))
    assert first and sorted(map(tuple, run().collect())) == first
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        spark.read.parquet(f"{SF}/{name}.parquet").where(f"{key} % 2 = 1").write.mode("append").parquet(f"{tables}/{name}.parquet")
    grown = run(trials_per_cue=10).collect()
    per_cue = spark.read.parquet(f"{out}/trials").where("in_sample").groupBy("cue").count().collect()
    assert per_cue and {r["count"] for r in per_cue} == {10}
    assert all(abs(s - 1) < 1e-4 for s in strength_sums(grown)) and {r["rank"] for r in grown} >= {1, 2, 3}
    assert spark.read.parquet(f"{out}/criteria").count() == 4
    assert any(re.fullmatch(r"read 1500 rows of orders of .*", r.getMessage()) for r in caplog.records)


@needs_tables
def test_association_norms_work_out_trials_once(spark, tmp_path, monkeypatch):
    """Trials, scores, the trials that stay and the sample are stored, so tables are scanned by no later step."""
    plans = []
    known = association_norms._write
    monkeypatch.setattr(association_norms, "_write", lambda df, path, by=None: (plans.append(df._jdf.queryExecution().executedPlan().toString()), known(df, path, by)))
    association_norms.run(spark, SF, str(tmp_path / "out"), criteria=registered.CRITERIA)
    assert len(plans) == 3 and not any(name in plan for plan in plans for name in ("lineitem", "orders", "customer"))


def strength_sums(rows):
    out = Counter()
    for r in rows:
        out[r["section"], r["cue"]] += r["strength"]
    return out.values()


@needs_tables
@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    df = registered.QUERIES[name](spark, SF)
    result = con.execute(registered.SQL[name])
    names = [c[0] for c in result.description]
    key = lambda r: sorted((k, str(v)) for k, v in r.items())
    assert sorted(key(dict(zip(names, r))) for r in result.fetchall()) == sorted(key(r.asDict()) for r in df.collect())


def test_command_line(spark, at, tmp_path):
    add(spark, FIRST, at["source"])
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"source": "elsewhere", "output": at["output"], "files_per_batch": 5}))
    cmd = [sys.executable, "-m", "jobs.word_frequencies", "--config", str(config), "--source", at["source"], "--checkpoint", at["checkpoint"]]
    env = os.environ | {"PYTHONPATH": f"{REPO}:{os.environ.get('PYTHONPATH', '')}"}
    done = subprocess.run(cmd, cwd=REPO, env=env, capture_output=True, text=True, timeout=170)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 5 documents" in done.stderr
    assert found(spark.read.schema(word_frequencies.FREQUENCIES).parquet(f"{at['output']}/frequencies")) == brute(FIRST)
    assert subprocess.run(cmd[:3], cwd=REPO, env=env, capture_output=True, timeout=60).returncode == 2

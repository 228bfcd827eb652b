import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wortnetz.sources import enrich, readers, writers
from wortnetz.streaming import counts


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text('w;n\nHaus;1,5\nNA;NA\n"a;b";2\n')
    assert rows(readers.read_decimal_comma(spark, str(tmp_path / "a.csv"), "w string, n string", ["n"])) == [("Haus", 1.5), ("a;b", 2.0), (None, None)]
    (tmp_path / "b.txt").write_bytes("größe\nMaß\n".encode("latin-1"))
    assert rows(readers.read_delimited(spark, str(tmp_path / "b.txt"), "cue string", header=False, encoding="ISO-8859-1")) == [("Maß",), ("größe",)]
    (tmp_path / "c.txt").write_text("eins\nzwei\n")
    assert rows(readers.read_column(spark, str(tmp_path / "c.txt"), "cue")) == [("eins",), ("zwei",)]
    (tmp_path / "d.csv").write_text("title\nmore\n\na,1\nb,NA\n")
    assert rows(readers.read_skipping(spark, str(tmp_path / "d.csv"), StructType.fromDDL("w string, n int"), 2)) == [("a", 1), ("b", None)]
    assert readers.read_text(spark, str(tmp_path / "c.txt")) == "eins\nzwei\n"


def test_skipping_in_splits(spark, tmp_path):
    want = []
    for f, n in enumerate((400, 1, 0)):  # a file of many splits, one of a line, one that ends within the skipped lines
        body = [f"{f}-{i};Fuß{i}" for i in range(n)]
        want += [tuple(x.split(";")) for x in body]
        (tmp_path / f"r{f}.txt").write_bytes("\r\n".join(["Länder", ""] + body).encode("latin-1") + b"\n" * (f == 0))
    schema = StructType.fromDDL("k string, w string")
    read = lambda skip=2, n="*", enc="ISO-8859-1": readers.read_skipping(spark, f"{tmp_path}/r{n}.txt", schema, skip, ";", enc)
    size, cost = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "16")
        for bytes_ in ("64", "300", "100000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_)
            assert sorted(rows(read())) == sorted(want)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
        assert read().rdd.getNumPartitions() > 20
        with pytest.raises(Exception, match="do not fit into the first split"):
            read(200, "0").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert rows(read(200, "0")) == want[198:400] and len(rows(read(0))) == len(want) + 3
    (tmp_path / "u.txt").write_bytes("Länder\n\na;ß\n".encode("utf-16"))
    assert rows(readers.read_skipping(spark, f"{tmp_path}/u.txt", schema, 1, ";", "UTF-16")) == [("a", "ß")]


def test_two_row_header(spark, tmp_path):
    (tmp_path / "p.csv").write_bytes("Bericht\n;Männer;;Frauen\nAlter;AT;DE;AT\n16 Jahre;1;2;3\n17 Jahre;4;;6\nSumme;5;2;9\n".encode("latin-1"))
    df = readers.read_two_row_header(spark, str(tmp_path / "p.csv"), skip=1, footer=1)
    assert df.columns == ["Alter", "Männer_AT", "Männer_DE", "Frauen_AT"] and rows(df) == [("16 Jahre", "1", "2", "3"), ("17 Jahre", "4", None, "6")]


def test_vectors(spark, tmp_path):
    (tmp_path / "v.vec").write_text("3 2\nHaus 0.1 0.2\nweg 1 2 \nandere 5 6\n")
    wanted = spark.createDataFrame([("haus",), ("WEG",), ("fehlt",)], "word string")
    assert rows(readers.read_vectors(spark, str(tmp_path / "v.vec"), wanted)) == [("Haus", [0.1, 0.2]), ("weg", [1.0, 2.0])]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b;c", 2)], "w string, n int")
    writers.write_export(df, f"{tmp_path}/e", sep=";")
    assert rows(readers.read_delimited(spark, f"{tmp_path}/e", df.schema, ";")) == rows(df)
    chunks = spark.range(10).selectExpr("id", "id div 4 AS chunk")
    assert writers.write_chunks(chunks.where("chunk = 0"), f"{tmp_path}/c") == 0
    assert writers.write_chunks(chunks, f"{tmp_path}/c") == 1 and spark.read.parquet(f"{tmp_path}/c").count() == 10
    table = writers.latex_table(df, "50% of_it")
    assert r"\caption{50\% of\_it}" in table and r"b;c & 2 \\" in table and table.count(r"\hline") == 3


def test_enrichers(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), ("boom",)], "w string")
    known = spark.createDataFrame([("a", 1), ("a", 2)], "w string, n int")
    assert {r["w"]: r["error"] for r in enrich.LookupEnricher(known).enrich(df, ["w"]).collect()} == {"a": None, "b": "not found", "boom": "not found"}

    def ask(keys):
        if any(k[0] == "boom" for k in keys):
            raise RuntimeError("down")
        return [{"size": len(k[0])} for k in keys]

    got = enrich.RequestEnricher(ask, "size int", batch=1).enrich(df, ["w"]).collect()
    assert sorted((r["w"], r["size"], r["error"]) for r in got if r["w"] != "boom") == [("a", 1, None), ("a", 1, None), ("b", 1, None)]
    assert [r["error"] for r in got if r["w"] == "boom"] == ["RuntimeError: down"]


def test_requests(spark):
    df = spark.createDataFrame([("Haus", '{"choices": [{"message": {"content": " ja "}}]}')], "w string, a string")
    text = enrich.prompt("Wort: {w}, {q}!", w=F.col("w"), q=F.lit(None).cast("string"))
    body, answer, url = df.select(enrich.chat_request("m", "s", text, None, 5), enrich.chat_answer(F.col("a")), enrich.title_url("http://x", F.array(F.lit("a b"), F.lit("ü")))).first()
    assert json.loads(body) == {"model": "m", "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "Wort: Haus, !"}], "max_tokens": 5}
    assert answer == " ja " and url.endswith("titles=a+b%7C%C3%BC")
    found = enrich.parse_titles('{"query": {"normalized": [{"from": "haus", "to": "Haus"}], "pages": {"7": {"pageid": 7, "title": "Haus"}, "-1": {"title": "Qq", "missing": ""}}}}')
    assert found == [{"word": "haus", "wikipedia_page": True, "page_id": 7, "title": "Haus"}, {"word": "Qq", "wikipedia_page": False, "page_id": None, "title": None}]
    assert enrich.parse_titles("{}") == []


def test_stream_equals_batch(spark, tmp_path):
    e = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id AS int) * 5) AS ts, concat('t', id % 3) AS k FROM range(100)")
    e.repartition(3).write.parquet(f"{tmp_path}/in")
    spark.sql("SELECT timestamp'2025-01-01 00:00:00' AS ts, 'end' AS k").write.mode("append").parquet(f"{tmp_path}/in")
    stream = counts.windowed_counts(counts.read_folder(spark, f"{tmp_path}/in", e.schema, 100), "k")
    counts.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    assert rows(spark.read.parquet(f"{tmp_path}/out").where("k <> 'end'")) == rows(counts.windowed_counts(e, "k"))
    with pytest.raises(Exception, match="."):
        counts.windowed_counts(e, "missing").count()


def test_places_are_asked_for_and_parsed(spark):
    at = spark.createDataFrame([(47.5, -8.456), (None, 1.0)], "lat double, lon double")
    urls = [r[0] for r in at.select(enrich.reverse_url("http://x", F.col("lat"), F.col("lon"))).collect()]
    assert urls[0] == "http://x?accept-language=en-US&format=json&zoom=13&lat=47.50&lon=-8.46"
    bodies = [('{"address": {"village": "V", "city": "C", "county": "K", "country": "L"}}',), ('{"address": {"hamlet": "H", "town": "T"}}',), ('{"error": "Unable to geocode"}',), ("no json",), (None,)]
    got = spark.createDataFrame(bodies, "b string").select(enrich.parse_place(F.col("b")).alias("p")).select("p.*").collect()
    assert [tuple(r) for r in got] == [("C", "K", "L"), ("T", None, None)] + [(None, None, None)] * 3


def test_vector_answers_are_stacked_in_order(spark):
    rows = [(["b", "a"], "[[1, 2.5], [-3e-1, 4]]"), (["c", "d"], "[[1, 2]]"), (["e"], "no json"), (["f"], None), ([], "[]")]
    got = {r["word"]: r["vec"] for r in enrich.vector_answers(spark.createDataFrame(rows, "inputs array<string>, body string")).collect()}
    assert got == {"b": [1.0, 2.5], "a": [-0.3, 4.0], "c": None, "d": None, "e": None, "f": None}

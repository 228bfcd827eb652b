import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wortnetz.functions import nulls, scalars, stats, text


def one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_nulls(spark):
    df = spark.createDataFrame([("a", True, 1), ("a", False, 2), ("b", None, 3), ("b", True, None), ("c", True, 5), ("d", False, None), ("d", None, None)], "g string, f boolean, x int")
    got = {r["g"]: r for r in df.groupBy("g").agg(nulls.share(F.col("f")).alias("s"), nulls.r_all(F.col("f")).alias("a"), nulls.r_sum(F.col("x")).alias("x"), nulls.n_unique(F.col("x")).alias("u")).collect()}
    assert (got["a"]["s"], got["b"]["s"], got["c"]["s"]) == (0.5, None, 1.0)
    assert [got[g]["a"] for g in "abcd"] == [False, None, True, False]
    assert [got[g]["x"] for g in "abcd"] == [3, None, 5, None] and [got[g]["u"] for g in "abcd"] == [2, 2, 1, 1]
    assert one(spark, [(None,), (True,), (False,)], "c boolean", nulls.if_else(F.col("c"), F.lit(1), F.lit(2))) == [None, 1, 2]
    assert one(spark, [("a",), (None,), ("z",)], "c string", nulls.is_in(F.col("c"), ["a"])) == [True, False, False]
    assert one(spark, [(99,), (1,)], "c int", nulls.na_if(F.col("c"), 99)) == [None, 1]


@pytest.mark.parametrize(("before", "after"), [("#a¨$", "a"), ("´a´b´", "a'b"), ("^`<b>~?!\"&", "b"), ("/", ""), ("a/b", "a/b"), ("...", ""), ("..ab.", "ab."), (".a", ".a"), ("'wort'", "wort"), ("'zwei wörter'", "'zwei wörter'"), ("it's", "it's"), ("'Straße1'", "Straße1")])
def test_character_rules(spark, before, after):
    assert one(spark, [(before,)], "x string", text.clean_characters(F.col("x"))) == [after]


def test_white_space(spark):
    assert one(spark, [("  a \t b\n",), ("",), (None,), ("   ",)], "x string", text.blank_to_null(text.squish(F.col("x")))) == ["a b", None, None, None]
    assert one(spark, [("a",), ("a b",), ("a ",), (" a",), ("",), ("a  b",), (None,)], "x string", text.word_count(F.col("x"))) == [1, 2, 1, 2, 0, 3, None]


@pytest.mark.parametrize(("response", "cue", "want"), [("-tisch", "Holz", "Holztisch"), ("-tisch deko", "Holz", "Holztisch deko"), ("-Haus", "Holz", "Haus"), ("Haus-", "Tür", "Haustür"), ("E-Mail-", "Post", "EMail-post"), ("HAUS-", "Tür", "HAUS-"), ("wort", "x", "wort"), ("-", "x", "")])
def test_compounds(spark, response, cue, want):
    assert one(spark, [(response, cue)], "r string, c string", text.compound(F.col("r"), F.col("c"))) == [want]


def test_variants(spark):
    assert one(spark, [("strasse",)], "x string", text.sz_variants(F.col("x"))) == [["strasse", "straße"]]
    assert one(spark, [("ssa",), ("Maß",)], "x string", text.sz_variants(F.col("x"))) == [["ssa"], ["Maß", "Mass"]]
    assert one(spark, [("Uebel aeoe",)], "x string", text.umlaut_variants(F.col("x"))) == [["Uebel aeoe", "Uebel äoe", "Uebel aeö", "Übel aeoe"]]
    assert one(spark, [("hAus",)], "x string", text.casing_variants(F.col("x"))) == [["hAus", "Haus", "haus", "HAUS"]]
    assert one(spark, [("die Frau",)], "x string", text.casings(F.col("x"))) == [["die Frau", "die frau", "DIE FRAU", "Die frau", "Die Frau"]]
    assert one(spark, [("a",)], "x string", text.spelling_variants(F.col("x"))) == [["a", "A"]]


def test_swaps_are_one_edit(spark):
    pairs = [("neid", "nied", 1), ("ca", "abc", 3), ("", "ab", 2), ("same", "same", 0), (None, "a", None)]
    df = spark.createDataFrame(pairs, "a string, b string, d int")
    assert all(r["d"] == r["o"] for r in df.select("d", text.osa_distance(F.col("a"), F.col("b")).alias("o")).collect())


@settings(max_examples=200)
@given(st.text(alphabet="abc", max_size=6), st.text(alphabet="abc", max_size=6))
def test_osa_is_a_symmetric_distance(a, b):
    assert text.osa(a, b) == text.osa(b, a) >= abs(len(a) - len(b)) and (text.osa(a, b) == 0) == (a == b)


def test_codes(spark):
    assert one(spark, [("Fe",), ("v",), ("m",), ("X",), ("q",), (None,)], "x string", scalars.recode(F.col("x"), scalars.GENDER)) == ["female", "female", "male", "other", None, None]
    assert one(spark, [(1,), (2,), (6,), (7,), (5,), (9,)], "x int", scalars.recode(F.col("x"), scalars.EDUCATION)) == [1, 2, 3, 4, 5, None]
    assert one(spark, [("deu",), ("ENG",), (None,)], "x string", scalars.native_language(F.col("x"))) == ["DEU", None, None]
    assert one(spark, [("17 Jahre",), ("90 und mehr",), ("x",), (None,)], "x string", text.parse_number(F.col("x"))) == [17, 90, None, None]
    assert one(spark, [("1.234",), ("0,5",), ("x",)], "x string", scalars.decimal_comma(F.col("x"))) == [1.234, 0.5, None]


def test_places_and_dates(spark):
    schema = "a struct<city:string,town:string,village:string,municipality:string,hamlet:string,state:string,county:string,province:string,country:string>"
    rows = [((None, "T", "V", None, None, None, "C", None, "DE"),), (("B", None, None, None, None, None, None, None, "DE"),), ((None,) * 9,)]
    assert [tuple(x) for x in one(spark, rows, schema, scalars.geo_fields(F.col("a")))] == [("T", "C", "DE"), ("B", "B", "DE"), (None, None, None)]
    assert one(spark, [(47.376,), (-0.004,), (None,)], "x double", scalars.coordinate_key(F.col("x"))) == [4738, 0, None]
    df = spark.sql("SELECT timestamp'2016-08-17 21:06:11' AS a, timestamp'2015-01-02 03:04:05' AS b UNION ALL SELECT timestamp'2020-01-01 10:00:00', NULL")
    got = {str(r[0]) for r in df.select(scalars.or_missing_date(F.col("a"), "2016-08-17 21:06:11", F.col("b"))).collect()}
    assert got == {"2015-01-02 00:00:00", "2020-01-01 10:00:00"}


def test_closed_forms(spark):
    assert one(spark, [(0, 10**6, 10**6)], "n long, t long, k long", scalars.zipf_value(F.col("n"), F.col("t"), F.col("k")))[0] == pytest.approx(math.log10(0.5) + 3)
    assert stats.incomplete_beta(2.0, 3.0, 0.4) == pytest.approx(0.5248)
    df = spark.createDataFrame([(2.228139, 10.0), (0.0, 5.0), (None, 3.0)], "t double, d double")
    got = [r[0] for r in df.select(stats.t_p_value(F.col("t"), F.col("d"))).collect()]
    assert got[:2] == [pytest.approx(0.05, abs=1e-6), pytest.approx(1.0)] and got[2] is None
    assert one(spark, [(1.959964,)], "z double", stats.normal_p_value(F.col("z")))[0] == pytest.approx(0.05, abs=1e-6)
    assert one(spark, [(0.5, 0.5, 0.3, 100)], "a double, b double, c double, n long", stats.steiger_z(F.col("a"), F.col("b"), F.col("c"), F.col("n")))[0] == 0

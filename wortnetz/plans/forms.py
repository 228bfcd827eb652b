"""Queries on text sources, forms of tables, joins, requests and the settings of tests that other modules leave out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import nulls, scalars, text
from ..operators import graph, ingest, lexical, matrix, reshape, sampling, spelling, statistics
from ..session import stored
from ..sources import enrich, readers, writers
from .fixtures import answers, dictionary, load, norms, participants, r6, sql, trials, trials_key, words
from .numeric import _out

#: Stand-ins for the survey's raw codes, dealt out by participant.
GENDER_CODES = ["Fe", "v", "Ma", "m", "X", "?"]
LANGUAGE_CODES = ["deu", "OST", "sch", "LUX", "FRA"]


def _set(column: str) -> Column:
    return F.concat(F.lit("set"), (F.col(column) % 3).cast("string"))


def combine_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw answers with participants and cues of the same section, then the recoded demographics; some find none."""
    t = trials(spark, sf_dir)
    section = F.when(F.col("trial_id") % 10 == 0, F.lit("set9")).otherwise(_set("participant_id"))
    answers_ = t.select(F.col("trial_id").alias("id"), F.col("participant_id").alias("participantID"), "cue", *(F.col(f"response_{i}").alias(f"response{i}") for i in (1, 2, 3)), section.alias("section"), "created_at")
    code = lambda codes: F.element_at(F.array(*map(F.lit, codes)), (F.col("id_p") % len(codes) + 1).cast("int"))
    people = participants(spark, sf_dir).select(F.col("id_p").alias("id"), _set("id_p").alias("section"), "age", "education", code(GENDER_CODES).alias("gender"), code(LANGUAGE_CODES).alias("nativeLanguage"), "latitude", "longitude", F.lit(None).cast("timestamp").alias("created_at"))
    cues = answers_.where("length(cue) % 2 = 0").groupBy("cue", "section").agg(F.min("id").alias("id"))
    out = ingest.clean_demographics(ingest.combine(answers_, people, cues))
    return out.select("id_r", "id_p", "id_c", "cue", "section", "response_1", "response_2", "response_3", "age", "gender", "education", "education_label", "native_language", "native_language_label")


def left_join_clashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with those customers that owe nothing; both sides have a column ``amount``."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("person"), F.col("o_totalprice").alias("amount"))
    c = load(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("amount"))
    return reshape.left_join_suffixed(o, c, {"person": "id"}, ("_o", "_c"))


def right_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", "quality").join(load(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "right").select("doc_id", "quality", "lang")


def custom_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the dictionary, or of a list of one's own: casings that occur twice or more."""
    w = words(spark, sf_dir, low=False).groupBy("word").agg(F.count("*").alias("n"))
    return spelling.multiword_ok(w.select("word"), "word", dictionary(spark, sf_dir), custom=w.where("n >= 2"))


def log_frequency_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word lengths against the logarithm of frequencies, per language: absolute r and bounds."""
    f = lexical.frequencies(words(spark, sf_dir), "word", ["lang"])
    tests = statistics.correlation_tests(f.select("lang", F.log10("n").alias("x"), F.length("word").cast("double").alias("y")), "x", "y", ["lang"])
    out = statistics.absolute(tests)
    return out.select("lang", "n", *(r6(F.col(c)).alias(c) for c in ("r", "ci_lower", "ci_upper")))


def lattice_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lattice of a graph's size; how often a weight is drawn depends on the seed, that each is one of the graph's does not."""
    edges = stored(graph.infer_edges(answers(trials_key(spark, sf_dir))))
    drawn = graph.lattice_graph(edges, 42, 1984)
    return reshape.membership(drawn, edges, "weight", "from_graph").select("src", "dst", "from_graph")


def column_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words, written one per line without a header, and read again."""
    path = _out(spark, "column")
    writers.write_export(words(spark, sf_dir).select("word").distinct(), path, header=False)
    return readers.read_column(spark, path, "word")


def guessed_separator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written with a separator that the reader has to find out; texts hold commas."""
    path = _out(spark, "guess")
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(", ", "o_orderpriority", "o_orderstatus").alias("state"))
    writers.write_export(o, path, sep=";")
    return readers.read_delimited(spark, path, o.schema, readers.guess_separator(spark, path))


def latin_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report in ISO-8859-1 whose first two lines are no data."""
    path = _out(spark, "report")
    rows = load(spark, sf_dir, "nation").select((F.col("n_nationkey") + 2).alias("k"), F.concat_ws(";", "n_nationkey", F.concat("n_name", F.lit("ü")), "n_regionkey").alias("line"))
    head = spark.createDataFrame([(0, "Länder"), (1, "Nummer;Name;Gebiet")], "k long, line string")
    lines = head.union(rows.select(F.col("k").cast("long"), "line")).repartition(1).sortWithinPartitions("k")  # 27 rows
    lines.select(F.encode("line", "ISO-8859-1").cast("string")).write.text(path)
    return readers.read_skipping(spark, f"{path}/*.txt", StructType.fromDDL("id long, name string, region long"), 2, ";", "ISO-8859-1")


def two_row_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per age, segment and half of the participants as a report whose column names stand in two rows, as a long table
    again; ages are read out of texts."""
    path = _out(spark, "pyramid")
    p = participants(spark, sf_dir)
    genders, parts = sorted(r["gender"] for r in p.select("gender").distinct().collect()), ("even", "odd")  # the five segments
    cells = [F.count_if((F.col("gender") == g) & (F.col("id_p") % 2 == i)).cast("string") for g in genders for i in range(2)]
    body = p.groupBy("age").agg(F.concat_ws(";", *cells).alias("cells")).select((F.col("age") + 2).cast("long").alias("k"), F.concat(F.col("age").cast("string"), F.lit(" Jahre;"), F.col("cells")).alias("line"))
    upper, lower = ";".join(["", *(x for g in genders for x in (g, ""))]), ";".join(["Alter", *(x for _ in genders for x in parts)])
    head = spark.createDataFrame([(0, upper), (1, lower), (1000, "Summe;0")], "k long, line string")
    head.union(body).repartition(1).sortWithinPartitions("k").select("line").write.text(path)  # a row per age
    report = readers.read_two_row_header(spark, f"{path}/*.txt", footer=1, encoding="UTF-8")
    long = reshape.unpivot_split(report, ["Alter"], reshape.cols_matching(report, "_"), "_", ["gender", "half"], "n")
    return long.select(text.parse_number(F.col("Alter")).alias("age"), "gender", "half", F.col("n").cast("long").alias("n"))


def stacked_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables that stand side by side, on top of each other; rows with a null go."""
    return reshape.stack_side_by_side(trials(spark, sf_dir), [["trial_id", "response_1"], ["participant_id", "response_2"], ["trial_id", "response_3"]], ["id", "word"])


def unique_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.unique_of(trials(spark, sf_dir), "cue", "response_1")


def selected_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns by range and by pattern, one function over several of them, a three-valued choice and an ordered factor."""
    p = participants(spark, sf_dir)
    out = reshape.across(p.select("id_p", *reshape.cols_between(p, "region", "age")), reshape.cols_matching(p, "itude$"), F.abs)
    old = nulls.if_else(nulls.na_if(F.col("age"), 99) > 50, F.lit("old"), F.lit("young"))
    return out.withColumns({"group": old, "level": reshape.level(F.col("region"), ["EUROPE", "ASIA", "AMERICA"])})


def bound_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and parts side by side, in the order of their names; the shorter table is filled with nulls."""
    c, p = load(spark, sf_dir, "customer").select("c_name", "c_custkey"), load(spark, sf_dir, "part").select("p_name", "p_partkey")
    return reshape.bind_columns(c, ["c_name", "c_custkey"], p, ["p_name", "p_partkey"])


def bound_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of a list of tables that are there, as one; a failed part is None."""
    t = trials(spark, sf_dir)
    return reshape.bind_present([t.where("trial_id % 2 = 0").select("trial_id", "cue"), None, t.where("trial_id % 2 = 1").select("trial_id", "section")])


def first_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ``e`` of each word goes, as a literal and not as a pattern; so does a first dot of a number."""
    w = words(spark, sf_dir).select("word").distinct()
    return w.select("word", text.remove_first(F.col("word"), "e").alias("shorter"), text.remove_first(F.concat(F.col("word"), F.lit(".a.b")), ".").alias("dotless"))


def chat_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt read from a file, filled per word, as bodies of requests."""
    path = _out(spark, "prompt")
    spark.createDataFrame([("Wort: {word}",)], "value string").repartition(1).write.text(path)
    template = readers.read_text(spark, f"{path}/*.txt").strip()
    w = words(spark, sf_dir).select("word").distinct()
    return w.select("word", enrich.chat_request("model", "kurz", enrich.prompt(template, word=F.col("word"))).alias("body"))


def vector_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of requests for vectors, 50 words each."""
    return enrich.vector_requests(words(spark, sf_dir), "word", "model")


def vector_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that came as JSON bodies of 50 words each, in one table, at length one."""
    e = load(spark, sf_dir, "embeddings").select(F.concat(F.lit("w"), "vec_id").alias("word"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    per = sampling.chunks(e, 50, "word").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("word", "v"))).alias("a"))
    got = enrich.vector_answers(per.select(F.col("a.word").alias("inputs"), F.to_json("a.v").alias("body")))
    return matrix.l2_normalize(got).select("word", F.posexplode("vec").alias("k", "x")).withColumn("x", F.round("x", 6) + 0.0)


def title_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses of title queries for all words, 50 each."""
    w = sampling.chunks(words(spark, sf_dir).select("word").distinct(), 50, "word")
    return w.groupBy("chunk").agg(enrich.title_url("https://titles.example/api", F.array_sort(F.collect_list("word"))).alias("url"))


def geo_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reverse-geocoding query per rounded place of the participants; zero is no place."""
    p = participants(spark, sf_dir).where(~((F.col("latitude") == 0) & (F.col("longitude") == 0)))
    keys = p.select(scalars.coordinate_key(F.col("latitude")).alias("lat"), scalars.coordinate_key(F.col("longitude")).alias("lon")).distinct()
    return keys.select("lat", "lon", enrich.reverse_url("https://places.example/reverse", F.col("lat") / 100, F.col("lon") / 100).alias("url"))


def geo_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the service, with different fields per participant, and places parsed from them."""
    pick = lambda k, of: F.when(F.col("id_p") % k == 0, F.col(of))
    address = F.struct(pick(2, "native_language").alias("town"), pick(3, "region").alias("hamlet"), pick(5, "gender").alias("county"), F.col("native_language").alias("country"), F.lit("x").alias("road"))
    body = F.when(F.col("id_p") % 7 == 0, F.lit('{"error": "Unable to geocode"}')).otherwise(F.to_json(F.struct(F.lit(1).alias("place_id"), address.alias("address"))))
    return participants(spark, sf_dir).select("id_p", enrich.parse_place(body).alias("g")).select("id_p", "g.*")


QUERIES = {f.__name__: f for f in (title_requests, geo_requests, geo_answers, combine_answers, left_join_clashing, right_join, custom_words, log_frequency_tests, lattice_weighted, column_file, guessed_separator, latin_report, two_row_report, stacked_tables, unique_of_two, selected_columns, bound_columns, bound_present, first_removed, chat_requests, vector_requests, vector_answers)}

_CODE = lambda codes: "CASE " + " ".join(f"WHEN {a} THEN '{b}'" for a, b in codes) + " END"
SQL = {
    "vector_answers": "SELECT 'w' || vec_id AS word, CAST(k - 1 AS INTEGER) AS k, round(v[k] / n, 6) + 0 AS x FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS k, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings) a) b",
    "title_requests": sql("words", """SELECT chunk, 'https://titles.example/api?action=query&format=json&redirects=1&titles=' || url_encode(string_agg(word, '|' ORDER BY word)) AS url
FROM (SELECT word, CAST((row_number() OVER (ORDER BY word) - 1) // 50 + 1 AS BIGINT) AS chunk FROM (SELECT DISTINCT word FROM words) a) b GROUP BY chunk"""),
    "geo_requests": sql("participants", """SELECT lat, lon, 'https://places.example/reverse?accept-language=en-US&format=json&zoom=13&lat=' || printf('%.2f', lat / 100) || '&lon=' || printf('%.2f', lon / 100) AS url
FROM (SELECT DISTINCT CAST(round(latitude * 100) AS BIGINT) AS lat, CAST(round(longitude * 100) AS BIGINT) AS lon FROM participants WHERE NOT (latitude = 0 AND longitude = 0)) x"""),
    "geo_answers": sql("participants", """SELECT id_p, CASE WHEN ok THEN coalesce(CASE WHEN id_p % 2 = 0 THEN native_language END, CASE WHEN id_p % 3 = 0 THEN region END) END AS locality,
  CASE WHEN ok AND id_p % 5 = 0 THEN gender END AS region, CASE WHEN ok THEN native_language END AS country FROM (SELECT *, id_p % 7 <> 0 AS ok FROM participants) x"""),
    "combine_answers": sql("trials participants", "SELECT trial_id AS id_r, participant_id AS id_p, id_c, r.cue, r.sec AS section, response_1, response_2, response_3, age, gender, education, " + _CODE([(f"education = {k}", v) for k, v in scalars.EDUCATION_LABEL.items()]) + " AS education_label, native_language, " + _CODE([(f"native_language = '{k}'", v) for k, v in scalars.NATIVE_LANGUAGE.items()]) + " AS native_language_label FROM r LEFT JOIN p ON p.id_p = r.participant_id AND p.sec = r.sec LEFT JOIN c ON c.cue = r.cue AND c.sec = r.sec", more="""
r AS (SELECT *, CASE WHEN trial_id % 10 = 0 THEN 'set9' ELSE 'set' || (participant_id % 3) END AS sec FROM trials),
c AS (SELECT cue, sec, min(trial_id) AS id_c FROM r WHERE length(cue) % 2 = 0 GROUP BY 1, 2),
p AS (SELECT id_p, 'set' || (id_p % 3) AS sec, age, CAST(CASE education WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 6 THEN 3 WHEN 7 THEN 4 WHEN 5 THEN 5 END AS INTEGER) AS education,
  ['female', 'female', 'male', 'male', 'other', NULL][id_p % 6 + 1] AS gender, ['DEU', 'OST', 'SCH', 'LUX', NULL][id_p % 5 + 1] AS native_language FROM participants)"""),
    "left_join_clashing": "SELECT o_orderkey, o_custkey AS person, o_totalprice AS amount_o, c_mktsegment AS segment, c_acctbal AS amount_c FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal >= 0",
    "right_join": "SELECT d.doc_id, quality, lang FROM (SELECT doc_id, quality FROM labels WHERE toxic = 1) l RIGHT JOIN documents d ON d.doc_id = l.doc_id",
    "custom_words": sql("dict", "SELECT word, word IN (SELECT word FROM dict) OR count(*) >= 2 AS spelling_ok FROM words_raw GROUP BY word"),
    "log_frequency_tests": sql("words", "SELECT lang, n, round(abs(r), 6) AS r, round(least(abs(lo), abs(hi)), 6) AS ci_lower, round(greatest(abs(lo), abs(hi)), 6) AS ci_upper FROM (SELECT lang, n, r, tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)) AS lo, tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)) AS hi FROM (SELECT lang, count(*) AS n, corr(log10(n), CAST(length(word) AS DOUBLE)) AS r FROM (SELECT lang, word, count(*) AS n FROM words GROUP BY 1, 2) a GROUP BY lang) b) c"),
    "lattice_weighted": sql("edges_key", "SELECT i AS src, i + k AS dst, true AS from_graph FROM (SELECT n, unnest(range(n)) AS i FROM (SELECT count(*) AS n FROM (SELECT src FROM edges_key UNION SELECT dst FROM edges_key) a) b) c CROSS JOIN range(1, 43) r(k) WHERE i + k < n"),
    "column_file": sql("words", "SELECT DISTINCT word FROM words"),
    "guessed_separator": "SELECT o_orderkey, o_orderpriority || ', ' || o_orderstatus AS state FROM orders",
    "latin_report": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name || 'ü' AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation",
    "two_row_report": sql("participants", "SELECT CAST(a.age AS BIGINT) AS age, g.gender, h.half, count(id_p) AS n FROM (SELECT DISTINCT age FROM participants) a CROSS JOIN (SELECT DISTINCT gender FROM participants) g CROSS JOIN (VALUES (0, 'even'), (1, 'odd')) h(i, half) LEFT JOIN participants p ON p.age = a.age AND p.gender = g.gender AND p.id_p % 2 = h.i GROUP BY 1, 2, 3"),
    "stacked_tables": sql("trials", "SELECT * FROM (SELECT trial_id AS id, response_1 AS word FROM trials UNION ALL SELECT participant_id, response_2 FROM trials UNION ALL SELECT trial_id, response_3 FROM trials) x WHERE id IS NOT NULL AND word IS NOT NULL"),
    "unique_of_two": sql("trials", "SELECT cue AS value FROM trials UNION SELECT response_1 FROM trials"),
    "selected_columns": sql("participants", "SELECT id_p, region, abs(latitude) AS latitude, abs(longitude) AS longitude, age, CASE WHEN age = 99 THEN NULL WHEN age > 50 THEN 'old' ELSE 'young' END AS \"group\", CAST(CASE region WHEN 'EUROPE' THEN 1 WHEN 'ASIA' THEN 2 WHEN 'AMERICA' THEN 3 END AS INTEGER) AS level FROM participants"),
    "bound_columns": "SELECT c_name, c_custkey, p_name, p_partkey FROM (SELECT c_name, c_custkey, row_number() OVER (ORDER BY c_name, c_custkey) AS r FROM customer) c FULL JOIN (SELECT p_name, p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) AS r FROM part) p ON c.r = p.r",
    "bound_present": sql("trials", "SELECT trial_id, CASE WHEN trial_id % 2 = 0 THEN cue END AS cue, CASE WHEN trial_id % 2 = 1 THEN section END AS section FROM trials"),
    "first_removed": sql("words", "SELECT DISTINCT word, regexp_replace(word, 'e', '') AS shorter, word || 'a.b' AS dotless FROM words"),
    "chat_requests": sql("words", """SELECT DISTINCT word, '{"model":"model","messages":[{"role":"system","content":"kurz"},{"role":"user","content":"Wort: ' || word || '"}],"temperature":0.0}' AS body FROM words"""),
    "vector_requests": sql("words", """SELECT chunk, '{"model":"model","input":[' || string_agg('"Das Wort ist: ' || word || '"', ',' ORDER BY word) || ']}' AS body FROM (SELECT word, CAST((row_number() OVER (ORDER BY word) - 1) // 50 + 1 AS BIGINT) AS chunk FROM (SELECT DISTINCT word FROM words) a) b GROUP BY chunk"""),
}

"""Views of the test tables as survey concepts, in Spark and as SQL common table expressions of the same names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.reshape import wide_to_long


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _trials(spark: SparkSession, sf_dir: str, word: str) -> DataFrame:
    """Orders of two lines or more: the first line's part is the cue, the next three are the answers. Lines are dealt
    out by order once, as they are, and numbered there: an order has a few, so gathering them before would save nothing."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    if word == "p_name":
        lines = lines.join(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    else:
        lines = lines.withColumn(word, F.col("l_partkey"))
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    item = lambda k: F.max(F.when(F.col("__at") == k, F.col(word)))
    per = lines.withColumn("__at", at).groupBy(F.col("l_orderkey").alias("trial_id")).agg(item(1).alias("cue"), *(item(k + 1).alias(f"response_{k}") for k in (1, 2, 3)), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trial_id"), F.col("o_custkey").alias("participant_id"), F.col("o_orderpriority").alias("section"), F.col("o_orderdate").alias("created_at"))
    return orders.join(per, "trial_id").select("trial_id", "participant_id", "cue", "response_1", "response_2", "response_3", "section", "created_at")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trials(spark, sf_dir, "p_name")


def trials_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trials(spark, sf_dir, "p_partkey")


def answers(trials: DataFrame) -> DataFrame:
    return wide_to_long(trials, ["response"], (1, 2, 3))


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").join(F.broadcast(load(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    r = load(spark, sf_dir, "region")
    c = c.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 rows
    return c.select(
        F.col("c_custkey").alias("id_p"), F.col("c_mktsegment").alias("gender"), F.col("n_name").alias("native_language"), F.col("r_name").alias("region"),
        (F.col("c_acctbal") / 100).alias("latitude"), (F.col("c_acctbal") / 50).alias("longitude"), (16 + F.col("c_custkey") % 84).cast("int").alias("age"), (F.col("c_custkey") % 8).cast("int").alias("education"),
    )


def words(spark: SparkSession, sf_dir: str, low: bool = True) -> DataFrame:
    """(doc_id, pos, lang, word): runs of letters."""
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split("text", r"[^\p{L}]+", -1)).alias("pos", "word")).where("word <> ''")
    return d.withColumn("word", F.lower("word")) if low else d


def dictionary(spark: SparkSession, sf_dir: str, least: int = 5) -> DataFrame:
    """Words that occur so often, in lower case; they are counted as written first, so that few are put in lower case."""
    written = words(spark, sf_dir, low=False).groupBy("word").count()
    return written.groupBy(F.lower("word").alias("word")).agg(F.sum("count").alias("count")).where(F.col("count") >= least).select("word")


def norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source"), "doc_id")


def r6(c: Column) -> Column:
    """Rounded as in the SQL, so that the order of a sum does not show."""
    return F.round(c, 6)


TRIAL_BODY = """
  SELECT o_orderkey AS trial_id, o_custkey AS participant_id, cue, response_1, response_2, response_3, o_orderpriority AS section, o_orderdate AS created_at
  FROM orders JOIN (
    SELECT l_orderkey, max(CASE WHEN pos = 1 THEN w END) AS cue, max(CASE WHEN pos = 2 THEN w END) AS response_1, max(CASE WHEN pos = 3 THEN w END) AS response_2, max(CASE WHEN pos = 4 THEN w END) AS response_3
    FROM (SELECT l_orderkey, {word} AS w, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem JOIN part ON l_partkey = p_partkey) x
    GROUP BY l_orderkey HAVING count(*) > 1) y ON o_orderkey = l_orderkey"""
CTES = {
    "trials": TRIAL_BODY.format(word="p_name"),
    "trials_key": TRIAL_BODY.format(word="p_partkey"),
    "answers": "SELECT trial_id, participant_id, cue, section, created_at, position, response FROM trials CROSS JOIN LATERAL (VALUES (1, response_1), (2, response_2), (3, response_3)) v(position, response)",
    "answers_key": "SELECT trial_id, section, cue, position, response FROM trials_key CROSS JOIN LATERAL (VALUES (1, response_1), (2, response_2), (3, response_3)) v(position, response)",
    "participants": """SELECT c_custkey AS id_p, c_mktsegment AS gender, n_name AS native_language, r_name AS region, c_acctbal / 100 AS latitude, c_acctbal / 50 AS longitude,
  CAST(16 + c_custkey % 84 AS INTEGER) AS age, CAST(c_custkey % 8 AS INTEGER) AS education
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "words_raw": "SELECT doc_id, lang, i - 1 AS pos, ws[i] AS word FROM (SELECT doc_id, lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, lang, regexp_split_to_array(text, '[^\\p{L}]+') AS ws FROM documents) a) b WHERE ws[i] <> ''",
    "words": "SELECT doc_id, lang, pos, lower(word) AS word FROM words_raw",
    "dict": "SELECT word FROM words GROUP BY word HAVING count(*) >= 5",
    "norms": "SELECT l.doc_id, l.quality, l.toxic, d.n_chars, d.lang, d.source FROM labels l JOIN documents d USING (doc_id)",
    "counts": "SELECT cue, response, count(*) AS n FROM answers WHERE cue IS NOT NULL AND response IS NOT NULL GROUP BY cue, response",
    "edges": "SELECT cue AS src, response AS dst, count(*) AS weight FROM answers WHERE response IN (SELECT cue FROM answers WHERE cue IS NOT NULL) GROUP BY 1, 2",
    "edges_key": "SELECT cue AS src, response AS dst, count(*) AS weight FROM answers_key WHERE response IN (SELECT cue FROM answers_key WHERE cue IS NOT NULL) GROUP BY 1, 2",
}
_NEEDS = {
    "answers": ["trials"], "answers_key": ["trials_key"], "words": ["words_raw"], "dict": ["words"],
    "counts": ["answers"], "edges": ["answers"], "edges_key": ["answers_key"],
}


def sql(uses: str, body: str, recursive: bool = False, more: str = "") -> str:
    """A query over the named views; ``more``: further expressions, that come after these."""
    names: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, []):
            add(m)
        if n not in names:
            names.append(n)

    for n in uses.split():
        add(n)
    parts = [f"{n} AS ({CTES[n]})" for n in names] + ([more] if more else [])
    return (f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" if parts else "") + body

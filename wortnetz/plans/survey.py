"""Queries on trials, participants and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nulls, scalars, text
from ..operators import ingest, lexical, reshape, sampling, spelling
from .fixtures import answers, load, participants, r6, sql, trials, words

#: Stand-ins for the survey's codes in the test tables.
GENDER = {"BUILDING": "female", "AUTOMOBILE": "male", "MACHINERY": "other"}


def flagship_top_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top_associations(lexical.associations(answers(trials(spark, sf_dir))))


def ingest_join_recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = participants(spark, sf_dir).withColumnRenamed("id_p", "participant_id").withColumnRenamed("region", "p_section")
    out = trials(spark, sf_dir).join(p, "participant_id", "left")
    education = scalars.recode(F.col("education"), scalars.EDUCATION)
    return out.select("trial_id", "participant_id", "cue", scalars.recode(F.col("gender"), GENDER).alias("gender"), education.alias("education"), scalars.recode(education, scalars.EDUCATION_LABEL).alias("education_label"), nulls.is_in(F.upper("native_language"), ["GERMANY", "FRANCE"]).alias("listed"))


def _with_sentinels(df: DataFrame) -> DataFrame:
    def put(i: int):
        return F.when(F.col("trial_id") % 7 == i, F.lit("Unbekanntes Wort")).when(F.col("trial_id") % 5 == i, F.lit("?")).otherwise(F.col(f"response_{i}"))

    return df.withColumns({f"response_{i}": put(i) for i in (1, 2, 3)})


def sentinel_null_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.mark_missing(_with_sentinels(trials(spark, sf_dir)).select("trial_id", "cue", "response_1", "response_2", "response_3"))


_SENTINELS = "SELECT trial_id, participant_id, cue, " + ", ".join(f"CASE WHEN trial_id % 7 = {i} THEN 'Unbekanntes Wort' WHEN trial_id % 5 = {i} THEN '?' ELSE response_{i} END AS response_{i}" for i in (1, 2, 3)) + " FROM trials"


def wide_to_long_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = sentinel_null_out(spark, sf_dir)
    renamed = marked.withColumnsRenamed({f"no_further_response_{i}": f"no_further_{i}" for i in (1, 2, 3)})
    return reshape.wide_to_long(renamed, ["response", "no_further"], (1, 2, 3)).select("trial_id", "position", "response", "no_further", "unknown_word")


_MARKED = f"""s AS ({_SENTINELS}), l AS (SELECT trial_id, participant_id, cue, position, response AS raw, bool_or(coalesce(response, '') = 'Unbekanntes Wort') OVER (PARTITION BY trial_id) AS unknown_word,
  coalesce(response = '?', false) AS no_further FROM s CROSS JOIN LATERAL (VALUES (1, response_1), (2, response_2), (3, response_3)) v(position, response)),
m AS (SELECT trial_id, participant_id, cue, position, CASE WHEN raw NOT IN ('Unbekanntes Wort', '?') THEN raw END AS response, unknown_word, no_further FROM l)"""


def long_to_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.long_to_wide(answers(trials(spark, sf_dir)).where("response IS NOT NULL"), ["trial_id", "cue"], "position", ["response", "section"], (1, 2, 3))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = ingest.mark_missing(_with_sentinels(trials(spark, sf_dir)).drop("section", "created_at")).withColumnsRenamed({f"no_further_response_{i}": f"no_further_response_{i}" for i in (1, 2, 3)})
    long = reshape.wide_to_long(marked, ["response", "no_further_response"], (1, 2, 3)).withColumnRenamed("participant_id", "id_p").withColumn("ok", F.length("response") % 3 > 0)
    people = participants(spark, sf_dir).select("id_p", F.when(F.col("native_language") != "CHINA", F.col("native_language")).alias("native_language"))
    return ingest.participant_scores(long, people, "ok")


_SCORE_NAMES = ["score_n_gram", "score_unique_responses", "score_unknown_or_no_further_response", "score_unknown_word", "score_no_further_response", "score_spelling"]


def participant_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("id_p", "score_native_speaker", *(r6(F.col(c)).alias(c) for c in _SCORE_NAMES))


_SCORES_SQL = _MARKED + """, sc AS (SELECT participant_id AS id_p,
  sum(CASE WHEN response IS NOT NULL AND (CASE WHEN response = '' THEN 0 ELSE len(string_split(response, ' ')) - CAST(response LIKE '% ' AS INTEGER) END) > 1 THEN 1 ELSE 0 END) / nullif(count(response), 0) AS score_n_gram,
  count(DISTINCT response) / nullif(count(response), 0) AS score_unique_responses, avg(CAST(unknown_word OR no_further AS INTEGER)) AS score_unknown_or_no_further_response,
  avg(CAST(unknown_word AS INTEGER)) AS score_unknown_word, avg(CAST(no_further AS INTEGER)) AS score_no_further_response,
  sum(CASE WHEN length(response) % 3 > 0 THEN 1 WHEN response IS NOT NULL THEN 0 END) / nullif(count(response), 0) AS score_spelling
  FROM m GROUP BY 1),
ps AS (SELECT p.id_p, p.native_language <> 'CHINA' AS score_native_speaker, sc.* EXCLUDE (id_p) FROM participants p LEFT JOIN sc ON sc.id_p = p.id_p)"""
#: The test tables' scores lie elsewhere than a survey's.
CRITERIA = {"score_n_gram": ("<", 2.0), "score_unique_responses": (">", 0.85), "score_spelling": (">", 0.5), "score_unknown_or_no_further_response": ("<", 0.75)}
_WHERE = "score_n_gram < 2.0 AND score_unique_responses > 0.85 AND score_spelling > 0.5 AND score_unknown_or_no_further_response < 0.75"


def participant_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.select_participants(_scores(spark, sf_dir), CRITERIA).select("id_p")


def criteria_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ingest.criteria_report(_scores(spark, sf_dir), trials(spark, sf_dir).withColumnRenamed("participant_id", "id_p"), CRITERIA)
    return out.withColumns({"participant_share": r6(F.col("participant_share")), "trial_share": r6(F.col("trial_share"))})


def _report_sql() -> str:
    rows = [(k, f"coalesce({k} {op} {v}, false)") for k, (op, v) in CRITERIA.items()] + [("all", f"coalesce({_WHERE}, false)")]
    parts = [f"SELECT '{k}' AS criterion, count(*) FILTER ({c}) AS participants, count(*) AS of_participants, CAST(coalesce(sum(n) FILTER ({c}), 0) AS BIGINT) AS trials, CAST(sum(n) AS BIGINT) AS of_trials FROM ps LEFT JOIN nt ON nt.id_p = ps.id_p" for k, c in rows]
    return "SELECT *, round(participants / of_participants, 6) AS participant_share, round(trials / of_trials, 6) AS trial_share FROM (" + " UNION ALL ".join(parts) + ") x"


def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.histogram(_scores(spark, sf_dir), "score_unique_responses", 50, 0.0, 1.0, ["score_native_speaker"]).withColumn("density", r6(F.col("density")))


def _two_lists(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """All English and all French words."""
    w = words(spark, sf_dir)
    return [w.where(F.col("lang") == x).select("word").distinct() for x in ("en", "fr")]


def similar_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.similar_pairs(*_two_lists(spark, sf_dir), "word", 2)


def similar_cues_osa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All English and French words within two edits, a swap being one edit; SQL has no such distance."""
    return ingest.similar_pairs(*_two_lists(spark, sf_dir), "word", 2, osa=True)


def cue_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trials(spark, sf_dir).select("trial_id", "cue")
    names = load(spark, sf_dir, "part").select(F.col("p_name").alias("cue")).distinct()
    first = names.orderBy("cue").limit(3).agg(F.collect_list("cue").alias("c")).first()["c"]
    kept, _ = ingest.exclude_cues(t, names, first[:2], {first[2]: "renamed"})
    return kept


def coverage_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fixtures import trials_key

    return ingest.coverage_cutoff(trials_key(spark, sf_dir)).withColumn("share", r6(F.col("share")))


def sample_exact_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.slice_sample(trials(spark, sf_dir), 55, ["cue"], "trial_id", 1984).select("cue", "trial_id")


def sample_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trials(spark, sf_dir).select("cue", "trial_id")
    return reshape.membership(t, sampling.slice_sample(t, 55, ["cue"], "trial_id", 1984), "trial_id", "sampled")


def global_sample_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_split(trials(spark, sf_dir).select("trial_id", "cue"), 1000, "trial_id", 7)


def sample_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_groups(trials(spark, sf_dir).select("trial_id", "cue"), "cue", [5, 10, 20, 40], "trial_id", 3)


def matched_top_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trials(spark, sf_dir)
    return lexical.matched_cues(t, answers(t), 20, 50, 1984).select("cue", "trial_id")


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.chunks(trials(spark, sf_dir).select("trial_id"), 50, "trial_id")


def head_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = lexical.associations(answers(trials(spark, sf_dir)))
    return sampling.head_share(counts, 0.15, F.desc("n"), "cue", "response")


def mask_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = answers(trials(spark, sf_dir)).select("trial_id", "cue", "position", "response", (F.length("response") % 3 > 0).alias("spelling_ok"))
    return spelling.mask_one(long, ("trial_id", "cue"))


def publish_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trials(spark, sf_dir).join(participants(spark, sf_dir).withColumnRenamed("id_p", "participant_id"), "participant_id", "left")
    date = scalars.or_missing_date(F.when(F.col("trial_id") % 11 == 0, F.lit("2016-08-17 21:06:11").cast("timestamp")).otherwise(F.col("created_at")), "2016-08-17 21:06:11", F.col("created_at"))
    return t.select("trial_id", "participant_id", date.alias("created_at"), F.nullif("age", F.lit(99)).alias("age"), F.round("latitude", 2).alias("latitude"), F.regexp_extract("section", r"^(\d)", 1).cast("int").alias("section"), "cue", *(F.col(f"response_{i}").alias(f"response_corrected_{i}") for i in (1, 2, 3)))


def geo_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = participants(spark, sf_dir)
    pick = lambda k, of: F.when(F.col("id_p") % k == 0, F.col(of))
    address = F.struct(pick(2, "native_language").alias("city"), pick(3, "region").alias("town"), F.lit(None).cast("string").alias("village"), pick(5, "gender").alias("municipality"), pick(7, "region").alias("hamlet"), pick(4, "region").alias("state"), pick(6, "gender").alias("county"), F.lit(None).cast("string").alias("province"), pick(1, "native_language").alias("country"))
    return p.select("id_p", scalars.geo_fields(address).alias("g")).select("id_p", "g.*")


def geo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every participant with the place of its coordinates, which is looked up once: that of the first one there."""
    p = participants(spark, sf_dir).withColumns({"lat": scalars.coordinate_key(F.col("latitude")), "lon": scalars.coordinate_key(F.col("longitude"))})
    p = p.withColumn("known", ~((F.col("latitude") == 0) & (F.col("longitude") == 0)))  # zero itself is no place, what is rounded to it is one
    places = p.where("known").groupBy("lat", "lon", "known").agg(F.count("*").alias("n"), F.min_by("native_language", "id_p").alias("place"))
    return p.join(places, ["lat", "lon", "known"], "left").select("id_p", "lat", "lon", "n", "place")


def age_gender_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = participants(spark, sf_dir).withColumn("age", nulls.na_if(F.col("age"), 99))
    counts = p.where("age IS NOT NULL AND age < 90").groupBy("gender", (F.floor(F.col("age") / 10) * 10).cast("int").alias("band")).agg(F.count("*").alias("n"))
    return lexical.share_of_total(counts).withColumn("share", r6(F.col("share")))


def native_language_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = participants(spark, sf_dir).groupBy("native_language", "gender").agg(F.count("*").alias("k")).groupBy("native_language").agg(F.sum("k").alias("n"), F.max("k").alias("most"))
    return lexical.share_of_total(counts).withColumn("share", r6(F.col("share")))


def education_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = participants(spark, sf_dir).select(scalars.recode(F.col("education"), scalars.EDUCATION).alias("education"))
    return lexical.share_of_total(p.groupBy("education").agg(F.count("*").alias("n"))).withColumn("share", r6(F.col("share")))


def age_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = participants(spark, sf_dir)
    return p.groupBy("gender").agg(F.min("age").alias("low"), F.max("age").alias("high"), r6(F.avg("age")).alias("mean"), r6(F.stddev_samp("age")).alias("sd"), F.count("age").alias("n"), nulls.n_unique(nulls.na_if(F.col("age"), 99)).alias("n_unique"))


def poisoned_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = nulls.na_if(F.col("age"), 99) > 50
    return participants(spark, sf_dir).groupBy("native_language").agg(r6(nulls.share(flag)).alias("share"), nulls.r_sum(flag.cast("int")).alias("total"), nulls.r_all(flag).alias("every"))


def compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = answers(trials(spark, sf_dir)).where("response IS NOT NULL")
    dashed = F.when(F.col("trial_id") % 3 == 0, F.concat(F.lit("-"), F.col("response"))).when(F.col("trial_id") % 3 == 1, F.concat(F.col("response"), F.lit("-"))).otherwise(F.col("response"))
    return long.select("trial_id", "position", text.compound(dashed, F.col("cue")).alias("response"))


_A = "answers"
#: Letters of Western European words as one byte each: the SQL's distance counts bytes.
_BYTES = ("àâäáãåæçèéêëìíîïñòóôöõøœùúûüýÿß", "ABCDEFGHIJKLMNOPQRSTUVWXYZ01234")
QUERIES = {f.__name__: f for f in (flagship_top_associations, ingest_join_recode, sentinel_null_out, wide_to_long_multi, long_to_wide, participant_scores, participant_selection, criteria_report, score_histogram, similar_cues, similar_cues_osa, cue_exclusion, coverage_cutoff, sample_exact_n, sample_flag, global_sample_split, sample_groups, matched_top_cues, chunk_ids, head_share, mask_one, publish_projection, geo_hierarchy, geo_dedup, age_gender_pyramid, native_language_share, education_share, age_summary, poisoned_means)} | {"cue_compounds": compounds}
SQL = {
    "flagship_top_associations": sql("counts", "SELECT * FROM (SELECT cue, response, n, row_number() OVER (PARTITION BY cue ORDER BY n DESC, response) AS rank FROM counts) x WHERE rank <= 3"),
    "ingest_join_recode": sql("trials participants", "SELECT trial_id, participant_id, cue, CASE gender WHEN 'BUILDING' THEN 'female' WHEN 'AUTOMOBILE' THEN 'male' WHEN 'MACHINERY' THEN 'other' END AS gender, e AS education, CASE e WHEN 1 THEN 'no degree' WHEN 2 THEN 'elementary_school' WHEN 3 THEN 'secondary_school_diploma' WHEN 4 THEN 'high_school_diploma' WHEN 5 THEN 'higher_education_degree' END AS education_label, coalesce(upper(native_language) IN ('GERMANY', 'FRANCE'), false) AS listed FROM (SELECT *, CAST(CASE education WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 6 THEN 3 WHEN 7 THEN 4 WHEN 5 THEN 5 END AS INTEGER) AS e FROM trials LEFT JOIN participants ON id_p = participant_id) x"),
    "sentinel_null_out": sql("trials", "SELECT trial_id, cue, max(CASE WHEN position = 1 THEN response END) AS response_1, max(CASE WHEN position = 2 THEN response END) AS response_2, max(CASE WHEN position = 3 THEN response END) AS response_3, bool_or(unknown_word) AS unknown_word, bool_or(position = 1 AND no_further) AS no_further_response_1, bool_or(position = 2 AND no_further) AS no_further_response_2, bool_or(position = 3 AND no_further) AS no_further_response_3 FROM m GROUP BY trial_id, cue", more=_MARKED),
    "wide_to_long_multi": sql("trials", "SELECT trial_id, position, response, no_further, unknown_word FROM m", more=_MARKED),
    "long_to_wide": sql(_A, "SELECT trial_id, cue, " + ", ".join(f"max(CASE WHEN position = {i} THEN {c} END) AS {c}_{i}" for c in ("response", "section") for i in (1, 2, 3)) + " FROM answers WHERE response IS NOT NULL GROUP BY trial_id, cue"),
    "participant_scores": sql("trials participants", "SELECT id_p, score_native_speaker, " + ", ".join(f"round({c}, 6) AS {c}" for c in _SCORE_NAMES) + " FROM ps", more=_SCORES_SQL),
    "participant_selection": sql("trials participants", f"SELECT id_p FROM ps WHERE {_WHERE}", more=_SCORES_SQL),
    "criteria_report": sql("trials participants", _report_sql(), more=_SCORES_SQL + ", nt AS (SELECT participant_id AS id_p, count(*) AS n FROM trials GROUP BY 1)"),
    "score_histogram": sql("trials participants", "SELECT score_native_speaker, CAST(least(floor(score_unique_responses / 0.02), 49) AS INTEGER) AS bin, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY score_native_speaker) * 0.02), 6) AS density FROM ps WHERE score_unique_responses BETWEEN 0 AND 1 GROUP BY 1, 2", more=_SCORES_SQL),
    "similar_cues": sql(
        "words",
        """SELECT DISTINCT a.word AS a, b.word AS b FROM d a JOIN d b USING (rest) WHERE a.lang = 'en' AND b.lang = 'fr' AND a.word <> b.word AND levenshtein(a.k, b.k) <= 2""",
        more=f"""f AS (SELECT word, lang, translate(word, '{_BYTES[0]}', '{_BYTES[1]}') AS k FROM words WHERE lang IN ('en', 'fr') GROUP BY ALL),
d1 AS (SELECT word, lang, k, unnest([k[:i - 1] || k[i + 1:] FOR i IN range(1, len(k) + 1)]) AS rest FROM f),
d AS (SELECT word, lang, k, k AS rest FROM f UNION SELECT * FROM d1 UNION SELECT word, lang, k, unnest([rest[:i - 1] || rest[i + 1:] FOR i IN range(1, len(rest) + 1)]) FROM d1)""",
    ),
    "cue_exclusion": sql("trials", "SELECT trial_id, CASE WHEN r = 3 THEN 'renamed' ELSE cue END AS cue FROM trials JOIN (SELECT p_name, row_number() OVER (ORDER BY p_name) AS r FROM (SELECT DISTINCT p_name FROM part) x) y ON cue = p_name WHERE r > 2"),
    "coverage_cutoff": sql("trials_key", "SELECT CAST(k AS INTEGER) AS cutoff, CAST(auc AS BIGINT) AS auc, round(auc / (SELECT sum(n) FROM c), 6) AS share FROM (SELECT k, k * count(*) AS auc FROM range(1, 71) r(k) JOIN c ON n >= k GROUP BY k) x ORDER BY auc DESC, k LIMIT 1", more="c AS (SELECT cue, count(*) AS n FROM trials_key GROUP BY cue)"),
    "sample_exact_n": sql("trials", "SELECT cue, trial_id FROM (SELECT *, row_number() OVER (PARTITION BY cue ORDER BY md5('1984:' || trial_id), trial_id) AS r FROM trials) x WHERE r <= 55"),
    "sample_flag": sql("trials", "SELECT cue, trial_id, row_number() OVER (PARTITION BY cue ORDER BY md5('1984:' || trial_id), trial_id) <= 55 AS sampled FROM trials"),
    "global_sample_split": sql("trials", "SELECT trial_id, cue, CASE WHEN r <= 500 THEN 'train' ELSE 'test' END AS part FROM (SELECT *, row_number() OVER (ORDER BY md5('7:' || trial_id), trial_id) AS r FROM trials) x WHERE r <= 1000"),
    "sample_groups": sql("trials", "SELECT trial_id, cue FROM (SELECT trial_id, cue, i, row_number() OVER (PARTITION BY cue ORDER BY md5('3:' || trial_id), trial_id) AS r FROM trials JOIN (SELECT cue, row_number() OVER (ORDER BY md5('3:' || cue), cue) AS i FROM (SELECT DISTINCT cue FROM trials) x) y USING (cue)) z WHERE i <= 4 AND r <= [5, 10, 20, 40][i]"),
    "matched_top_cues": sql(_A, "SELECT cue, trial_id FROM (SELECT cue, trial_id, row_number() OVER (PARTITION BY cue ORDER BY md5('1984:' || trial_id), trial_id) AS r FROM trials WHERE cue IN (SELECT cue FROM (SELECT DISTINCT cue FROM trials) c LEFT JOIN (SELECT response, count(*) AS n FROM answers WHERE response IS NOT NULL GROUP BY 1) a ON a.response = c.cue ORDER BY n DESC NULLS LAST, cue LIMIT 20)) x WHERE r <= 50"),
    "chunk_ids": sql("trials", "SELECT trial_id, CAST((row_number() OVER (ORDER BY trial_id) - 1) // 50 + 1 AS BIGINT) AS chunk FROM trials"),
    "head_share": sql("counts", "SELECT cue, response, n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, cue, response) AS r FROM counts) x WHERE r <= floor(0.15 * (SELECT count(*) FROM counts))"),
    "mask_one": sql(_A, "SELECT t.trial_id, t.cue, " + ", ".join(f"CASE WHEN a.position = {i} THEN 'WORD' ELSE t.response_{i} END AS resp_{i}" for i in (1, 2, 3)) + ", a.response AS incorrect FROM answers a JOIN trials t USING (trial_id) WHERE length(a.response) % 3 = 0"),
    "publish_projection": sql("trials participants", "SELECT trial_id, participant_id, CASE WHEN trial_id % 11 = 0 THEN CAST(date_trunc('day', created_at) AS TIMESTAMP) ELSE created_at END AS created_at, nullif(age, 99) AS age, round(latitude, 2) AS latitude, CAST(regexp_extract(section, '^(\\d)', 1) AS INTEGER) AS section, cue, response_1 AS response_corrected_1, response_2 AS response_corrected_2, response_3 AS response_corrected_3 FROM trials LEFT JOIN participants ON id_p = participant_id"),
    "geo_hierarchy": sql("participants", "SELECT id_p, coalesce(CASE WHEN id_p % 2 = 0 THEN native_language END, CASE WHEN id_p % 3 = 0 THEN region END, CASE WHEN id_p % 5 = 0 THEN gender END, CASE WHEN id_p % 7 = 0 THEN region END) AS locality, coalesce(CASE WHEN id_p % 4 = 0 THEN region END, CASE WHEN id_p % 6 = 0 THEN gender END, CASE WHEN id_p % 2 = 0 THEN native_language END) AS region, native_language AS country FROM participants"),
    "geo_dedup": sql("participants", "SELECT id_p, lat, lon, CASE WHEN known THEN count(*) OVER w END AS n, CASE WHEN known THEN first_value(native_language) OVER (w ORDER BY id_p) END AS place FROM (SELECT *, CAST(round(latitude * 100) AS BIGINT) AS lat, CAST(round(longitude * 100) AS BIGINT) AS lon, NOT (latitude = 0 AND longitude = 0) AS known FROM participants) x WINDOW w AS (PARTITION BY lat, lon, known)"),
    "age_gender_pyramid": sql("participants", "SELECT gender, CAST(age // 10 * 10 AS INTEGER) AS band, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM participants WHERE age <> 99 AND age < 90 GROUP BY 1, 2"),
    "native_language_share": sql("participants", "SELECT native_language, CAST(sum(k) AS BIGINT) AS n, max(k) AS most, round(sum(k) / sum(sum(k)) OVER (), 6) AS share FROM (SELECT native_language, gender, count(*) AS k FROM participants GROUP BY 1, 2) x GROUP BY 1"),
    "education_share": sql("participants", "SELECT CAST(CASE education WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 6 THEN 3 WHEN 7 THEN 4 WHEN 5 THEN 5 END AS INTEGER) AS education, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM participants GROUP BY 1"),
    "age_summary": sql("participants", "SELECT gender, min(age) AS low, max(age) AS high, round(avg(age), 6) AS mean, round(stddev_samp(age), 6) AS sd, count(age) AS n, count(DISTINCT nullif(age, 99)) + CAST(bool_or(age = 99) AS INTEGER) AS n_unique FROM participants GROUP BY 1"),
    "poisoned_means": sql("participants", "SELECT native_language, CASE WHEN bool_or(age = 99) THEN NULL ELSE round(avg(CAST(age > 50 AS INTEGER)), 6) END AS share, CASE WHEN bool_or(age = 99) THEN NULL ELSE CAST(sum(CAST(age > 50 AS INTEGER)) AS BIGINT) END AS total, CASE WHEN bool_or(age <= 50) THEN false WHEN bool_or(age = 99) THEN NULL ELSE true END AS every FROM participants GROUP BY 1"),
    "cue_compounds": sql(_A, r"SELECT trial_id, position, CASE WHEN regexp_matches(d, '\p{Ll}-$') THEN regexp_replace(d, '^([^-]*)-', '\1') || lower(cue) ELSE d END AS response FROM (SELECT trial_id, position, cue, CASE WHEN regexp_matches(d, '^-\p{Ll}') THEN cue || substr(d, 2) ELSE regexp_replace(d, '^-', '') END AS d FROM (SELECT *, CASE trial_id % 3 WHEN 0 THEN '-' || response WHEN 1 THEN response || '-' ELSE response END AS d FROM answers WHERE response IS NOT NULL) x) y"),
}

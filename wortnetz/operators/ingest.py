"""Raw survey tables to the trial table, participant scores and selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nulls, scalars, text
from .reshape import bind_rows

POSITIONS = (1, 2, 3)


def combine(responses: DataFrame, participants: DataFrame, cues: DataFrame) -> DataFrame:
    """Answers with their participant (by id and section) and cue (by cue and section)."""
    p = participants.select(
        F.col("id").alias("id_p"), "section", "age", "education", "gender", F.col("nativeLanguage").alias("native_language"), "latitude", "longitude", F.col("created_at").alias("created_at_p")
    )
    c = cues.select(F.col("id").alias("id_c"), "cue", "section")
    r = responses.select(F.col("id").alias("id_r"), F.col("participantID").alias("id_p"), "cue", *(F.col(f"response{i}").alias(f"response_{i}") for i in POSITIONS), "section", F.col("created_at").alias("created_at_r"))
    return r.join(p, ["id_p", "section"], "left").join(c, ["cue", "section"], "left")


def mark_missing(trials: DataFrame, stem: str = "response_") -> DataFrame:
    """Sentinels as flags, their answers as null: unknown_word for the trial, no_further_response per position.

    A trial with the unknown-word sentinel in one position only stays one row.
    """
    cols = [f"{stem}{i}" for i in POSITIONS]
    unknown = F.lit(False)
    for c in cols:
        unknown = unknown | scalars.unknown_word(F.col(c))
    flags = {f"no_further_{stem}{i}": scalars.no_further(F.col(f"{stem}{i}")) for i in POSITIONS}
    marked = trials.select("*", unknown.alias("unknown_word"), *(f.alias(n) for n, f in flags.items()))
    blank = {c: F.when(~(scalars.unknown_word(F.col(c)) | scalars.no_further(F.col(c))), F.col(c)) for c in cols}
    return marked.withColumns(blank)


def clean_demographics(df: DataFrame) -> DataFrame:
    df = df.withColumns({"gender": scalars.recode(F.col("gender"), scalars.GENDER), "education": scalars.recode(F.col("education"), scalars.EDUCATION), "native_language": scalars.native_language(F.col("native_language"))})
    return df.withColumns({"education_label": scalars.recode(F.col("education"), scalars.EDUCATION_LABEL), "native_language_label": scalars.recode(F.col("native_language"), scalars.NATIVE_LANGUAGE)})


def similar_pairs(left: DataFrame, right: DataFrame, column: str, most: int = 2, osa: bool = False) -> DataFrame:
    """(a, b): pairs of different texts within an edit distance, by deletion neighbourhoods instead of a cross join.

    Two texts within k edits share a text that arises from each by k deletions or fewer, so pairs meet in an equi-join
    on such remainders and are then verified. With ``osa`` a swap of neighbours is one edit (a Python check, on the few
    pairs that meet). Meant for words: a text of n characters has about n ** k / k! remainders.
    """
    drop = lambda a: F.flatten(F.transform(a, lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1)))))

    def remainders(df: DataFrame, name: str) -> DataFrame:
        out = F.array(F.col(name))
        level = out
        for _ in range(most):
            level = F.array_distinct(drop(level))
            out = F.array_union(out, level)
        return df.select(F.col(column).alias(name)).where(F.col(name).isNotNull()).distinct().select(name, F.explode(out).alias("rest"))

    met = remainders(left, "a").join(remainders(right, "b"), "rest").where("a <> b").select("a", "b").distinct()
    near = text.osa_distance(F.col("a"), F.col("b")) <= most if osa else F.levenshtein("a", "b") <= most
    return met.where(near)


def exclude_cues(trials: DataFrame, cues: DataFrame, exclude: Sequence[str], rename: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Trials and cues after renaming; trials of excluded or unlisted cues go, cues get a flag."""
    renamed = lambda df: df.withColumn("cue", F.coalesce(scalars.recode(F.col("cue"), rename), F.col("cue")) if rename else F.col("cue"))
    cues = renamed(cues).withColumn("exclude", nulls.is_in(F.col("cue"), exclude))
    kept = cues.where("NOT exclude").select("cue").distinct()
    return renamed(trials).join(kept, "cue", "left_semi"), cues


def participant_scores(long: DataFrame, participants: DataFrame, ok: str | None = None) -> DataFrame:
    """Scores per participant from answers in long form (id_p, response, unknown_word, no_further_response [, ok]).

    One aggregation for all scores. Word-based scores are over answers that are there and null where there is none; a
    null flag makes a score null.
    """
    there = F.col("response").isNotNull()
    over = lambda x: F.when(there, x)
    n = F.count("response")
    scores = {
        "score_n_gram": F.try_divide(F.sum(over((text.word_count(F.col("response")) > 1).cast("int"))), n),
        "score_unique_responses": F.try_divide(F.count_distinct("response"), n),
        "score_unknown_or_no_further_response": nulls.share(F.col("unknown_word") | F.col("no_further_response")),
        "score_unknown_word": nulls.share(F.col("unknown_word")),
        "score_no_further_response": nulls.share(F.col("no_further_response")),
    }
    if ok:
        scores["score_spelling"] = F.try_divide(F.sum(over(F.col(ok).cast("int"))), n)
    native = participants.groupBy("id_p").agg(F.max(F.col("native_language").isNotNull()).alias("score_native_speaker"))
    return native.join(long.groupBy("id_p").agg(*(v.alias(k) for k, v in scores.items())), "id_p", "left")


#: A participant stays if all hold. Comparisons with null fail.
CRITERIA = {
    "score_n_gram": ("<", 0.3),
    "score_unique_responses": (">", 0.8),
    "score_spelling": (">", 0.6),
    "score_unknown_or_no_further_response": ("<", 0.6),
}
LEAST_AGE = 16


def meets(criteria: dict[str, tuple[str, float]], columns: Sequence[str]) -> dict[str, Column]:
    return {c: F.col(c) < v if op == "<" else F.col(c) > v for c, (op, v) in criteria.items() if c in columns}


def select_participants(scores: DataFrame, criteria: dict[str, tuple[str, float]] = CRITERIA) -> DataFrame:
    out = scores
    for condition in meets(criteria, scores.columns).values():
        out = out.where(condition)
    return out


def criteria_report(scores: DataFrame, trials: DataFrame, criteria: dict[str, tuple[str, float]] = CRITERIA) -> DataFrame:
    """Per criterion, and for all together, the participants and trials that meet it, and their shares."""
    conditions = meets(criteria, scores.columns)
    every = F.lit(True)
    for c in conditions.values():
        every = every & c
    size = trials.groupBy("id_p").agg(F.count("*").alias("n"))
    rows = scores.select("id_p", *(F.coalesce(c, F.lit(False)).alias(f"ok_{k}") for k, c in {**conditions, "all": every}.items())).join(size, "id_p", "left")
    names = [*conditions, "all"]
    long = rows.select("n", F.inline(F.array(*(F.struct(F.lit(k).alias("criterion"), F.col(f"ok_{k}").alias("ok")) for k in names))))
    out = long.groupBy("criterion").agg(F.count_if("ok").alias("participants"), F.count("*").alias("of_participants"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("n"))), F.lit(0)).alias("trials"), F.coalesce(F.sum("n"), F.lit(0)).alias("of_trials"))
    return out.withColumns({"participant_share": F.try_divide("participants", "of_participants"), "trial_share": F.try_divide("trials", "of_trials")})


def histogram(df: DataFrame, column: str, bins: int, low: float, high: float, by: Sequence[str] = ()) -> DataFrame:
    """Counts and densities per bin of equal width; the last bin includes its upper end."""
    width = (high - low) / bins
    bin_ = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
    counts = df.where((F.col(column) >= low) & (F.col(column) <= high)).groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("__t")) if by else counts.agg(F.sum("n").alias("__t"))
    joined = counts.join(totals, list(by)) if by else counts.join(F.broadcast(totals))  # one row
    return joined.withColumn("density", F.col("n") / (F.col("__t") * width)).drop("__t")


def coverage_cutoff(trials: DataFrame, cue: str = "cue", most: int = 70) -> DataFrame:
    """(cutoff, auc, share): the k up to ``most`` with the largest k * number of cues with k trials or more, the least of ties.

    Cues are counted per number of trials first, so at most ``most`` rows meet the list of candidates.
    """
    per_cue = trials.groupBy(cue).agg(F.count("*").alias("n"))
    capped = per_cue.groupBy(F.least("n", F.lit(most)).alias("n")).agg(F.count("*").alias("cues"), F.sum("n").alias("trials"))
    ks = F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k")
    auc = capped.select("cues", ks).groupBy("k").agg((F.sum("cues") * F.col("k")).alias("auc"))
    total = capped.agg(F.sum("trials").alias("total"))
    best = auc.agg(F.max(F.struct("auc", (-F.col("k")).alias("minus_k"))).alias("b"))
    return best.join(F.broadcast(total)).select((-F.col("b.minus_k")).cast("int").alias("cutoff"), F.col("b.auc").alias("auc"), (F.col("b.auc") / F.col("total")).alias("share"))


def unified(sources: dict[str, DataFrame], columns: dict[str, dict[str, str]], missing: Sequence[str] = ()) -> DataFrame:
    """Differently laid out sources in one schema: per source, SQL expressions of the columns; missing markers are null."""
    frames = []
    for name, df in sources.items():
        out = df.selectExpr(*(f"{e} AS {c}" for c, e in columns[name].items()))
        answers = [c for c in out.columns if c.startswith("response_")]
        out = out.withColumns({c: F.when(~F.col(c).isin(*missing), F.col(c)) for c in answers}) if missing and answers else out
        frames.append(out.withColumn("dataset", F.lit(name)))
    return bind_rows(*frames)

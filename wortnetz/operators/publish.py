"""The published trial table and its fixed-size subset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..session import stored
from .ingest import coverage_cutoff
from .reshape import long_to_wide, membership
from .sampling import slice_sample

#: The moment that stands for a missing date, and the age that stands for a missing one.
NO_DATE, NO_AGE = "2016-08-17 21:06:11", 99
#: Labels of the correction flags, in order.
CORRECTIONS = {f"correction_{k}": k for k in ("special_chars", "whitespace", "word_constructs", "casing_eszett_umlaut", "wikipedia", "llm")}


def published(trials: DataFrame, long: DataFrame, participants: DataFrame, geo: DataFrame) -> DataFrame:
    """One row per trial: participant, place, cue, and per position the corrected and raw answer, flags and corrections.

    Dates fall back to the participant's first day; participants and places are made unique by key, so no trial repeats.
    """
    wide = long_to_wide(long, ["id_r", "section", "cue", "unknown_word"], "position", ["response_corrected", "response", "no_further_response", "spelling_ok", "corrections"], (1, 2, 3))
    first = participants.groupBy(F.col("id").alias("id_p")).agg(F.min("created_at").alias("__first"))
    places = geo.select(scalars.coordinate_key(F.col("latitude")).alias("__lat"), scalars.coordinate_key(F.col("longitude")).alias("__lon"), "locality", "region", "country").dropDuplicates(["__lat", "__lon"])
    people = trials.select("id_r", "id_p", "created_at", "age", "gender", "education_label", "native_language_label", F.round("latitude", 2).alias("latitude"), F.round("longitude", 2).alias("longitude"))
    rows = people.join(first, "id_p", "left").withColumns({"__lat": scalars.coordinate_key(F.col("latitude")), "__lon": scalars.coordinate_key(F.col("longitude"))}).join(places, ["__lat", "__lon"], "left").join(wide, "id_r")
    per = lambda stem, name: [F.col(f"{stem}_{i}").alias(f"{name}_{i}") for i in (1, 2, 3)]
    return rows.select(
        F.col("id_r").alias("trial_id"), F.col("id_p").alias("participant_id"), scalars.or_missing_date(F.col("created_at"), NO_DATE, F.col("__first")).alias("created_at"),
        F.nullif("age", F.lit(NO_AGE)).alias("age"), "gender", F.col("education_label").alias("education"), F.col("native_language_label").alias("native_language"), "latitude", "longitude", "locality", "region", "country",
        scalars.recode(F.col("section"), scalars.SECTIONS).alias("section"), "cue", "unknown_word",
        *per("response_corrected", "response_corrected"), *per("response", "response_raw"), *per("no_further_response", "no_further_response"), *per("spelling_ok", "spelling_ok"), *per("corrections", "corrections"),
    )


def fixed_size(trials: DataFrame, n: int | None = None, seed: int = 1984, key: str = "trial_id", flag: str = "in_sample") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(exactly n trials of each cue that has them, all trials of those cues, all trials): the last two with a flag that
    tells the sampled ones. n is the coverage cut-off unless given. The sample is drawn once and stored."""
    if n is None:
        n = coverage_cutoff(trials).first()["cutoff"]
    full = trials.groupBy("cue").count().where(F.col("count") >= n).select("cue")
    plus = trials.join(full, "cue", "left_semi")
    sample = stored(slice_sample(plus, n, ["cue"], key, seed))
    return sample, membership(plus, sample, key, flag), membership(trials, sample, key, flag)

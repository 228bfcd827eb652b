"""Frequencies, types and tokens, matched cues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from .sampling import numbered, slice_max, slice_sample, top_n


def associations(long: DataFrame, cue: str = "cue", response: str = "response", by: Sequence[str] = ()) -> DataFrame:
    """(by, cue, response, n): how often each answer was given; nulls go."""
    return long.where(F.col(cue).isNotNull() & F.col(response).isNotNull()).groupBy(*by, cue, response).agg(F.count("*").alias("n"))


def top_associations(counts: DataFrame, n: int = 3, cue: str = "cue", response: str = "response") -> DataFrame:
    """The n most frequent answers per cue with their rank; equal counts by answer."""
    w = Window.partitionBy(cue).orderBy(F.desc("n"), response)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def frequencies(long: DataFrame, word: str, by: Sequence[str] = ()) -> DataFrame:
    return long.where(F.col(word).isNotNull()).groupBy(*by, word).agg(F.count("*").alias("n"))


def top_words(long: DataFrame, word: str, by: Sequence[str], n: int = 10, leave_out: Sequence[str] = ()) -> DataFrame:
    counts = frequencies(long, word, by)
    counts = counts.where(~F.col(word).isin(*leave_out)) if leave_out else counts
    return slice_max(counts, by, "n", n)


def top_table(counts: DataFrame, word: str, by: str, values: Sequence[str], n: int = 10) -> DataFrame:
    """One row per rank, one column per data set, each cell ``word (n)``; ranks are counted per data set."""
    w = Window.partitionBy(by).orderBy(F.desc("n"), word)
    ranked = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    cell = F.concat(F.col(word), F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    return ranked.groupBy("rank").agg(*(F.first(F.when(F.col(by) == v, cell), ignorenulls=True).alias(v) for v in values))


def types_tokens(long: DataFrame, word: str, cues: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Types, tokens, hapaxes and their shares; with cues, how many types and tokens are cues too."""
    counts = frequencies(long, word, by)
    if cues is not None:
        keys = cues.select(F.col("cue").alias(word), *by).distinct().withColumn("__cue", F.lit(True))
        counts = counts.join(keys, [*by, word], "left")
    measures = {"n_types": F.count("*"), "n_tokens": F.sum("n"), "n_hapax": F.count_if(F.col("n") == 1), "hapax_types": F.count_if(F.col("n") == 1) / F.count("*"), "hapax_tokens": F.count_if(F.col("n") == 1) / F.sum("n")}
    if cues is not None:
        hit = F.coalesce("__cue", F.lit(False))
        measures |= {"cue_types": F.count_if(hit), "cue_tokens": F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)) / F.sum("n")}
    return counts.groupBy(*by).agg(*(v.alias(k) for k, v in measures.items()))


def rank_curve(counts: DataFrame, word: str) -> DataFrame:
    """Words by descending frequency with rank and the Zipf-Mandelbrot curve."""
    return numbered(counts, F.desc("n"), word, name="rank").withColumn("zipf_mandelbrot", scalars.zipf_mandelbrot(F.col("rank")))


def zipf(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Zipf values from counts, totals and types per group."""
    totals = counts.groupBy(*by).agg(F.sum("n").alias("__total"), F.count("*").alias("__types"))
    return counts.join(totals, list(by)).withColumn("zipf", scalars.zipf_value(F.col("n"), F.col("__total"), F.col("__types"))).drop("__total", "__types")


def matched_cues(trials: DataFrame, long: DataFrame, n_cues: int, n_trials: int, seed: int, key: str = "trial_id") -> DataFrame:
    """The cues that are given most often as answers, and n random trials of each. A cue never given comes last."""
    given = frequencies(long, "response").withColumnRenamed("response", "cue").withColumnRenamed("n", "given")
    cues = top_n(trials.select("cue").where("cue IS NOT NULL").distinct().join(given, "cue", "left"), n_cues, "given", "cue")
    return slice_sample(trials.join(cues.select("cue"), "cue", "left_semi"), n_trials, ["cue"], key, seed)


def share_of_total(counts: DataFrame, n: str = "n", name: str = "share", by: Sequence[str] = ()) -> DataFrame:
    """Each count as a share of its group's, or the table's, sum."""
    if by:
        return counts.withColumn(name, F.col(n) / F.sum(n).over(Window.partitionBy(*by)))
    return counts.join(F.broadcast(counts.agg(F.sum(n).alias("__t")))).withColumn(name, F.col(n) / F.col("__t")).drop("__t")  # one row

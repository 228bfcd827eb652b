"""Job 2: association norms of a fixed size per cue, from raw trials.

Reads the survey's tables, marks missing answers, scores participants and keeps those that meet the criteria, finds the number of
trials per cue that covers most (unless it is given), draws that many of each cue by a digest of the seed, and writes
<output>/trials (all trials that stay, flagged if sampled) and <output>/strengths (how often each answer was given to a cue in the
sample, its share and rank), both partitioned by section, and <output>/criteria (what each criterion keeps). Nothing depends on
partitioning or time, so a run over the same tables writes the same rows.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import command_line
from wortnetz.operators import ingest, lexical, publish, reshape
from wortnetz.plans import fixtures
from wortnetz.session import stored

log = logging.getLogger("jobs.association_norms")

STRENGTHS = "cue string, response string, n long, strength double, rank int, section string"
PATHS = {"tables": "folder of the tables", "output": "folder of the results"}


def _write(df: DataFrame, path: str, by: str | None = None) -> None:
    out = df.write.mode("overwrite")
    (out.partitionBy(by) if by else out).parquet(path)
    log.info("wrote %s rows to %s", df.sparkSession.read.schema(df.schema).parquet(path).count(), path)


def strengths(trials: DataFrame) -> DataFrame:
    """Per section and cue each answer with its count, its share of the cue's answers, and its rank; equal counts by answer."""
    counts = lexical.associations(reshape.wide_to_long(trials, ["response"], (1, 2, 3)), by=["section"])
    cue = Window.partitionBy("section", "cue")  # the different answers of a cue in a sample of fixed size
    return counts.select("cue", "response", "n", F.round(F.col("n") / F.sum("n").over(cue), 6).alias("strength"), F.row_number().over(cue.orderBy(F.desc("n"), "response")).alias("rank"), "section")


def run(spark: SparkSession, tables: str, output: str, seed: int = 1984, trials_per_cue: int | None = None, criteria: dict | None = None) -> DataFrame:
    """Writes the three tables, and returns the strengths, read back. Trials, scores and the trials that stay are read several times,
    so each is worked out once and stored."""
    criteria = {k: tuple(v) for k, v in (criteria or ingest.CRITERIA).items()}
    for name in ("orders", "lineitem", "customer"):
        log.info("read %s rows of %s of %s", fixtures.load(spark, tables, name).count(), name, tables)
    trials = stored(ingest.mark_missing(fixtures.trials(spark, tables)).withColumnRenamed("participant_id", "id_p"))
    long = reshape.wide_to_long(trials, ["response", "no_further_response"], (1, 2, 3))
    scores = stored(ingest.participant_scores(long, fixtures.participants(spark, tables)))
    _write(ingest.criteria_report(scores, trials, criteria), f"{output}/criteria")
    kept = stored(trials.join(ingest.select_participants(scores, criteria).select("id_p"), "id_p", "left_semi").withColumnRenamed("id_p", "participant_id"))
    n = trials_per_cue or ingest.coverage_cutoff(kept).first()["cutoff"] or 1  # one row
    log.info("%s trials per cue", n)
    _write(publish.fixed_size(kept, n, seed)[2], f"{output}/trials", "section")
    sample = spark.read.parquet(f"{output}/trials").where("in_sample")
    _write(strengths(sample), f"{output}/strengths", "section")
    return spark.read.schema(STRENGTHS).parquet(f"{output}/strengths")


if __name__ == "__main__":
    command_line(run, "association_norms", __doc__, PATHS)

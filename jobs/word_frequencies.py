"""Job 1: word frequency norms per language from a growing folder of texts, incrementally.

A file stream takes the files that no earlier run has taken. Each batch's counts are one partition of <output>/counts, which is
overwritten if Spark repeats the batch after a failure, so no text counts twice. Then all batches' counts are summed into
<output>/frequencies, partitioned by language: counts, occurrences per million, Zipf value, and the number and share of documents
with the word. A run without new files writes the same rows again.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line
from wortnetz.functions.scalars import zipf_value

log = logging.getLogger("jobs.word_frequencies")

COUNTS = "lang string, word string, n long, n_docs long, batch long"
FREQUENCIES = "word string, n long, n_docs long, per_million double, zipf double, document_share double, lang string"
PATHS = {"source": "folder of the texts, or a pattern of files, Parquet with the columns lang and text", "output": "folder of the counts and the frequencies", "checkpoint": "folder of the stream's checkpoint"}


def words_of(text: Column) -> Column:
    """Runs of letters in lower case, sorted; none for null."""
    return F.array_sort(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", -1), ""))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n, n_docs); the row of the empty word has the number of documents, those without words too.

    Words are sorted within their text, so the first of equal ones shows, and one aggregation counts words and documents.
    An empty language is none.
    """
    rows = docs.select(F.nullif(F.col("lang").cast("string"), F.lit("")).alias("lang"), words_of(F.col("text")).alias("w"))
    first = F.transform("w", lambda x, i: F.struct(x.alias("word"), ((i == 0) | (x != F.get("w", i - 1))).cast("long").alias("first")))
    every = F.concat(F.array(F.struct(F.lit("").alias("word"), F.lit(1).cast("long").alias("first"))), first)
    return rows.select("lang", F.inline(every)).groupBy("lang", "word").agg(F.count("*").alias("n"), F.sum("first").alias("n_docs"))


def frequencies(counts: DataFrame, least: int = 1) -> DataFrame:
    """One row per language and word with ``least`` occurrences, measured against all words of the language."""
    per = counts.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    word = F.col("word") != ""
    totals = per.groupBy("lang").agg(F.sum(F.when(word, F.col("n"))).alias("tokens"), F.count_if(word).alias("types"), F.sum(F.when(~word, F.col("n"))).alias("docs"))
    joined = per.where(word & (F.col("n") >= least)).alias("p").join(F.broadcast(totals.alias("t")), F.col("p.lang").eqNullSafe(F.col("t.lang")))  # a row per language
    return joined.select(
        "word", "n", "n_docs", F.round(F.col("n") / F.col("tokens") * 1e6, 6).alias("per_million"), F.round(zipf_value(F.col("n"), F.col("tokens"), F.col("types")), 6).alias("zipf"),
        F.round(F.col("n_docs") / F.col("docs"), 6).alias("document_share"), F.col("p.lang").alias("lang"),
    )


def run(spark: SparkSession, source: str, output: str, checkpoint: str, files_per_batch: int = 200, least: int = 1) -> DataFrame:
    """Takes what is new in source, and returns all frequencies, read back."""
    counts, out = f"{output}/counts", f"{output}/frequencies"
    spark.createDataFrame([], COUNTS).write.mode("append").partitionBy("batch").parquet(counts)  # so that it is there to read

    def write_batch(docs: DataFrame, batch: int) -> None:
        rows = word_counts(docs).withColumn("batch", F.lit(batch).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(counts)
        kept = spark.read.schema(COUNTS).parquet(counts).where(F.col("batch") == batch)
        done = kept.agg(F.sum(F.when(F.col("word") == "", F.col("n"))).alias("documents"), F.count(F.lit(1)).alias("rows")).first()
        log.info("batch %s: read %s documents of %s, wrote %s rows of counts", batch, done["documents"] or 0, source, done["rows"])

    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", "36500d").parquet(source)  # late files count too
    query = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    every = frequencies(spark.read.schema(COUNTS).parquet(counts), least)
    # ranges of words, so that a language with most of them is split over tasks and files
    every.repartitionByRange("lang", "word").sortWithinPartitions("lang", "word").write.mode("overwrite").partitionBy("lang").parquet(out)
    result = spark.read.schema(FREQUENCIES).parquet(out)
    log.info("wrote %s words to %s", result.count(), out)
    return result


if __name__ == "__main__":
    command_line(run, "word_frequencies", __doc__, PATHS)

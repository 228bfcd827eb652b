"""Operator 6, exact dedup: a tree merge of sorted digest runs, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, text_of

#: The characters that do not count (fixed values): space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: The order of the binomial tree that a round is: 2 ** ORDER runs meet in one.
ORDER = 2


def stripped(column):
    for c in BLANKS:
        column = F.replace(column, F.lit(c), F.lit(""))
    return column


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest (SHA-256 of the stripped text), check (its XXH64 and length), n_chars and run (the input partition).

    A digest never decides alone: rows are one group only if the check agrees too.
    """
    bare = stripped(text_of(text_col))
    return df.select(
        F.col(id_col).cast("long").alias("id"), F.length(text_of(text_col)).cast("long").alias("n_chars"), bare.alias("bare")
    ).select(
        "id", "n_chars", F.unhex(F.sha2("bare", 256)).alias("digest"), F.struct(F.xxhash64("bare").alias("xx"), F.octet_length("bare").alias("bytes")).alias("check"), F.spark_partition_id().alias("run")
    )


def _sliced(level: DataFrame, order: int, slices: int) -> DataFrame:
    """Runs r with equal r // 2 ** order get one number, and rows the number of their slice: a range of the digests."""
    lead = F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int")
    return level.withColumns({"run": F.shiftright("run", order), "slice": F.shiftright(lead * slices, 16)})


def tree_merge(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(digest, check, best, group_size): one row per group of equal texts, best = (-n_chars, no id, id, rid).

    Level 0: each partition sorts its digests into one run and keeps one verified row per digest. Then, in binomial rounds,
    the runs whose numbers agree but for their last ``order`` bits are exchanged, in slices by range of digest, sorted and
    merged: of the rows with one digest and check the smallest stays. In later rounds there are fewer runs and more slices,
    so a round uses every executor. A group of any size enters a merge as one row per run at most. Rounds: the logarithm of
    the number of partitions to the base 2 ** order.
    """
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best = F.struct((-F.col("n_chars")).alias("longest"), F.col("id").isNull().alias("no_id"), F.col("id"), F.col("rid"))
    level = rows.select("run", "digest", "check", best.alias("best"), F.lit(1).cast("long").alias("group_size"))
    first = True
    while first or runs > 1:
        runs = -(-runs >> order) if runs > 1 << order else 1
        slices = min(1 << 14, -(-tasks // runs))
        level = _sliced(level, order, slices)
        if not first:  # by run and slice; the first time the sorted runs are merged before they are exchanged
            level = level.repartition("run", "slice").sortWithinPartitions("run", "slice", "digest", "check")
        level = level.groupBy("run", "slice", "digest", "check").agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))
        first = False
    return level.select("digest", "check", "best", "group_size")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256, n_chars.

    Texts are equal when identical without blanks. Of a group, the row with the most code points stays, then the one
    with the smallest id; a null id comes last; of rows that repeat text and id, exactly one has kept = true.
    Null texts count as empty; an empty table gives no rows; other columns are neither read nor returned.
    """
    rows = cut(digests(df, id_col, text_col).withColumn("rid", F.monotonically_increasing_id()))
    # stored, so that the join deals out both sides anew and Spark can split a hot digest
    won = cut(tree_merge(rows, order).select("digest", "check", F.col("best.id").alias("keep_id"), F.col("best.rid").alias("keep_rid"), "group_size"))
    return rows.join(won, ["digest", "check"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "n_chars"
    )


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """The rows of df that stay, with all their columns; of rows that repeat id and text, one stays.

    Every row that stays carries its group's keep_id and digest, so it is found again by both.
    """
    mark = ["__id", "__sha"]
    kept = exact_dedup(df, id_col, text_col, order).where("kept").select(F.coalesce(F.col(id_col), F.lit(0)).alias("__id"), F.col("text_sha256").alias("__sha"), F.col("n_chars").alias("__n"), F.col(id_col).isNull().alias("__no"))
    keyed = df.withColumns({"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(0)), "__no": F.col(id_col).isNull(), "__sha": F.sha2(stripped(text_of(text_col)), 256), "__n": F.length(text_of(text_col)).cast("long")})
    return keyed.join(kept, [*mark, "__n", "__no"], "left_semi").dropDuplicates([*mark, "__n", "__no"]).drop(*mark, "__n", "__no")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of equal texts; nulls, ties, repeated rows and a table without rows as exact_dedup has
    them."""
    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_chars")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents
), r AS (
  SELECT doc_id, sha256(bare) AS h, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size
  FROM d WINDOW w AS (PARTITION BY bare ORDER BY n DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM r
"""

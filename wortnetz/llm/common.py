"""What the corpus operators share: paths in the shared folder, lineage cuts, batches and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import HUB_ROWS, HUBS, star_links
from ..session import shared_dir
from ..session import stored as cut

__all__ = ["bound_batches", "connected_components", "cut", "join_groups", "keep_rows", "row_key", "shared_dir", "shared_path", "spread", "table", "text_of"]

#: Rows in one Arrow batch that goes to Python; with the byte limit below, a worker's memory stays bounded.
BATCH_ROWS = 1024
BATCH_BYTES = 16 << 20


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the Arrow batches of the session's Python stages by rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """The same rows over at least as many partitions as the session shuffles to (a small table is often one partition)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n) if df.rdd.getNumPartitions() < n // 2 else df


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(id_col: str, text_col: str) -> Column:
    """A hash by which a row is found again: ids may be null, or repeat with other texts."""
    return F.xxhash64(F.col(id_col).cast("long"), text_of(text_col))


def keep_rows(df: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of df, with all columns, whose id and row_key kept (id, row_key) lists; of rows that repeat id and text one."""
    keys = ["__key", "__id", "__no"]
    ids = lambda c: {"__id": F.coalesce(F.col(c).cast("long"), F.lit(0)), "__no": F.col(c).isNull()}
    wanted = kept.withColumns({"__key": F.col("row_key"), **ids("id")}).select(*keys).distinct()
    return df.withColumns({"__key": row_key(id_col, text_col), **ids(id_col)}).join(wanted, keys, "left_semi").dropDuplicates(keys).drop(*keys)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of the undirected edges; component is the smallest node reachable.

    Null ends and loops are dropped; no edges give no rows. Links, not members, decide the work; hubs, of which there is a
    bounded number, are joined by broadcast, so a component of any size is spread over all executors.
    """
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = star_links(ends.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).distinct())
    roots = e.select(F.col("u").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).union(roots)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], total: int, size: str = "n") -> DataFrame:
    """rows left-joined to groups, which has one row per key and in ``size`` how many of the ``total`` rows have it; rows of
    keys that groups lacks, or that are null, get nulls.

    A key with more than total / HUBS rows is hot, so there are HUBS hot ones at most, whatever the data: these are
    broadcast, and no task gets a hot key's rows; the others meet in a join on the key.
    """
    limit = max(HUB_ROWS, total // HUBS)
    hot = groups.where(F.col(size) > limit).drop(size).withColumn("__hot", F.lit(True))
    split = rows.join(F.broadcast(hot), keys, "left")
    rest = split.where("__hot IS NULL").select(*rows.columns).join(groups.where(F.col(size) <= limit).drop(size), keys, "left")
    return split.where("__hot").drop("__hot").unionByName(rest)

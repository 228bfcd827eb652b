"""Reproducible samples, ranks and slices. The order is that of a digest, so it depends on no partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def draw(seed: int, *keys: str) -> Column:
    """A pseudo-random text that depends on the seed and the keys alone."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def slice_sample(df: DataFrame, n: int | Column, by: Sequence[str], key: str, seed: int) -> DataFrame:
    """Exactly n rows per group, or all of a smaller one. Spark limits each task's part before the exchange."""
    w = Window.partitionBy(*by).orderBy(draw(seed, key), key)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def sample_split(df: DataFrame, n: int, key: str, seed: int, name: str = "part") -> DataFrame:
    """n rows of the whole table, the first half marked ``train``, the rest ``test``."""
    top = df.withColumn("__d", draw(seed, key)).orderBy("__d", key).limit(n)
    w = Window.orderBy("__d", key)  # over n rows
    return top.withColumn(name, F.when(F.row_number().over(w) <= n // 2, "train").otherwise("test")).drop("__d")


def sample_groups(df: DataFrame, group: str, sizes: Sequence[int], key: str, seed: int) -> DataFrame:
    """As many random groups as there are sizes, and of the i-th group sizes[i] random rows."""
    picked = df.select(group).where(F.col(group).isNotNull()).distinct().orderBy(draw(seed, group), group).limit(len(sizes))
    picked = picked.withColumn("__i", F.row_number().over(Window.orderBy(draw(seed, group), group)))
    wanted = picked.withColumn("__n", F.element_at(F.array(*map(F.lit, sizes)), F.col("__i").cast("int"))).drop("__i")
    w = Window.partitionBy(group).orderBy(draw(seed, key), key)
    return df.join(wanted, group).withColumn("__rn", F.row_number().over(w)).where("__rn <= __n").drop("__rn", "__n")


def slice_max(df: DataFrame, by: Sequence[str], column: str, n: int) -> DataFrame:
    """The n largest per group, with all ties."""
    w = Window.partitionBy(*by).orderBy(F.col(column).desc())
    return df.withColumn("__r", F.rank().over(w)).where(F.col("__r") <= n).drop("__r")


def top_n(df: DataFrame, n: int, column: str, *ties: str) -> DataFrame:
    """The n largest of the table, nulls last, without ties."""
    return df.orderBy(F.col(column).desc_nulls_last(), *ties).limit(n)


def numbered(df: DataFrame, *order: Column | str, name: str = "rn") -> DataFrame:
    """Row numbers from 1 over the whole table in a total order.

    The table is sorted over all executors; only the row count of each partition comes to the driver.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()))
    part, place = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    before, at = [], 0
    for r in rows.groupBy(part.alias("p")).count().orderBy("p").collect():
        before.append((r["p"], at))
        at += r["count"]
    offsets = df.sparkSession.createDataFrame(before or [(0, 0)], "__p long, __before long")  # a row per partition
    return rows.withColumn("__p", part).join(F.broadcast(offsets), "__p").withColumn(name, place + F.col("__before") + 1).drop("__m", "__p", "__before")


def chunks(df: DataFrame, size: int, *order: Column | str, name: str = "chunk") -> DataFrame:
    """Numbers from 1 of consecutive chunks of so many rows."""
    return numbered(df, *order, name="__rn").withColumn(name, F.floor((F.col("__rn") - 1) / size) + 1).drop("__rn")


def head_share(df: DataFrame, share: float, *order: Column | str) -> DataFrame:
    """The first floor(share * rows) rows of an order."""
    return df.orderBy(*order).limit(int(share * df.count()))

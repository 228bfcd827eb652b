"""Rows of a sparse matrix that are alike: a cosine self-join by prefixes, and communities of the graph that it gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .graph import louvain
from .matrix import normalize_rows

#: Entries of one column that meet each other in one key of the join; columns with more are split into blocks.
BLOCK = 512
#: Cosines are compared with the threshold after rounding to so many digits, so the order of a sum decides nothing.
DIGITS = 9


def row_classes(unit: DataFrame) -> DataFrame:
    """(row_id, representative, size): rows with the same entries share the smallest of their ids.

    Rows are equal if the count of their entries and two sums of 64-bit hashes of them agree, which aggregates partially, so a
    long row is never gathered.
    """
    marks = [F.sum(F.xxhash64(F.lit(k), "col_id", "value").cast("decimal(38,0)")).alias(f"h{k}") for k in (1, 2)]
    prints = stored(unit.groupBy("row_id").agg(F.count("*").alias("nnz"), *marks))
    keys = ["nnz", "h1", "h2"]
    first = prints.groupBy(*keys).agg(F.min("row_id").alias("representative"), F.count("*").alias("size"))
    return prints.join(first, keys).select("row_id", "representative", "size")


def prefixes(unit: DataFrame, threshold: float) -> DataFrame:
    """(row_id, col_id, tail, nnz): the leading entries of unit rows whose columns run from the rarest to the most frequent.

    tail is the norm of an entry and all that follow it. An entry leads while its tail reaches the threshold: what comes after
    cannot reach it in a product with any unit row. A row is sorted in a window, which spills; it has at most as many entries as there
    are columns.
    """
    often = unit.groupBy("col_id").agg(F.count("*").alias("often"))
    order = "(PARTITION BY row_id ORDER BY often DESC, col_id DESC ROWS UNBOUNDED PRECEDING)"
    placed = unit.join(often, "col_id").selectExpr("row_id", "col_id", f"sqrt(sum(value * value) OVER {order}) AS tail", "count(*) OVER (PARTITION BY row_id) AS nnz")
    return placed.where(F.col("tail") >= threshold - 10.0**-DIGITS)


def candidates(leading: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(short, long): pairs of rows, each once, that may reach the threshold; short has no more entries than long.

    Both rows of such a pair lead with their first common column, and the product of their tails there bounds their cosine, as
    earlier columns add nothing. So rows meet by columns of their prefixes, and pairs whose tails fall short go inside the join. A column
    of n rows is split into n / block blocks, and each pair of its blocks is a key of its own.
    """
    per = leading.groupBy("col_id").agg(F.count("*").alias("n")).where("n > 1").select("col_id", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = stored(leading.join(per, "col_id").withColumn("at", F.pmod(F.xxhash64("row_id"), F.col("blocks")).cast("int")))
    end = lambda c, i, j: dealt.select("col_id", i.alias("i"), j.alias("j"), F.struct("nnz", "row_id").alias(c), F.col("tail").alias(f"tail_{c}"))
    left = end("x", F.col("at"), F.explode(F.sequence("at", F.col("blocks") - 1)))
    right = end("y", F.explode(F.sequence(F.lit(0), "at")), F.col("at"))
    met = left.join(right, ["col_id", "i", "j"]).where((F.col("tail_x") * F.col("tail_y") >= threshold - 10.0**-DIGITS) & ((F.col("i") < F.col("j")) | (F.col("x") < F.col("y"))))
    return met.select(F.least("x", "y")["row_id"].alias("short"), F.greatest("x", "y")["row_id"].alias("long")).distinct()


def similar_rows(coo: DataFrame, threshold: float, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): all pairs (a, b, cosine), a < b, of different rows with a cosine of the threshold or more, between the
    representatives of equal rows, and (row_id, representative, size).

    Repeated coordinates are summed. Null ids, and entries that are null, zero or not finite, are left out; a row that loses all of its
    entries this way is no member and has no pairs. Values may be negative. The threshold lies over 0: below that, rows
    without a common column would be pairs.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie over 0, up to 1")
    finite = coo.where("row_id IS NOT NULL AND col_id IS NOT NULL AND abs(value) < double('infinity')").groupBy("row_id", "col_id").agg(F.sum("value").alias("value"))
    unit = stored(normalize_rows(stored(finite.where("value <> 0")), "l2"))
    members = stored(row_classes(unit))
    one = stored(unit.join(members.where("row_id = representative").select("row_id"), "row_id", "left_semi"))
    found = candidates(stored(prefixes(one, threshold)), threshold, block)
    shorter = found.join(one.select(F.col("row_id").alias("short"), "col_id", F.col("value").alias("x")), "short")
    common = shorter.join(one.select(F.col("row_id").alias("long"), "col_id", F.col("value").alias("y")), ["long", "col_id"])
    dots = common.groupBy(F.least("short", "long").alias("a"), F.greatest("short", "long").alias("b")).agg(F.sum(F.col("x") * F.col("y")).alias("cosine"))
    return stored(dots.where(F.round("cosine", DIGITS) >= threshold)), members


def link_counts(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(row_id, n_links, strength): how many other rows each row is linked to, equal ones included, and the sum of the cosines."""
    size = members.where("row_id = representative").select("row_id", "size")
    both = pairs.select(F.col("a").alias("representative"), F.col("b").alias("row_id"), "cosine").union(pairs.select("b", "a", "cosine"))
    per = both.join(size, "row_id").groupBy("representative").agg(F.sum("size").alias("n"), F.sum(F.col("size") * F.col("cosine")).alias("s"))
    out = members.join(per, "representative", "left").na.fill(0, ["n", "s"])
    return out.select("row_id", (F.col("n") + F.col("size") - 1).alias("n_links"), (F.col("s") + F.col("size") - 1).alias("strength"))


def similarity_graph(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(src, dst, weight) between representatives: the links of all rows, summed, with a loop for those within a class."""
    size = lambda c: members.where("row_id = representative").select(F.col("row_id").alias(c), F.col("size").alias(f"size_{c}"))
    links = pairs.join(size("a"), "a").join(size("b"), "b").select(F.col("a").alias("src"), F.col("b").alias("dst"), (F.col("cosine") * F.col("size_a") * F.col("size_b")).alias("weight"))
    loops = members.where("row_id = representative AND size > 1").select("row_id", "row_id", (F.col("size") * (F.col("size") - 1) / 2).alias("weight"))
    return links.union(loops)


def clusters(pairs: DataFrame, members: DataFrame, **options) -> DataFrame:
    """(row_id, cluster): communities of the similarity graph, named by their smallest row; a row without links is its own.

    Equal rows stay together: they have the same neighbours, and the strongest links to each other. options are those of louvain.
    """
    found = louvain(stored(similarity_graph(pairs, members)), **options).withColumnRenamed("id", "representative")
    named = found.groupBy("community").agg(F.min("representative").alias("cluster"))
    of = found.join(named, "community").select("representative", "cluster")
    return members.join(of, "representative", "left").select("row_id", F.coalesce("cluster", "representative").alias("cluster"))

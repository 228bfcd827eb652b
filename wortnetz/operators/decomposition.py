"""Truncated singular value decomposition of a sparse matrix: a block range finder by joins, and a tree of QR factorisations.

Vectors of rows and columns stay in tables (id, vec). The driver gets triangles of width x width numbers alone, where the width is
the number of dimensions asked for and a few more, whatever the size of the matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Triangles that are merged by one task of the tree; dimensions beyond those asked for, which speed up the iteration.
FAN, SPARE = 8, 16
#: Singular values below this share of the largest one count as zero.
RANK = 1e-12


def times(entries: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """(id, vec): the matrix (i, j, value) times the columns of vectors (id, vec), whose ids are its j.

    A join on j, whose large keys adaptive execution splits, and sums by i that are taken in part before they are shuffled.
    """
    met = entries.join(vectors.withColumnRenamed("id", "j"), "j")
    return met.groupBy(F.col("i").alias("id")).agg(F.array(*(F.sum(F.col("value") * F.get("vec", F.lit(k))) for k in range(width))).alias("vec"))


def triangle(rows: DataFrame, width: int, fan: int = FAN) -> np.ndarray:
    """R of the QR factorisation of stored rows (id, vec): one of each partition, batch after batch, merged ``fan`` at a time."""

    def leaf(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.zeros((0, width))
        for part in parts:
            if len(part):
                r = np.linalg.qr(np.vstack([r, np.stack(part["vec"])]), mode="r")
        if len(r):
            yield pd.DataFrame({"node": [TaskContext.get().partitionId()], "r": [r.ravel()]})

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        r = np.linalg.qr(np.vstack([x.reshape(-1, width) for x in part.sort_values("node")["r"]]), mode="r")
        return pd.DataFrame({"node": [int(part["node"].iloc[0]) // fan], "r": [r.ravel()]})

    schema, nodes, left = "node long, r array<double>", rows.select("vec"), rows.rdd.getNumPartitions()
    nodes = nodes.mapInPandas(leaf, schema)
    while left > 1:
        nodes, left = nodes.groupBy(F.floor(F.col("node") / fan)).applyInPandas(merge, schema), -(-left // fan)
    got = nodes.collect()  # one row, or none
    return np.array(got[0]["r"]).reshape(-1, width) if got else np.zeros((0, width))


def turned(rows: DataFrame, by: np.ndarray) -> DataFrame:
    """(id, vec) with each vector times a small matrix."""

    def turn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                yield pd.DataFrame({"id": part["id"], "vec": list(np.stack(part["vec"]) @ by)})

    return rows.select("id", "vec").mapInPandas(turn, f"id {dict(rows.dtypes)['id']}, vec array<double>")


def orthonormal(rows: DataFrame, width: int) -> tuple[DataFrame, int]:
    """Stored rows with orthonormal columns that span the same space, and how many there are. The second turn takes away what the
    first one leaves where columns are nearly dependent."""
    for _ in range(2):
        _, s, vt = np.linalg.svd(triangle(rows, width), full_matrices=False)
        keep = s > RANK * max(s, default=0.0)
        width = int(keep.sum())
        if not width:
            break
        rows = stored(turned(rows, vt[keep].T / s[keep]))
    return rows, width


def truncated(coo: DataFrame, k: int, spare: int = SPARE, tol: float = 1e-12, rounds: int = 60, seed: int = 0) -> DataFrame:
    """(id, vec) for each row_id of coo (row_id, col_id, value): U * d of the k largest singular values, or of the rank if that is lower.

    Numbers drawn by hash for each column start the range; each round multiplies it by the transpose and the matrix, with an
    orthonormal basis after each product, until the k values change by less than tol of the largest, or the range holds all
    of the matrix. Signs are arbitrary, so results are compared by cosines. Repeated coordinates are summed; null ids and values are left
    out; a matrix of zeros gives empty vectors. A matrix whose values do not settle in ``rounds`` rounds is an error.
    """
    a = stored(coo.where("row_id IS NOT NULL AND col_id IS NOT NULL AND value IS NOT NULL").groupBy("row_id", "col_id").agg(F.sum("value").alias("value")))
    ahead = a.select(F.col("row_id").alias("i"), F.col("col_id").alias("j"), "value")
    back = a.select(F.col("col_id").alias("i"), F.col("row_id").alias("j"), "value")
    sides = [ahead.select(F.col(c).alias("id")).distinct() for c in ("i", "j")]
    least = min(side.count() for side in sides)
    width = min(k + spare, least)
    drawn = F.transform(F.sequence(F.lit(1), F.lit(max(width, 1))), lambda x: F.xxhash64(F.lit(seed), x, "id") / F.lit(2.0**63))
    basis, found = (orthonormal(stored(times(ahead, stored(sides[1].select("id", drawn.alias("vec"))), width)), width)) if width else (sides[0], 0)
    if not found:
        return sides[0].select("id", F.array().cast("array<double>").alias("vec"))
    before = None
    for _ in range(rounds):
        across = stored(times(back, basis, found))
        u, s, _ = np.linalg.svd(triangle(across, found).T, full_matrices=False)
        whole = found < width or width == least
        if whole or (before is not None and np.abs(s[:k] - before).max() <= tol * s[0]):
            keep = s[:k] > RANK * s[0]
            return turned(basis, (u * s)[:, :k][:, keep])
        before = s[:k]
        across, found = orthonormal(across, found)
        basis, found = orthonormal(stored(times(ahead, across, found)), found)
        if found < len(before):
            before = None
    raise RuntimeError(f"singular values did not settle in {rounds} rounds")

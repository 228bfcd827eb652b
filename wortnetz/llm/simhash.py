"""Operator 4, SimHash near-dedup: a Gray-order hierarchical index over 64-bit fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, connected_components, cut, keep_rows, row_key, spread, table, text_of

#: The contract's shingles for the query; operators and the pipeline on word shingles take five words.
SEED = 42
#: Fingerprints link at so many differing bits or fewer.
MAX_BITS = 2
#: The index is kept in MAX_BITS + 1 rotations; links differ in none of the leading ROOT_BITS of one of them at least.
ROOT_BITS = 21
#: Fingerprints in one block (a unit of work), and children of an index node.
BLOCK, FANOUT = 4096, 16
#: Shingles hashed at a time, whatever the length of the text.
CHUNK = 1 << 16


def fingerprint(text: str, words: int) -> int:
    """Unsigned SimHash of a text; 0 without words."""
    w = text.encode().lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(islice(w, i, None) for i in range(words)))) if len(w) > words else iter([b" ".join(w)])
    hashes, counts, n = map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.zeros(64, np.int64), 0
    left = max(1, len(w) - words + 1)
    while left:
        h = np.fromiter(islice(hashes, CHUNK), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        n, left = n + len(h), left - len(h)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(column: Column, words: int = 5) -> Column:
    """SimHash of a text column as a signed long: one bit per majority over the XXH64 of all word shingles."""

    @F.pandas_udf("long")
    def simhash(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))

    return simhash(F.coalesce(column, F.lit("")))


def gray_rank(x: Column) -> Column:
    """The rank of the bits in Gray order: each rank bit is the parity of the bits from it upwards."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, k))
    return x


def rotated(x: Column, k: int) -> Column:
    return x if not k else F.shiftleft(x, k).bitwiseOR(F.shiftrightunsigned(x, 64 - k))


def _shared(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each slice of x: the bits its members share, and the mask of where they share them."""
    ones, zeros = np.bitwise_and.reduceat(x, starts), np.bitwise_and.reduceat(~x, starts)
    return ones, ones | zeros


def _blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in Gray order, cut into blocks of one root (table, cell) and BLOCK rows at most. Lone rows inside are left out."""
    held: list[pd.DataFrame] = []

    def put(rows: pd.DataFrame, edge: bool) -> list[tuple]:
        out = []
        keys = rows[["t", "cell"]].to_numpy()
        cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True])
        x = rows["x"].to_numpy()
        for i, j in zip(cuts[:-1], cuts[1:]):
            if j - i > 1 or edge and (i == 0 or j == len(rows)):
                for k in range(i, j, BLOCK):
                    part = x[k : min(k + BLOCK, j)].view(np.uint64)
                    ones, mask = _shared(part, np.array([0]))
                    out.append((int(keys[i, 0]), int(keys[i, 1]), int(part[0].view(np.int64)), len(part), int(ones.view(np.int64)[0]), int(mask.view(np.int64)[0]), part.tobytes()))
        return out

    names = ["t", "cell", "head", "n", "bits", "mask", "xs"]
    first = True
    for rows in parts:
        if not len(rows):
            continue
        if held:
            rows = pd.concat([held.pop(), rows], ignore_index=True)
        last = rows.iloc[-1]
        tail = (rows["t"] == last["t"]) & (rows["cell"] == last["cell"])
        whole, rest = rows[~tail], rows[tail]
        while len(rest) > 2 * BLOCK:  # a root of any size passes through in bounded memory
            whole, rest = pd.concat([whole, rest.iloc[:BLOCK]]), rest.iloc[BLOCK:]
        held.append(rest)
        if len(whole):
            yield pd.DataFrame(put(whole, True), columns=names)
            first = False
    for rows in held:
        yield pd.DataFrame(put(rows, True), columns=names)


def _levels(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The index over x in Gray order: per level from the leaves up, (starts in the level below, bits, mask)."""
    out, starts = [], np.arange(len(x))
    full = np.full(len(x), np.uint64(0xFFFFFFFFFFFFFFFF))
    out.append((starts, x, full))
    while len(out[-1][0]) > 1:
        below = out[-1]
        groups = np.arange(0, len(below[0]), FANOUT)
        ones, zeros = np.bitwise_and.reduceat(below[1] & below[2], groups), np.bitwise_and.reduceat(~below[1] & below[2], groups)
        out.append((groups, ones, ones | zeros))
    return out


def close_pairs(a: np.ndarray, b: np.ndarray, bits: int = MAX_BITS, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all pairs of a and b, both in Gray order, that differ in ``bits`` bits at most.

    Both indexes are descended together. A pair of nodes carries the differences accumulated over the bits that both
    nodes factor out; below them only the newly shared bits are compared, and a pair over the bound falls as a whole.
    """
    la, lb = _levels(a), _levels(b)
    ka, kb = len(la) - 1, len(lb) - 1
    i = j = np.zeros(1, np.int64)
    seen = la[ka][2][i] & lb[kb][2][j]
    diff = np.bitwise_count((la[ka][1][i] ^ lb[kb][1][j]) & seen).astype(np.int64)

    def children(level: list, k: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = nodes * FANOUT
        count = np.minimum(FANOUT, len(level[k - 1][0]) - first)
        owner = np.repeat(np.arange(len(nodes)), count)
        return owner, np.repeat(first, count) + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)

    while True:
        keep = diff <= bits
        if same:
            keep &= (i <= j) if ka == kb and (ka or kb) else keep if ka != kb else (i < j)
        i, j, seen, diff = i[keep], j[keep], seen[keep], diff[keep]
        if not ka and not kb:
            return i, j
        if ka >= kb and ka:
            owner, i = children(la, ka, i)
            j, ka = j[owner], ka - 1
        else:
            owner, j = children(lb, kb, j)
            i, kb = i[owner], kb - 1
        seen, diff = seen[owner], diff[owner]
        now = la[ka][2][i] & lb[kb][2][j]
        diff = diff + np.bitwise_count((la[ka][1][i] ^ lb[kb][1][j]) & now & ~seen)
        seen = seen | now


def _forest(n: int, links: list[tuple[np.ndarray, np.ndarray]], report: bool, parent: list[int] | None = None) -> tuple[list[int], list[tuple[int, int]]]:
    """Joins n positions by the links; the links that joined two trees, if asked for. parent: where to start from."""
    parent, used = list(range(n)) if parent is None else parent, []

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    for left, right in links:
        for v, w in zip(left.tolist(), right.tolist()):
            p, q = root(v), root(w)
            if p != q:
                parent[max(p, q)] = min(p, q)
                if report:
                    used.append((v, w))
    return parent, used


def _found(t: int, both: np.ndarray, used: list[tuple[int, int]]) -> bytes:
    """Links as pairs of prints, turned back from rotation t."""
    p = np.array(used, np.int64).reshape(-1, 2)
    f = (both << np.uint64(64 - ROOT_BITS * t)) | (both >> np.uint64(ROOT_BITS * t)) if t else both
    return np.stack([f[p[:, 0]], f[p[:, 1]]], axis=1).tobytes()


def _within(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per block the links among its prints that join two of its groups, and the group of each print."""
    for rows in parts:
        found, labels = [], []
        for t, a in zip(rows["t"], rows["xs"]):
            x = np.frombuffer(a, np.uint64)
            parent, used = _forest(len(x), [close_pairs(x, x, same=True)], True)
            found.append(_found(t, x, used))
            labels.append(np.array(parent, np.int32).tobytes())
        yield rows.assign(found=found, labels=labels)


def _across(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of block pairs. Of many links between the same groups one is returned: a group of n prints gives about n rows
    instead of n * n."""
    for rows in parts:
        out = []
        for t, a, b, left, right in zip(rows["t"], rows["xs"], rows["ys"], rows["labels"], rows["labels_b"]):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            u, v = close_pairs(x, y)
            if len(u):
                parent = [*np.frombuffer(left, np.int32).tolist(), *(np.frombuffer(right, np.int32) + len(x)).tolist()]
                used = _forest(0, [(u, v + len(x))], True, parent)[1]
                if used:
                    out.append(_found(t, np.concatenate([x, y]), used))
        yield pd.DataFrame({"found": out})


def _pairs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in parts:
        yield pd.DataFrame(np.frombuffer(b"".join(rows["found"]), np.int64).reshape(-1, 2), columns=["a", "b"])


def links(prints: DataFrame, column: str = "fp") -> DataFrame:
    """(a, b): links of at most MAX_BITS bits that span the same groups as all such links, each between different prints.

    prints holds distinct fingerprints. Two of them that differ in MAX_BITS bits share the leading ROOT_BITS in one of
    MAX_BITS + 1 rotations, so the upper nodes of the index are these patterns and roots that differ never meet. Within
    a root, rows in Gray order form blocks of BLOCK prints at most, each searched once; of the block pairs of a root those
    over the bound fall by their shared bits, the others are searched with the groups found inside them at hand. A root of k
    blocks has up to k * k / 2 pairs, and each ships two blocks of 50 KB at most.
    """
    spark = prints.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = F.col("x")
    tables = F.array(*(F.struct(F.lit(t).alias("t"), rotated(F.col(column), ROOT_BITS * t).alias("x")) for t in range(MAX_BITS + 1)))
    rows = prints.select(F.explode(tables).alias("e")).select("e.t", "e.x").select("t", F.shiftrightunsigned(x, 64 - ROOT_BITS).alias("cell"), "x", gray_rank(x).alias("rank"))
    rows = rows.repartitionByRange(n, "t", "rank").sortWithinPartitions("t", "rank")
    blocks = cut(rows.mapInPandas(_blocks, "t int, cell long, head long, n int, bits long, mask long, xs binary"))
    inner = cut(blocks.repartition(n).mapInPandas(_within, "t int, cell long, head long, n int, bits long, mask long, xs binary, found binary, labels binary"))
    more = inner.groupBy("t", "cell").agg(F.count("*").alias("k")).where("k > 1").select("t", "cell")
    heads = inner.select("t", "cell", "head", "bits", "mask", "xs", "labels").join(more, ["t", "cell"], "left_semi")
    other = heads.select("t", "cell", *(F.col(c).alias(f"{c}_b") for c in ("head", "bits", "mask", "labels")), F.col("xs").alias("ys"))
    near = F.bit_count(F.col("bits").bitwiseXOR(F.col("bits_b")).bitwiseAND(F.col("mask")).bitwiseAND(F.col("mask_b"))) <= MAX_BITS
    pairs = heads.join(other, ["t", "cell"]).where((F.col("head") < F.col("head_b")) & near).select("t", "xs", "ys", "labels", "labels_b")
    found = pairs.repartition(n).mapInPandas(_across, "found binary")
    return inner.where(F.length("found") > 0).select("found").union(found).mapInPandas(_pairs, "a long, b long")


def simhash_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """One row per input row: id_col, fp (long), component_id (smallest id reachable by links, its own included).

    Texts without words have fingerprint 0 and link like any other; null texts count as empty. Rows that repeat a text
    share one fingerprint, so a group of copies of any size is one entry of the index. Null ids take part, but a group
    has a null component_id only if all its ids are null. An empty table gives no rows. Other columns are not read.
    """
    prints, groups = _grouped(df, id_col, text_col, words)
    return prints.join(groups, "fp").select(F.col("id").alias(id_col), "fp", F.col("rep.id").alias("component_id"))


def _grouped(df: DataFrame, id_col: str, text_col: str, words: int) -> tuple[DataFrame, DataFrame]:
    """(id, row_key, fp) of all rows and (fp, rep) of all fingerprints; rep (no_id, id, row_key) is the row that stands for the
    group: with the smallest id, null ids last, then with the smallest row_key."""
    bound_batches(df.sparkSession)
    rows = spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    prints = cut(rows.select("id", row_key("id", "text").alias("row_key"), fingerprints(F.col("text"), words).alias("fp")))
    classes = cut(prints.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row_key")).alias("rep")))
    found = cut(connected_components(links(classes.select("fp"))).select(F.col("node").alias("fp"), "component"))
    roots = classes.join(found, "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    lows = roots.groupBy("root").agg(F.min("rep").alias("rep"))
    # stored, so that the join deals out both sides anew and Spark can split a fingerprint that many rows share
    return prints, cut(roots.select("fp", "root").join(lows, "root").select("fp", "rep"))


def keep_representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """One row of each group, with all columns: that with the smallest id; null ids come last, and of rows that share the id
    one stays, whether their texts differ or not."""
    return keep_rows(df, _grouped(df, id_col, text_col, words)[1].select("rep.id", "rep.row_key"), id_col, text_col)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint of three-word shingles and its group; nulls, empty texts, repeated rows and a table without
    rows as simhash_dedup has them."""
    out = simhash_dedup(table(spark, sf_dir, "documents"), words=3)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

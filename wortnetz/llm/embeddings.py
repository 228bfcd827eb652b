"""Operator 2, embedding near-dedup: PCA-ordered tiled comparison with suffix-norm bounds."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import connected_components, cut, shared_path, spread, table
from .warc import file_system

THRESHOLD = 0.95
#: Vectors in a tile, and vectors of one length (those with the smallest hashes) that its rotation is fitted on.
TILE, FIT_ROWS = 1024, 4096
#: Leading components whose range in a tile is kept in the directory, tiles of the directory that a task reads at a time,
#: vectors whose groups and counts a task remembers, rotations that it holds, and axes of one.
BOX, DIRECTORY_ROWS, REMEMBERED, HELD_AXES, MOST_AXES = 16, 1 << 16, 1 << 20, 4, 512
#: Leading components by whose signs vectors are brought into tiles; a hundred or so vectors need one bit more each doubling.
CELL_BITS = 10
#: Comparing tasks at most, as a multiple of the session's partitions.
TASKS = 64
#: Dimensions accumulated before each bound is tested, as shares of all.
STEPS = (0.25, 0.5, 1.0)
#: Rounding errors of bounds in double precision are far below this; bounds give way by it, results never do.
SLACK = 1e-7


def usable(column: str = "embedding"):
    """Neither null, empty nor zero, and without null, NaN or infinite components."""
    x = F.transform(column, lambda v: v.cast("double"))
    ok = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(F.col(column).isNotNull() & (F.size(column) > 0) & ok & F.exists(x, lambda v: v != 0), F.lit(False))


def _vectors(column) -> np.ndarray:
    """Rows of one length, each scaled by a power of two, which changes no cosine, so that squares neither overflow nor vanish."""
    x = np.stack([np.asarray(v, np.float64) for v in column])
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def principal_axes(x: np.ndarray) -> np.ndarray:
    """Principal axes of the unit vectors, the strongest first, as columns: all directions, or MOST_AXES of longer vectors, or as
    many as fewer vectors have. What lies outside them counts in the suffix norms."""
    x = _unit(x)
    n, d = x.shape
    if n >= d:
        return np.ascontiguousarray(np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :MOST_AXES])
    size, u = np.linalg.eigh(x[:MOST_AXES] @ x[:MOST_AXES].T)
    some = size > 1e-8 * size[-1]
    return np.ascontiguousarray(np.linalg.qr((x[:MOST_AXES].T @ u[:, some])[:, ::-1])[0])


def rotations(rows: DataFrame, folder: str) -> dict[int, str]:
    """The file of each length's rotation in the shared folder. Every length that occurs has one, fitted in a task on FIT_ROWS of its
    vectors at most, drawn by hash; any sample gives exact results. There are no more rows of lengths, which are broadcast and whose files
    the driver learns, than the longest vector has components."""
    sized = rows.select("v", F.size("v").alias("d"))
    counts = sized.groupBy("d").agg(F.count("*").alias("n"))
    drawn = sized.join(F.broadcast(counts), "d").where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < F.lit(FIT_ROWS << 30) / F.col("n"))
    sample = drawn.withColumn("k", F.row_number().over(Window.partitionBy("d").orderBy(F.xxhash64("v"), "v"))).where(F.col("k") <= FIT_ROWS)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        store, top = file_system(folder)
        store.create_dir(top, recursive=True)
        name, buffer = f"axes-{uuid.uuid4().hex}.npy", io.BytesIO()
        np.save(buffer, principal_axes(_vectors(part["v"])))
        with store.open_output_stream(f"{top}/{name}", compression=None) as f:
            f.write(buffer.getvalue())
        return pd.DataFrame({"d": [int(part["d"].iloc[0])], "name": [name]})

    return {r["d"]: r["name"] for r in sample.select("v", "d").groupBy("d").applyInPandas(fit, "d int, name string").collect()}


class Axes:
    """Rotations by length, read from the shared folder when they are asked for; a task holds a few of them."""

    def __init__(self, folder: str, names: dict[int, str]) -> None:
        self.folder, self.names, self.held = folder, names, {}

    def __getitem__(self, d: int) -> np.ndarray:
        if d not in self.held:
            while len(self.held) >= HELD_AXES:
                self.held.pop(next(iter(self.held)))
            store, top = file_system(self.folder)
            with store.open_input_file(f"{top}/{self.names[d]}") as f:
                self.held[d] = np.load(io.BytesIO(f.read()))
        return self.held[d]


def _by_length(rows: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
    """Runs of rows of one length, in the order in which they come."""
    sizes = rows["d"].to_numpy()
    cuts = np.flatnonzero(np.r_[True, sizes[1:] != sizes[:-1], True]) if len(sizes) else []
    for i, j in zip(cuts[:-1], cuts[1:]):
        yield int(sizes[i]), rows.iloc[i:j]


def _cells(axes: Axes):
    def cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The place of each vector: signs of its leading components in Gray order, then the first component."""
        for part in parts:
            for d, rows in _by_length(part.sort_values("d", kind="stable")):
                z = _unit(_vectors(rows["v"])) @ axes[d][:, :CELL_BITS]
                bits = np.cumsum(z < 0, axis=1) % 2
                yield rows.assign(cell=bits @ (1 << np.arange(bits.shape[1])[::-1]), lead=z[:, 0])

    return cells


def _tiles(axes: Axes, folder: str):
    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Tiles of one partition, each of one length and a file of its own in the shared folder: ids, weights and vectors.
        Names are new in each attempt, and only those that a finished attempt returns are read."""
        store, top = file_system(folder)
        store.create_dir(top, recursive=True)

        def put(d: int, rows: pd.DataFrame) -> tuple:
            x = _vectors(rows["v"])
            z = _unit(x) @ axes[d][:, :BOX]
            number = uuid.uuid4()
            buffer = io.BytesIO()
            np.savez(buffer, cid=rows["cid"].to_numpy(np.int64), n=rows["n"].to_numpy(np.int64), x=x)
            with store.open_output_stream(f"{top}/tile-{number.hex}.npz", compression=None) as f:
                f.write(buffer.getvalue())
            return f"tile-{number.hex}.npz", number.int >> 65, d, z.min(axis=0).tobytes(), z.max(axis=0).tobytes()

        held: list[pd.DataFrame] = []
        length, size = None, 0

        def flush(all_: bool) -> Iterator[pd.DataFrame]:
            nonlocal held, size
            rows = pd.concat(held, ignore_index=True)
            end = size if all_ else size - size % TILE
            done = [put(length, rows.iloc[k : min(k + TILE, end)]) for k in range(0, end, TILE)]
            held, size = ([rows.iloc[end:]] if end < size else []), size - end
            yield pd.DataFrame(done, columns=["name", "number", "d", "low", "high"])

        for part in parts:
            for d, rows in _by_length(part):
                if size and d != length:
                    yield from flush(True)
                length, size = d, size + len(rows)
                held.append(rows)
                if size >= TILE:
                    yield from flush(False)
        if size:
            yield from flush(True)

    return write


def near_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) with cosine >= threshold, in double precision.

    Leading dimensions are accumulated first; what the rest can add is at most the product of the suffix norms, so a
    pair stops as soon as even that cannot reach the threshold. Pairs that get through are decided by their full cosine.
    """
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    za, zb = a / na[:, None] @ axes, b / nb[:, None] @ axes
    ends = sorted({max(1, round(s * axes.shape[1])) for s in STEPS})
    rest = lambda z, k: np.sqrt(np.maximum(0.0, 1 - np.square(z[:, :k]).sum(axis=1)))
    first = ends[0]
    dots = za[:, :first] @ zb[:, :first].T
    i, j = np.nonzero(dots + np.outer(rest(za, first), rest(zb, first)) >= threshold - SLACK)
    dots = dots[i, j]
    for k, end in zip(ends, ends[1:]):
        if not len(i):
            break
        ra, rb = rest(za, end), rest(zb, end)
        keep = []
        for s in range(0, len(i), 1 << 16):
            part = slice(s, s + (1 << 16))
            dots[part] += np.einsum("pd,pd->p", za[i[part], k:end], zb[j[part], k:end])
            keep.append(dots[part] + ra[i[part]] * rb[j[part]] >= threshold - SLACK)
        alive = np.concatenate(keep)
        i, j, dots = i[alive], j[alive], dots[alive]
    sure = [np.einsum("pd,pd->p", a[i[s : s + 65536]], b[j[s : s + 65536]]) / (na[i[s : s + 65536]] * nb[j[s : s + 65536]]) >= threshold for s in range(0, len(i), 65536)]
    alive = np.concatenate(sure) if sure else np.zeros(0, bool)
    return i[alive], j[alive]


def _owned(mine: int, others: np.ndarray) -> np.ndarray:
    """Of a pair of tiles one compares them: the smaller number if the sum is even. Each has about half of its pairs."""
    return ((mine + others) % 2 == 0) == (mine < others)


class Links:
    """What a task has found: how many links each vector has, and of all links one per merge of two groups.

    Counts of all its pairs of tiles are summed before they are handed on, so a group of any density gives a task one row per
    vector that it met. Beyond REMEMBERED vectors they are handed on and forgotten; then some links within a group are returned again.
    """

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.counts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0
        self.forest: list[tuple[int, int]] = []

    def root(self, v: int) -> int:
        while (p := self.parent.setdefault(v, v)) != v:
            self.parent[v] = v = self.parent.setdefault(p, p)
        return v

    def _roots(self, v: np.ndarray) -> np.ndarray:
        keys, inverse = np.unique(v, return_inverse=True)
        return np.array([self.root(k) for k in keys.tolist()], np.int64)[inverse]

    def add(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> None:
        """Links (a, b) between vectors that so many rows have."""
        keys, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
        self.counts.append((keys, np.bincount(inverse, np.concatenate([n_b, n_a])).astype(np.int64)))
        self.size += len(keys)
        while len(a):  # each round joins every group to another, so there are few
            ra, rb = self._roots(a), self._roots(b)
            apart = ra != rb
            a, b, ra = a[apart], b[apart], ra[apart]
            for k in np.unique(ra, return_index=True)[1].tolist():
                v, w = int(a[k]), int(b[k])
                p, q = self.root(v), self.root(w)
                if p != q:
                    self.parent[max(p, q)] = min(p, q)
                    self.forest.append((v, w))

    def handed(self, last: bool) -> Iterator[pd.DataFrame]:
        if self.size > REMEMBERED or last:
            if self.counts:
                keys, inverse = np.unique(np.concatenate([k for k, _ in self.counts]), return_inverse=True)
                self.counts = [(keys, np.bincount(inverse, np.concatenate([n for _, n in self.counts])).astype(np.int64))]
                self.size = len(keys)
            if self.size > REMEMBERED // 2 or last:
                for keys, n in self.counts:
                    yield pd.DataFrame({"a": keys, "b": pd.array([None] * len(keys), "Int64"), "links": n})
                self.counts, self.size = [], 0
        if self.forest and (len(self.forest) > REMEMBERED or last):
            a, b = zip(*self.forest)
            yield pd.DataFrame({"a": a, "b": pd.array(b, "Int64"), "links": 0})
            self.forest = []
        if len(self.parent) > REMEMBERED:
            self.parent.clear()


def _compare(axes: Axes, folder: str, directory: str, threshold: float):
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rows' tiles against themselves and about half of all other tiles, so that every pair of tiles meets once.

        The directory is read once for all tiles of an Arrow batch, in ranges; tiles of another length, or whose boxes are too far apart,
        are not read."""
        import pyarrow.parquet as pq

        store, top = file_system(folder)
        links = Links()

        def load(name: str) -> dict[str, np.ndarray]:
            with store.open_input_file(f"{top}/{name}") as f:
                return dict(np.load(io.BytesIO(f.read())))

        def listed() -> Iterator[tuple]:
            at, path = file_system(directory)
            for info in at.get_file_info(fs_selector(path)):
                if info.path.endswith(".parquet"):
                    with pq.ParquetFile(at.open_input_file(info.path)) as f:
                        for batch in f.iter_batches(DIRECTORY_ROWS):
                            tiles = batch.to_pandas().sort_values("d", kind="stable")
                            for d, rows in _by_length(tiles):
                                yield d, rows["name"].to_numpy(), rows["number"].to_numpy(), *(np.frombuffer(b"".join(rows[c])).reshape(len(rows), -1) for c in ("low", "high"))

        for part in parts:
            mine = [(name, number, d, np.frombuffer(low), np.frombuffer(high)) for name, number, d, low, high in part.itertuples(index=False)]
            for name, _, d, _, _ in mine:
                x = load(name)
                i, j = near_pairs(x["x"], x["x"], axes[d], threshold)
                i, j = i[i < j], j[i < j]
                links.add(x["cid"][i], x["cid"][j], x["n"][i], x["n"][j])
                yield from links.handed(False)
            for length, names, numbers, lows, highs in listed():
                for name, number, d, low, high in mine:
                    if d != length:
                        continue
                    gap = np.maximum(0.0, np.maximum(lows - high, low - highs))
                    near = names[(numbers != number) & _owned(number, numbers) & (np.square(gap).sum(axis=1) <= reach * reach)]
                    x = load(name) if len(near) else None
                    for other in map(load, near):
                        i, j = near_pairs(x["x"], other["x"], axes[d], threshold)
                        if len(i):
                            links.add(x["cid"][i], other["cid"][j], x["n"][i], other["n"][j])
                            yield from links.handed(False)
        yield from links.handed(True)

    return compare


def fs_selector(path: str):
    from pyarrow import fs

    return fs.FileSelector(path)


def embedding_dedup(df: DataFrame, id_col: str = "vec_id", column: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id_col, n_links (other rows with cosine >= threshold), component_id (smallest id reachable
    by links, its own included) and kept (id = component_id).

    Vectors that are null, empty or zero, or hold null, NaN or infinite components, link with nothing. Vectors of different
    lengths do not link, since no cosine is defined; those of each length are compared with one another. Equal vectors are
    one entry with a weight, so a vector that a third of the rows share is compared once; each row counts its copies as
    links. Rows with null ids take part; component_id is null only where all ids of a group are. Every tile meets every other
    of its length unless their bounding boxes are further apart than the threshold allows; a task holds two tiles. An empty
    table gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(column).alias("v"))
    good = usable("v")
    alone = rows.where(~good).select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    classes = cut(rows.where(good).groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n"))).withColumn("cid", F.monotonically_increasing_id())
    folder, directory = shared_path(spark, "tiles"), shared_path(spark, "tile-directory")
    axes = Axes(folder, rotations(classes, folder))
    placed = cut(spread(classes.select("cid", "n", "v", F.size("v").alias("d"))).mapInPandas(_cells(axes), "cid long, n long, v array<double>, d int, cell long, lead double"))
    n_tiles = max(1, -(-placed.count() // TILE))
    ordered = placed.repartitionByRange(max(1, min(n_parts, n_tiles)), "d", "cell", "lead").sortWithinPartitions("d", "cell", "lead")
    tiles = cut(ordered.select("cid", "n", "v", "d").mapInPandas(_tiles(axes, folder), "name string, number long, d int, low binary, high binary"))
    tiles.write.parquet(directory)
    n_tasks = max(n_parts, min(tiles.count(), TASKS * n_parts))
    compared = cut(tiles.repartition(n_tasks).mapInPandas(_compare(axes, folder, directory, threshold), "a long, b long, links long"))
    links = compared.where("b IS NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    groups = connected_components(compared.where("b IS NOT NULL")).select(F.col("node").alias("cid"), "component")
    named = classes.select("cid", "rep", "n").join(groups, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    lows = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    per_class = cut(named.join(lows, "component").join(links, "cid", "left").select("cid", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    # stored, so that the join deals out both sides anew and Spark can split a vector that many rows share
    keyed = cut(classes.select("cid", "v").join(per_class, "cid").select("v", "component_id", "n_links"))
    linked = rows.where(good).join(keyed, "v").select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
    return linked.unionByName(alone)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, whatever their labels, at a cosine of 0.95; odd vectors, ties and empty tables as embedding_dedup has them."""
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, least(x, min(y)) AS component_id FROM r GROUP BY x),
k AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(k.n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN c ON c.x = vec_id LEFT JOIN k ON k.x = vec_id
"""

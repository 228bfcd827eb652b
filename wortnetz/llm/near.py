"""Near-duplicate groups by SimHash order, exact bounds and verified shingle similarity, for the pipeline and general use.

Operator 4 links fingerprints at two differing bits. Texts whose five-word shingles have a Jaccard similarity of 0.8
differ in about ten bits of 64, and some in many more, so no number of bits finds them all. So the operator's Gray-order index
is descended first, over SimHashes of the distinct shingles: it finds the closest texts. An exact way follows for the rest,
for which the prints only put the texts in order. Which pairs it looks at is decided by the sizes of the two sets and by the
parities of their shingles in each of many bins: sets that differ in d shingles differ in d parities at most, so no pair of
the similarity asked for is lost. All links are verified on the texts themselves.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, connected_components, cut, keep_rows, row_key, shared_path, spread, text_of
from .simhash import CHUNK, SEED, gray_rank
from .simhash import links as index_links
from .warc import file_system

#: Fixed by contract: words in a shingle, and the least Jaccard similarity of two texts that link.
WORDS, SIMILARITY = 5, 0.8
#: Bins of the sketch, by which links are ordered.
BINS = 128
#: Least number of parities; there are at least twice as many as shingles.
PARITIES = 256
#: Texts in a tile, and how many of them meet another tile at a time.
TILE, ROWS = 1024, 32


def shingle_hashes(text: str, words: int = WORDS) -> Iterator[np.ndarray]:
    """XXH64 of all word shingles, chunk by chunk; the whole sequence if there are fewer words; nothing without words."""
    w = text.encode().lower().split()
    if not w:
        return
    shingles = map(b" ".join, zip(*(islice(w, i, None) for i in range(words)))) if len(w) > words else iter([b" ".join(w)])
    hashes, left = map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), max(1, len(w) - words + 1)
    while left:
        part = np.fromiter(islice(hashes, CHUNK), np.uint64)
        left -= len(part)
        yield part


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Distinct shingle hashes, sorted."""
    parts = [np.unique(p) for p in shingle_hashes(text, words)]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Per bin of the hashes' leading bits, a byte of the least hash in it; 0 for an empty bin."""
    out = np.zeros(BINS, np.uint8)
    if len(shingles):
        bins, first = np.unique(shingles >> np.uint64(64 - BINS.bit_length() + 1), return_index=True)
        out[bins.astype(np.int64)] = (shingles[first] & np.uint64(0xFFFF)) % np.uint64(255) + np.uint64(1)
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of pairs of sketches, row by row."""
    same = ((a == b) & (a > 0)).sum(axis=1)
    some = ((a > 0) | (b > 0)).sum(axis=1)
    return same / np.maximum(some, 1)


def parities(shingles: np.ndarray) -> np.ndarray:
    """Per bin of the hashes' trailing bits, whether an odd number of shingles fall into it; packed."""
    n = max(PARITIES, 1 << (2 * len(shingles) - 1).bit_length()) if len(shingles) else PARITIES
    return np.packbits((np.bincount((shingles & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1).astype(np.uint8), bitorder="little")


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """The parities in fewer bins: rows of ``width`` words of 64."""
    while (half := bits.shape[-1] // 2) >= width:
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def prints(texts: pd.Series, words: int = WORDS) -> pd.DataFrame:
    """Per text: a hash of its shingle set, the SimHash of the distinct shingles, the size of the set, sketch and parities."""
    out = []
    for t in texts:
        s, counts = shingle_set(t, words), np.zeros(64, np.int64)
        for k in range(0, len(s), CHUNK):
            counts += np.unpackbits(s[k : k + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        fp = np.packbits(counts * 2 > len(s), bitorder="little").view("<i8")[0]
        out.append((np.uint64(xxhash.xxh64_intdigest(s.tobytes())).astype(np.int64), fp, len(s), sketch(s).tobytes(), parities(s).tobytes()))
    return pd.DataFrame(out, columns=["set_hash", "fp", "size", "sketch", "parity"])


def _tiles(folder: str):
    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Tiles of one partition, by size, in the shared folder, under names that are new in each attempt."""
        store, top = file_system(folder)
        store.create_dir(top, recursive=True)
        held: list[pd.DataFrame] = []
        size, done = 0, []

        def put(rows: pd.DataFrame) -> None:
            rows = rows.sort_values("size", kind="stable")
            name, buffer = f"tile-{uuid.uuid4().hex}.npz", io.BytesIO()
            np.savez(
                buffer, key=rows["set_hash"].to_numpy(np.int64), size=rows["size"].to_numpy(np.int64), sketch=np.stack([np.frombuffer(s, np.uint8) for s in rows["sketch"]]),
                parity=np.frombuffer(b"".join(rows["parity"]), np.uint64), width=np.array([len(s) // 8 for s in rows["parity"]]),
            )
            with store.open_output_stream(f"{top}/{name}", compression=None) as f:
                f.write(buffer.getvalue())
            done.append((name, int(rows["set_hash"].min()), int(rows["size"].min()), int(rows["size"].max())))

        for part in parts:
            held.append(part)
            size += len(part)
            if size >= TILE:
                rows = pd.concat(held, ignore_index=True)
                for k in range(0, size - TILE + 1, TILE):
                    put(rows.iloc[k : k + TILE])
                held = [rows.iloc[size - size % TILE :]]
                size %= TILE
        if size:
            put(pd.concat(held, ignore_index=True))
        yield pd.DataFrame(done, columns=["name", "least", "low", "high"])

    return write


def _at_width(tile, width: int, which: np.ndarray) -> np.ndarray:
    """The parities of some rows of a tile, folded to ``width`` words."""
    ends = np.cumsum(tile["width"])
    out = np.empty((len(which), width), np.uint64)
    for w in np.unique(tile["width"][which]):
        at = np.flatnonzero(tile["width"][which] == w)
        out[at] = folded(tile["parity"][(ends[which[at]] - w)[:, None] + np.arange(w)], width)
    return out


def tile_links(a, b, similarity: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, estimate) of the pairs of two tiles that sizes and parities do not rule out: all pairs as similar as asked for
    and a few more. Few parities rule out most pairs, and all that both texts have are compared of those that are left."""
    share = (1 - similarity) / (1 + similarity)  # of both sizes, that the symmetric difference may have
    x, y = a["size"], b["size"]
    found, cache = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], {}
    for k in range(0, len(x), ROWS):
        rows = np.arange(k, min(k + ROWS, len(x)))
        first = np.searchsorted(y, int(similarity * x[rows[0]]), "left")
        last = np.searchsorted(y, int(x[rows[-1]] / similarity) + 1, "right")
        first = max(first, k) if same else first
        if first >= last:
            continue
        least = min(a["width"][rows].min(), b["width"][first:last].min())
        width = min(int(least), max(1, (1 << (max(1, int(y[last - 1]) * 2 // 3) - 1).bit_length()) // 64))
        if width not in cache:
            fit = np.flatnonzero(b["width"] >= width)
            cache[width] = fit[0], np.ascontiguousarray(_at_width(b, width, fit).T)
        start, columns = cache[width]
        mine = _at_width(a, width, rows)
        diff = np.zeros((len(rows), last - first), np.uint32)
        for w in range(width):
            diff += np.bitwise_count(mine[:, w, None] ^ columns[w, first - start : last - start])
        m, n = x[rows][:, None], y[first:last]
        near = (diff <= (m + n) * share + 1e-9) & (np.minimum(m, n) >= similarity * np.maximum(m, n) - 1e-9)
        if same:
            near &= rows[:, None] < np.arange(first, last)
        i, j = np.nonzero(near)
        found.append((i + k, j + first))
    i, j = (np.concatenate([f[k] for f in found]) for k in range(2))
    keep = np.zeros(len(i), bool)
    both = np.minimum(a["width"][i], b["width"][j])
    for w in np.unique(both):
        at = np.flatnonzero(both == w)
        (u, p), (v, q) = np.unique(i[at], return_inverse=True), np.unique(j[at], return_inverse=True)
        mine, other = _at_width(a, w, u), _at_width(b, w, v)
        step = max(1, (1 << 20) // int(w))
        for s in range(0, len(at), step):
            t = at[s : s + step]
            diff = np.bitwise_count(mine[p[s : s + step]] ^ other[q[s : s + step]]).sum(axis=1, dtype=np.int64)
            keep[t] = diff <= (x[i[t]] + y[j[t]]) * share + 1e-9
    i, j = i[keep], j[keep]
    parts = [estimate(a["sketch"][i[s : s + 65536]], b["sketch"][j[s : s + 65536]]) for s in range(0, len(i), 65536)]
    return i, j, np.concatenate(parts) if parts else np.zeros(0)


def _load(store, top: str, name: str) -> dict[str, np.ndarray]:
    with store.open_input_file(f"{top}/{name}") as f:
        z = np.load(io.BytesIO(f.read()))
        return {k: z[k] for k in ("key", "size", "sketch", "parity", "width")}


def _compare(folder: str, directory: str, similarity: float):
    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each row's tile against itself and the half of all tiles that follow it on a circle, but for tiles whose
        sizes rule out every pair. Of all links, those of a maximum spanning forest of the estimates are returned (a, b, e),
        and the pairs of tiles of which links were left out (name, other): these are looked at again once the forest's
        links are verified."""
        import pyarrow.parquet as pq

        store, top = file_system(folder)

        tiles = None
        for part in parts:
            if not len(part):
                continue
            if tiles is None:
                at = file_system(directory)
                tiles = pq.read_table(at[1], filesystem=at[0]).to_pandas().sort_values(["least", "name"], ignore_index=True)
                place, whole = {n: k for k, n in enumerate(tiles["name"])}, len(tiles)
                low, high = tiles["low"].to_numpy(), tiles["high"].to_numpy()
            for name in part["name"]:
                t = place[name]
                mine = _load(store, top, name)
                steps = whole // 2
                others = np.array([(t + s) % whole for s in range(1, steps + 1) if not (whole % 2 == 0 and s == steps and t >= steps)], np.int64)
                fits = np.minimum(high[t], high[others]) >= similarity * np.maximum(low[t], low[others]) - 1e-9
                found, seen = [], np.zeros(whole, np.int64)
                for o in (t, *others[fits]):
                    other = mine if o == t else _load(store, top, tiles["name"][o])
                    i, j, e = tile_links(mine, other, similarity, o == t)
                    if len(i) or o == t:
                        found.append((mine["key"][i], other["key"][j], e, np.full(len(i), o)))
                        seen[o] = len(i)
                        if sum(len(f[0]) for f in found) > 1 << 20:
                            found = [_forest(found)]
                a, b, e, o = _forest(found)
                yield pd.DataFrame({"a": a, "b": b, "e": e, "name": None, "other": None})
                more = np.flatnonzero(seen > np.bincount(o, minlength=whole))
                yield pd.DataFrame({"a": pd.array([None] * len(more), "Int64"), "b": pd.array([None] * len(more), "Int64"), "e": np.nan, "name": name, "other": tiles["name"].to_numpy()[more]})

    return compare


def _apart(folder: str, similarity: float):
    def apart(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """All links of pairs of tiles whose ends are in different groups; nodes and groups: of the texts that have one."""
        store, top = file_system(folder)

        def grouped(keys: np.ndarray, nodes, groups) -> np.ndarray:
            of = {} if nodes is None else dict(zip(nodes, groups))
            return np.array([of.get(k, k) for k in keys.tolist()], np.int64)

        for part in parts:
            for name, other, nodes, groups, nodes_2, groups_2 in part.itertuples(index=False):
                x = _load(store, top, name)
                y = x if other == name else _load(store, top, other)
                i, j, _ = tile_links(x, y, similarity, other == name)
                left = grouped(x["key"], nodes, groups)[i] != grouped(y["key"], nodes_2, groups_2)[j]
                yield pd.DataFrame({"a": x["key"][i[left]], "b": y["key"][j[left]]})

    return apart


def _forest(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Of links (a, b, e, o) those of a spanning forest, greatest e first."""
    a, b, e, o = (np.concatenate([f[k] for f in found]) for k in range(4))
    order = np.argsort(-e, kind="stable")
    parent: dict[int, int] = {}
    kept = []

    def root(v: int) -> int:
        while (p := parent.setdefault(v, v)) != v:
            parent[v] = v = parent.setdefault(p, p)
        return v

    for k, v, w in zip(order.tolist(), a[order].tolist(), b[order].tolist()):
        p, q = root(v), root(w)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append(k)
    return a[kept], b[kept], e[kept], o[kept]


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: id_col, component_id: the smallest id that verified links reach, its own included.

    Two texts link if their sets of word shingles (A-Z lower-cased, white space as in operator 4) have a Jaccard similarity
    of ``similarity`` or more. Texts with equal sets are one entry;
    texts without words link with each other alone. Null texts count as empty; null ids take part, and component_id is
    null only where all ids of a group are. An empty table gives no rows. Whole texts count; other columns are not read.
    """
    per, groups = _grouped(df, id_col, text_col, words, similarity)
    return per.join(groups, "set_hash").select(F.col("id").alias(id_col), F.col("rep.id").alias("component_id"))


def _grouped(df: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(id, set_hash) of all rows and (set_hash, rep) of all shingle sets; rep (no_id, id, row_key) is the row that stands for
    the group: with the smallest id, null ids last, then with the smallest row_key."""
    spark = df.sparkSession
    bound_batches(spark, 512)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    @F.pandas_udf("set_hash long, fp long, size long, sketch binary, parity binary")
    def printed(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield prints(texts, words)

    rows = spread(df.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")))
    per = cut(rows.select("id", row_key("id", "text").alias("row_key"), printed("text").alias("p")).select("id", "row_key", "p.*"))
    rep = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row_key"))
    classes = cut(per.groupBy("set_hash", "fp", "size", "sketch").agg(rep.alias("rep"), F.min("row_key").alias("row_key"), F.first("parity").alias("parity")).groupBy("set_hash").agg(F.min(F.struct("fp", "size", "sketch", "row_key", "parity")).alias("p"), F.min("rep").alias("rep")).select("set_hash", "rep", "p.*"))
    entries = classes.where("size > 0").select("set_hash", "fp", "size", "sketch", "parity")
    folder, directory = shared_path(spark, "tiles"), shared_path(spark, "tile-directory")
    band = F.floor(F.log("size") / F.log(F.lit(1.25)))
    n_tiles = max(1, -(-entries.count() // TILE))
    ordered = entries.withColumns({"band": band, "rank": gray_rank(F.col("fp"))}).repartitionByRange(max(1, min(n_parts, n_tiles)), "band", "rank").sortWithinPartitions("band", "rank")
    tiles = cut(ordered.select("set_hash", "size", "sketch", "parity").mapInPandas(_tiles(folder), "name string, least long, low long, high long"))
    tiles.write.parquet(directory)
    compared = cut(tiles.select("name").repartition(max(n_parts, n_tiles), "name").mapInPandas(_compare(folder, directory, similarity), "a long, b long, e double, name string, other string"))
    tried = cut(compared.where("a IS NOT NULL").select("a", "b").union(indexed(entries.select("set_hash", "fp"))))
    links = cut(verified(rows, tried, classes, words, similarity))
    groups = cut(connected_components(links).select(F.col("node").alias("set_hash"), "component"))
    left = cut(untried(folder, tiles, compared.where("name IS NOT NULL").select("name", "other"), groups, tried, similarity))
    if not left.isEmpty():
        links = links.union(verified(rows, left, classes, words, similarity))
        groups = cut(connected_components(links).select(F.col("node").alias("set_hash"), "component"))
    named = classes.select("set_hash", "rep").join(groups, "set_hash", "left").withColumn("component", F.coalesce("component", "set_hash"))
    lowest = cut(named.groupBy("component").agg(F.min("rep").alias("rep")))
    return per, cut(named.select("set_hash", "component").join(lowest, "component").select("set_hash", "rep"))


def indexed(entries: DataFrame) -> DataFrame:
    """(a, b): shingle sets whose prints are equal or that operator 4's index links, as links between different sets."""
    prints = cut(entries.groupBy("fp").agg(F.min("set_hash").alias("first")))
    end = lambda c: prints.select(F.col("fp").alias(f"fp_{c}"), F.col("first").alias(c))
    found = index_links(prints.select("fp")).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b"))
    equal = entries.join(prints, "fp").where("set_hash <> first").select(F.col("first").alias("a"), F.col("set_hash").alias("b"))
    return found.join(end("a"), "fp_a").join(end("b"), "fp_b").select("a", "b").union(equal)


def untried(folder: str, tiles: DataFrame, pairs: DataFrame, groups: DataFrame, tried: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the links of pairs of tiles that verified links have not made superfluous and that have not been tried."""

    def keys(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = file_system(folder)
        for part in parts:
            for name in part["name"]:
                yield pd.DataFrame({"name": name, "set_hash": _load(store, top, name)["key"]})

    n_parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = spread(tiles.select("name")).mapInPandas(keys, "name string, set_hash long").join(groups, "set_hash")
    lists = cut(placed.groupBy("name").agg(F.collect_list(F.struct("set_hash", "component")).alias("g")).select("name", F.col("g.set_hash").alias("nodes"), F.col("g.component").alias("groups")))
    second = lists.toDF("other", "nodes_2", "groups_2")
    both = pairs.join(lists, "name", "left").join(second, "other", "left").select("name", "other", "nodes", "groups", "nodes_2", "groups_2")
    return both.repartition(n_parts).mapInPandas(_apart(folder, similarity), "a long, b long").join(tried, ["a", "b"], "left_anti")


def verified(rows: DataFrame, links: DataFrame, classes: DataFrame, words: int, similarity: float) -> DataFrame:
    """The links (a, b) whose texts are as similar as asked for. Only texts that stand in a link travel twice."""
    pairs = links.select("a", "b").distinct().withColumn("link", F.xxhash64("a", "b"))
    ends = pairs.select("link", "a", "b", F.explode(F.array("a", "b")).alias("set_hash")).join(classes.select("set_hash", "row_key"), "set_hash")
    texts = rows.withColumn("row_key", row_key("id", "text")).select("row_key", "text")
    needed = cut(ends.select("link", "a", "b", "row_key"))
    # stored, so that the join deals out both sides anew and Spark can split a text that many links share
    one = cut(texts.join(needed.select("row_key").distinct(), "row_key", "left_semi").dropDuplicates(["row_key"]))
    both = needed.join(one, "row_key").groupBy("link", "a", "b").agg(F.collect_list("text").alias("texts")).where(F.size("texts") == 2)

    @F.pandas_udf("boolean")
    def alike(pairs_: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts_ in pairs_:
            yield pd.Series([jaccard(shingle_set(t[0], words), shingle_set(t[1], words)) >= similarity for t in texts_], dtype=bool)

    return both.where(alike("texts")).select("a", "b")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group, with all columns: that with the smallest id; null ids come last, and of rows that share the id
    one stays, whether their texts differ or not."""
    return keep_rows(df, _grouped(df, id_col, text_col, words, similarity)[1].select("rep.id", "rep.row_key"), id_col, text_col)

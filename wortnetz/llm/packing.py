"""Operator 9, best-fit packing: a grouping genetic algorithm on islands with elite migration."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, cut, spread, table, text_of

CAPACITY, END_ID = 2048, 0
#: Pieces in one instance of the packing problem, about; a sequence holds pieces of one instance.
INSTANCE = 16384
#: Islands per instance, individuals per island, generations between two migrations, and migrations.
ISLANDS, POPULATION, GENERATIONS, MIGRATIONS = 3, 4, 8, 2
#: Bins filled to this share or more may be injected into another individual and stay in it, but for this share of them.
WELL_FILLED, SHAKEN = 0.999, 0.1

#: Texts of these characters only are cut alike by both libraries' patterns, whatever their Unicode versions.
PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ]")


class Tokens:
    """Ids as the tokenizers library gives them for a byte-level BPE file. Plain texts go through tiktoken, which has
    the same vocabulary and is faster; all others, and texts that spell a special token, through tokenizers itself."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.slow = Tokenizer.from_file(json_path)
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]

    def __call__(self, text: str) -> np.ndarray:
        if PLAIN.search(text) or any(t in text for t in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


_LOADED: dict[tuple, Tokens] = {}


def tokens(*paths: str) -> Tokens:
    """One instance per Python worker."""
    if paths not in _LOADED:
        _LOADED[paths] = Tokens(*paths)
    return _LOADED[paths]


def pieces(df: DataFrame, paths: tuple[str, str, str], id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32): each text's ids and the end id, cut where longer than the capacity.

    All pieces of a cut text have the capacity's length, but for the first, which takes what is left over.
    """

    def cut_up(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokens(*paths)
        for rows in parts:
            out = []
            for i, no_id, text in zip(rows["id"], rows["no_id"], rows["text"]):
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                for k, start in enumerate([0, *range(first, len(ids), capacity)]):
                    end = first if not k else start + capacity
                    out.append((None if no_id else i, k, start, end - start, zlib.crc32(ids[start:end].tobytes())))
            yield pd.DataFrame(out, columns=[id_col, "piece", "start", "length", "ids_crc32"]).astype({id_col: "Int64"})

    slim = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.col(id_col).isNull().alias("no_id"), text_of(text_col).alias("text"))
    return spread(slim).mapInPandas(cut_up, f"`{id_col}` long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Open bins by the room left in them; best fit is the least room that is enough."""

    def __init__(self, capacity: int, room: np.ndarray):
        self.capacity, self.by_room, self.mask, self.count = capacity, {}, 0, len(room)
        for b, r in enumerate(room.tolist()):
            self.by_room.setdefault(r, []).append(b)
        for r in self.by_room:
            self.mask |= 1 << r

    def put(self, size: int) -> int:
        over = self.mask >> size
        if over:
            room = size + (over & -over).bit_length() - 1
            held = self.by_room[room]
            b = held.pop()
            if not held:
                del self.by_room[room]
                self.mask ^= 1 << room
            left = room - size
        else:
            b, left = self.count, self.capacity - size
            self.count += 1
        self.by_room.setdefault(left, []).append(b)
        self.mask |= 1 << left
        return b


def best_fit(sizes: np.ndarray, order: np.ndarray, capacity: int, owner: np.ndarray | None = None, room: np.ndarray | None = None) -> np.ndarray:
    """Bin of each item: those in ``order`` are placed in that order, the others stay where ``owner`` has them."""
    bins = Bins(capacity, np.zeros(0, np.int64) if room is None else room)
    out = np.empty(len(sizes), np.int64) if owner is None else owner.copy()
    for i, s in zip(order.tolist(), sizes[order].tolist()):
        out[i] = bins.put(s)
    return out


def fitness(sizes: np.ndarray, owner: np.ndarray, capacity: int, bound: int = 0) -> tuple[int, float]:
    """Fewer bins first, then fuller full bins; with ``bound`` bins nothing is left to gain, and all are as fit."""
    fill = np.bincount(owner, sizes)
    fill = fill[fill > 0]
    return -len(fill), float(np.square(fill / capacity).mean()) if len(fill) > bound else 1.0


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: by sum, and by items over half, with the smaller ones that must fit beside them."""
    if not len(sizes):
        return 0
    best = -(-int(sizes.sum()) // capacity)
    for k in np.unique(np.r_[0, sizes[sizes <= capacity // 2]])[:: max(1, len(sizes) // 64)]:
        large, half = sizes[sizes > capacity - k], sizes[(sizes > capacity // 2) & (sizes <= capacity - k)]
        small = sizes[(sizes >= k) & (sizes <= capacity // 2)]
        best = max(best, len(large) + len(half) + max(0, -(-int(small.sum() - (len(half) * capacity - half.sum())) // capacity)))
    return best


class Individual(NamedTuple):
    """A packing and where it comes from: crossovers in its longest line of descent, and the islands, as bits, whose founders
    are among its ancestors."""

    owner: np.ndarray
    crossovers: int = 0
    islands: int = 0


def crossover(sizes: np.ndarray, into: np.ndarray, giver: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Whole well-filled bins of the giver are injected. Bins that hold an injected item too fall, so no item is twice in
    the child, and so do badly filled bins and a few others; the displaced items are placed by best fit, the largest first."""
    fill = np.bincount(giver, sizes)
    good = np.flatnonzero(fill >= WELL_FILLED * capacity)
    if not len(good):
        good = np.argsort(-fill)[: max(1, len(fill) // 10)]
    chosen = rng.choice(good, max(1, int(len(good) * rng.uniform(0.3, 0.7))), replace=False)
    given = np.isin(giver, chosen)
    own = np.bincount(into, sizes)
    falls = (own < WELL_FILLED * capacity) | (rng.random(len(own)) < SHAKEN)
    falls[into[given]] = True
    loose = falls[into] & ~given
    owner = np.where(given, giver + len(own), into)
    kept = ~loose
    labels, owner[kept] = np.unique(owner[kept], return_inverse=True)
    room = capacity - np.bincount(owner[kept], sizes[kept], len(labels)).astype(np.int64)
    order = np.flatnonzero(loose)
    order = order[np.argsort(-sizes[order] + rng.integers(0, 8, len(order)), kind="stable")]
    return best_fit(sizes, order, capacity, owner, room)


def evolve(sizes: np.ndarray, elites: list[Individual], capacity: int, seed: int, generations: int, population: int, island: int = 0) -> list[Individual]:
    """The island's individuals after ``generations`` generations, or fewer once the fittest has as few bins as any packing
    can have, but one at least; the fittest first, of equals the youngest. Founders, where there are not enough elites, are
    best fits of the items in random order."""
    rng, bound = np.random.default_rng(seed), lower_bound(sizes, capacity)
    ranked = [(fitness(sizes, o.owner, capacity, bound), k, o) for k, o in enumerate(elites)]
    while len(ranked) < population:
        o = Individual(best_fit(sizes, rng.permutation(len(sizes)), capacity), 0, 1 << island)
        ranked.append((fitness(sizes, o.owner, capacity, bound), len(ranked), o))
    born = len(ranked)
    for generation in range(generations):
        ranked.sort(reverse=True, key=lambda x: x[:2])
        if generation and -ranked[0][0][0] <= bound:
            break
        for _ in range(population):
            a, b = sorted(rng.choice(population, 2, replace=False))
            mother, father = ranked[a][2], ranked[b][2]
            child = crossover(sizes, mother.owner, father.owner, capacity, rng)
            ranked.append((fitness(sizes, child, capacity, bound), born, Individual(child, max(mother.crossovers, father.crossovers) + 1, mother.islands | father.islands)))
            born += 1
        ranked = sorted(ranked, reverse=True, key=lambda x: x[:2])[:population]
    return [o for _, _, o in ranked]


#: An individual as it travels: its bins as 32-bit numbers.
ELITE = "struct<owner:binary,crossovers:int,islands:int>"


def _island(capacity: int, turn: int, last: bool):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            out = []
            for shard, island, sizes, elites in zip(rows["shard"], rows["island"], rows["sizes"], rows["elites"]):
                sizes = np.asarray(sizes, np.int64)
                came = [Individual(np.frombuffer(e["owner"], np.int32).astype(np.int64), e["crossovers"], e["islands"]) for e in (elites if elites is not None else [])]
                best = evolve(sizes, came, capacity, int(shard) * 1009 + int(island) * 31 + turn, GENERATIONS, POPULATION, int(island))
                score = fitness(sizes, best[0].owner, capacity, lower_bound(sizes, capacity))
                out.append((shard, island, score[0], score[1], [{"owner": b.owner.astype(np.int32).tobytes(), "crossovers": b.crossovers, "islands": b.islands} for b in best[: 1 if last else 2]]))
            yield pd.DataFrame(out, columns=["shard", "island", "bins", "fill", "elites"])

    return run


def _places(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each item's bin and its offset there."""
    for rows in parts:
        bins, offsets = [], []
        for sizes, elite in zip(rows["sizes"], rows["elite"]):
            sizes, owner = np.asarray(sizes, np.int64), np.frombuffer(elite["owner"], np.int32).astype(np.int64)
            order = np.argsort(owner, kind="stable")
            before = np.cumsum(sizes[order]) - sizes[order]
            starts = np.flatnonzero(np.r_[True, owner[order][1:] != owner[order][:-1]])
            at = np.empty(len(sizes), np.int64)
            at[order] = before - np.repeat(before[starts], np.diff(np.r_[starts, len(sizes)]))
            bins.append(owner)
            offsets.append(at)
        made = {k: [e[k] for e in rows["elite"]] for k in ("crossovers", "islands")}
        yield pd.DataFrame({"shard": rows["shard"], "bins": bins, "offsets": offsets, **made})


def pack(items: DataFrame, size_col: str = "length", capacity: int = CAPACITY, instance: int = INSTANCE) -> DataFrame:
    """items with sequence_id and offset: sequences of at most ``capacity``, as few as the algorithm finds; and with
    crossovers and islands: how many crossovers lie behind the item's packing, and how many islands gave bins to it.

    Items of the capacity's size are sequences of their own. The others are dealt evenly, by row number, into instances
    of about ``instance`` items, whatever keys or sizes they share. Several islands evolve each instance; after each
    turn the two fittest individuals of an island migrate to the next island of that instance. Only sizes travel.
    Sizes must be from 1 to the capacity; null sizes are refused. An empty table gives no rows. Columns named
    sequence_id, offset, crossovers or islands are replaced, all others stay.
    """
    spark = items.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    items = cut(items.drop("sequence_id", "offset", "crossovers", "islands"))
    bad = items.where(F.col(size_col).isNull() | (F.col(size_col) < 1) | (F.col(size_col) > capacity))
    if not bad.isEmpty():
        raise ValueError(f"{size_col} must be from 1 to {capacity}")
    items = items.withColumn("__pos", F.monotonically_increasing_id())
    full = items.where(F.col(size_col) == capacity)
    rest = items.where(F.col(size_col) < capacity)
    shards = max(1, round(rest.count() / instance))
    shard = F.pmod(F.xxhash64("__pos"), F.lit(shards)).alias("shard")
    held = cut(rest.groupBy(shard).agg(F.array_sort(F.collect_list(F.struct("__pos", *items.drop("__pos").columns))).alias("items")))
    sizes = held.select("shard", F.transform("items", lambda x: x[size_col].cast("int")).alias("sizes"))
    islands = sizes.select("shard", "sizes", F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island"))
    schema = f"shard long, island int, bins long, fill double, elites array<{ELITE}>"
    elites = None
    for turn in range(MIGRATIONS + 1):
        if elites is None:
            seeded = islands.withColumn("elites", F.lit(None).cast(f"array<{ELITE}>"))
        else:
            moved = elites.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), "elites")
            own = elites.select("shard", "island", F.slice("elites", 1, 1).alias("own"))
            seeded = islands.join(moved.join(own, ["shard", "island"]), ["shard", "island"]).select("shard", "sizes", "island", F.concat("own", "elites").alias("elites"))
        elites = cut(seeded.repartitionByRange(n_parts, "shard", "island").mapInPandas(_island(capacity, turn, turn == MIGRATIONS), schema))
    best = elites.groupBy("shard").agg(F.max_by(F.get("elites", F.lit(0)), F.struct("bins", "fill", -F.col("island"))).alias("elite"))
    placed = sizes.join(best, "shard").repartitionByRange(n_parts, "shard").mapInPandas(_places, "shard long, bins array<long>, offsets array<long>, crossovers int, islands int")
    made = [F.col("crossovers").cast("long").alias("crossovers"), F.bit_count("islands").cast("long").alias("islands")]
    rows = held.join(placed, "shard").select("shard", *made, F.explode(F.arrays_zip("items", "bins", "offsets")).alias("e"))
    rows = rows.select("e.items.*", (F.shiftleft(F.col("shard"), 20) + F.col("e.bins")).alias("sequence_id"), F.col("e.offsets").alias("offset"), "crossovers", "islands")
    none = F.lit(0).cast("long")
    alone = full.select(*full.columns, (-F.col("__pos") - 1).alias("sequence_id"), none.alias("offset"), none.alias("crossovers"), none.alias("islands"))
    return rows.unionByName(alone).drop("__pos")


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str, str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each document: id_col, piece, start, length, ids_crc32, sequence_id, offset, crossovers, islands.

    Null and empty texts are the end id alone; rows may repeat and ids be null, each row is packed. An empty table gives
    no rows. Other columns are not read. paths: the tokenizer's JSON file, its ranks for tiktoken, and the pattern.
    """
    bound_batches(df.sparkSession, 512)
    return pack(pieces(df, paths or default_paths(), id_col, text_col, capacity), "length", capacity)


def default_paths() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces with their sequence and place there, one row per piece; null and empty texts are the end id
    alone, repeated rows are packed each, a table without rows gives none."""
    return pack_documents(table(spark, sf_dir, "documents"))

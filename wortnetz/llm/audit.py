"""Operator 12, filter interaction audit: what each filter removes in each order, from packed bitmaps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_groups, spread, table, text_of

#: The characters that part words, and the fixed values of the five filters.
BLANK = r"[\x20\x09-\x0D]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_WORDS, DISTINCT_SHARE, CAPITAL_SHARE, SIGNS = 50, 65, 5, r"[#$%&*|]"
#: Filters at most: there are 2 ** n subsets and n! orders.
MOST_FILTERS = 7
#: Parts that a task holds counts of before it hands them on.
HELD_PARTS = 2048


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that look at one text, as conditions of failure."""
    words = F.array_remove(F.split(text, BLANK + "+", -1), "")
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_SHARE * F.size(words),
        "C": 100 * capitals > CAPITAL_SHARE * F.length(text),
        "D": text.rlike(SIGNS),
    }


def failing(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> tuple[DataFrame, str]:
    """((part, bits), "ABCDE"): a row per document; bit i: it fails the i-th filter; the next two bits: its label says
    quality 1, toxic 1.

    E fails where a smaller id has the same text. A null id is neither smaller nor larger than another, so its row passes E. Null
    texts are empty, null parts the empty part. Labels of one id are united; an id without labels is neither good nor toxic.
    Texts are read once and leave their task as digests; those that many rows share are joined by broadcast.
    """
    names = "ABCDE"
    text = text_of("__text")
    flags = text_failures(text)
    base = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("__text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")))
    bits = sum((F.when(flags[f], 1 << k).otherwise(0) for k, f in enumerate(names) if f in flags), F.lit(0))
    rows = base.select("id", "part", bits.alias("bits"), F.unhex(F.sha2(text, 256)).alias("sha"), F.octet_length(text).alias("bytes"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    rows = cut(rows.join(marks, "id", "left").select("id", "part", (F.col("bits") + F.coalesce(F.col("good") * (1 << len(names)) + F.col("toxic") * (2 << len(names)), F.lit(0))).alias("bits"), "sha", "bytes"))
    same = cut(rows.groupBy("sha", "bytes").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    joined = join_groups(rows, same, ["sha", "bytes"], rows.count())
    return joined.select("part", (F.col("bits") + F.when(F.col("id") > F.col("first"), 1 << names.index("E")).otherwise(0)).alias("bits")), names


def steps(k: int) -> list[tuple[int, int]]:
    """(subset, filter) of k filters, a subset being the bits of those already applied."""
    return [(s, f) for s in range(1 << k) for f in range(k) if not s >> f & 1]


def bitmap_counts(part: np.ndarray, bits: np.ndarray, k: int) -> np.ndarray:
    """[part, step, (kept, removed, good lost, toxic lost)] for rows of part numbers from 0 and their bits.

    One packed bitset per filter, per label and for all rows; each part begins on a word of its own, so a part is a run of words.
    What a subset leaves is an AND-NOT of a smaller subset's bitset, a count is a popcount over the part's words.
    """
    size = np.bincount(part)
    words = -(-size // 64)
    start = np.concatenate([[0], np.cumsum(words)[:-1]])
    order = np.argsort(part, kind="stable")
    place = start[part[order]] * 64 + np.arange(len(part)) - np.repeat(np.cumsum(size) - size, size)

    def packed(flag: np.ndarray) -> np.ndarray:
        flat = np.zeros(int(words.sum()) * 64, bool)
        flat[place] = flag[order]
        return np.packbits(flat).view(np.uint64)

    def count(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.bitwise_count(x).astype(np.int64), start)

    fails = [packed(bits >> f & 1 != 0) for f in range(k)]
    good, toxic = (packed(bits >> k + j & 1 != 0) for j in (0, 1))
    left = {0: packed(np.ones(len(part), bool))}
    for s in range(1, 1 << k):
        f = s.bit_length() - 1
        left[s] = left[s ^ 1 << f] & ~fails[f]
    out = np.empty((len(size), len(steps(k)), 4), np.int64)
    for i, (s, f) in enumerate(steps(k)):
        gone = left[s] & fails[f]
        for j, x in enumerate((left[s | 1 << f], gone, gone & good, gone & toxic)):
            out[:, i, j] = count(x)
    return out


def subset_counts(rows: DataFrame, k: int) -> DataFrame:
    """(part, subset, filter, kept, removed, good_lost, toxic_lost): for each part what a filter does to what a subset of the others leaves.

    Each partition counts its own bitmaps batch by batch; a task holds the counts of HELD_PARTS parts at most. Spark sums
    the partitions' counts.
    """
    pairs = steps(k)
    schema = pa.schema([("part", pa.string()), ("subset", pa.int32()), ("filter", pa.int32()), *((c, pa.int64()) for c in ("kept", "removed", "good_lost", "toxic_lost"))])

    def handed(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        names, counts = list(held), np.concatenate(list(held.values()))
        subset, filt = (np.tile(np.array([p[j] for p in pairs], np.int32), len(names)) for j in (0, 1))
        part = pa.DictionaryArray.from_arrays(np.repeat(np.arange(len(names), dtype=np.int32), len(pairs)), pa.array(names, pa.string())).cast(pa.string())
        return pa.RecordBatch.from_arrays([part, pa.array(subset), pa.array(filt), *(pa.array(np.ascontiguousarray(counts[:, j])) for j in range(4))], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            part = b.column(0).dictionary_encode()
            found = bitmap_counts(part.indices.to_numpy(), b.column(1).to_numpy(), k)
            for name, x in zip(part.dictionary.to_pylist(), found):
                held[name] = held[name] + x if name in held else x
            if len(held) > HELD_PARTS:
                yield handed(held)
                held = {}
        if held:
            yield handed(held)

    found = rows.select("part", F.col("bits").cast("int").alias("bits")).mapInArrow(count, "part string, subset int, filter int, kept long, removed long, good_lost long, toxic_lost long")
    return found.groupBy("part", "subset", "filter").agg(*(F.sum(c).alias(c) for c in ("kept", "removed", "good_lost", "toxic_lost")))


def interactions(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for all orders of the filters.

    rows: (part, bits), as ``failing`` gives them, for one to seven filters. shapley is the sum over all orders of what
    the step's filter removes. Every part that occurs has all rows, zeros included; repeated rows count each; without rows there
    are no parts. Orders and steps, n! * n rows, are broadcast; a part has n * 2 ** (n - 1) counts.
    """
    k = len(names)
    if not 0 < k <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")
    bit = {f: i for i, f in enumerate(names)}
    orders = [("".join(o), i + 1, sum(1 << bit[x] for x in o[:i]), bit[f]) for o in permutations(names) for i, f in enumerate(o)]
    orders = rows.sparkSession.createDataFrame(orders, "filter_order string, step int, subset int, filter int")
    counts = subset_counts(rows, k)
    applied = F.bit_count("subset")
    ways = F.element_at(F.array(*(F.lit(factorial(n) * factorial(k - 1 - n)) for n in range(k))), applied + 1)
    of = counts.groupBy("part", "filter").agg(
        F.max(F.when(applied == 0, F.col("removed"))).alias("fails"), F.max(F.when(applied == k - 1, F.col("removed"))).alias("unique_fails"), F.sum(ways * F.col("removed")).alias("shapley"),
        F.collect_list(F.struct("subset", "kept", "removed", "good_lost", "toxic_lost")).alias("steps"),
    )
    flat = of.select("*", F.inline("steps"))  # 2 ** (k - 1) of a part and filter
    return flat.join(F.broadcast(orders), ["subset", "filter"]).select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents in all 120 orders, per source; nulls, ties, repeated rows and a table without rows as
    failing and interactions have them."""
    return interactions(*failing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP12_SQL = r"""
WITH d AS (
  SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents
), l AS (
  SELECT doc_id, CAST(bool_or(quality = 1) AS INTEGER) AS good, CAST(bool_or(toxic = 1) AS INTEGER) AS toxic FROM labels GROUP BY 1
), m AS (
  SELECT part, CAST(len(w) < 50 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INTEGER) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS INTEGER)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(doc_id > least, false) AS INTEGER) AS bits, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM d LEFT JOIN l USING (doc_id)
), c AS (SELECT part, bits, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2
), f AS (SELECT substr('ABCDE', i, 1) AS f FROM range(1, 6) r(i)
), o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a JOIN f b ON a.f <> b.f JOIN f c ON c.f NOT IN (a.f, b.f) JOIN f d ON d.f NOT IN (a.f, b.f, c.f) JOIN f e ON e.f NOT IN (a.f, b.f, c.f, d.f)
), s AS (
  SELECT filter_order, CAST(i AS INTEGER) AS step, 1 << (ascii(filter_order[i]) - 65) AS bit, coalesce(list_sum([1 << (ascii(x) - 65) FOR x IN string_split(filter_order[1:i - 1], '') IF x <> '']), 0)::INTEGER AS done
  FROM o, range(1, 6) r(i)
), x AS (
  SELECT part, filter_order, step, bit, sum(CASE WHEN bits & (done | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN bits & done = 0 AND bits & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN bits & done <> 0 AND bits & bit <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN bits = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN bits & done = 0 AND bits & bit <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN bits & done = 0 AND bits & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM x
"""

"""Column selection, wide and long forms, binds and joins by name."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored


def cols_between(df: DataFrame, first: str, last: str) -> list[str]:
    return df.columns[df.columns.index(first) : df.columns.index(last) + 1]


def cols_matching(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if re.search(pattern, c)]


def place(df: DataFrame, name: str, column: Column, after: str) -> DataFrame:
    """A new column right after another one."""
    cols = [c for c in df.columns if c != name]
    at = cols.index(after) + 1
    return df.select(*cols[:at], column.alias(name), *cols[at:])


def across(df: DataFrame, cols: Sequence[str], f) -> DataFrame:
    """f applied to each of the columns."""
    return df.withColumns({c: f(F.col(c)) for c in cols})


def row_sum(cols: Sequence[str]) -> Column:
    out = F.col(cols[0])
    for c in cols[1:]:
        out = out + F.col(c)
    return out


def wide_to_long(df: DataFrame, values: Sequence[str], positions: Sequence, name: str = "position", sep: str = "_") -> DataFrame:
    """One row per position with the columns ``{value}{sep}{position}`` as value columns; one pass, no shuffle."""
    used = {f"{v}{sep}{p}" for v in values for p in positions}
    rows = F.array(*(F.struct(F.lit(p).alias(name), *(F.col(f"{v}{sep}{p}").alias(v) for v in values)) for p in positions))
    keep = [c for c in df.columns if c not in used]
    return df.select(*keep, F.inline(rows))


def long_to_wide(df: DataFrame, ids: Sequence[str], name: str, values: Sequence[str], positions: Sequence, sep: str = "_") -> DataFrame:
    """One row per id with columns ``{value}{sep}{position}``; positions are given, so no extra pass finds them."""
    cell = lambda v, p: F.first(F.when(F.col(name) == p, F.col(v)), ignorenulls=True).alias(f"{v}{sep}{p}")
    return df.groupBy(*ids).agg(*(cell(v, p) for v in values for p in positions))


def unpivot_split(df: DataFrame, ids: Sequence[str], cols: Sequence[str], sep: str, names: Sequence[str], value: str = "value") -> DataFrame:
    """Long form whose column names are split into several name columns."""
    long = df.unpivot(list(ids), list(cols), "__name", value)
    parts = F.split("__name", re.escape(sep))
    return long.select(*ids, *(parts[i].alias(n) for i, n in enumerate(names)), value)


def flags_to_list(flags: dict[str, str], sep: str = ",") -> Column:
    """Names of the true flags, joined in order; null where none is true. Row-local."""
    text = F.concat_ws(sep, *(F.when(F.col(c), F.lit(label)) for c, label in flags.items()))
    return F.nullif(text, F.lit(""))


def bind_rows(*frames: DataFrame) -> DataFrame:
    """Union by name; missing columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def bind_present(frames: Sequence[DataFrame | None]) -> DataFrame:
    """Union by name of the tables that are there; a failed one is None."""
    return bind_rows(*(f for f in frames if f is not None))


def bind_columns(left: DataFrame, left_order: Sequence[str], right: DataFrame, right_order: Sequence[str]) -> DataFrame:
    """The n-th rows of both side by side. Tables have no order of their own, so each is given one that is total; the
    shorter one is filled with nulls."""
    from .sampling import numbered

    both = numbered(left, *left_order, name="__rn").join(numbered(right, *right_order, name="__rn"), "__rn", "full")
    return both.drop("__rn")


def level(column: Column, levels: Sequence[str]) -> Column:
    """An ordered factor as the place, from 1, of its value among the levels; null for any other value."""
    return F.coalesce(*(F.when(column == v, F.lit(k)) for k, v in enumerate(levels, 1)))


def stack_side_by_side(df: DataFrame, blocks: Sequence[Sequence[str]], names: Sequence[str]) -> DataFrame:
    """Tables that stand next to each other in one sheet, as one; rows with any null go."""
    rows = F.array(*(F.struct(*(F.col(c).alias(n) for c, n in zip(b, names))) for b in blocks))
    return df.select(F.inline(rows)).dropna("any")


def unique_of(df: DataFrame, *cols: str, name: str = "value") -> DataFrame:
    """Distinct values of several columns together."""
    return df.select(F.explode(F.array(*cols)).alias(name)).distinct()


def natural_join(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    return left.join(right, [c for c in left.columns if c in right.columns], how)


def left_join_suffixed(left: DataFrame, right: DataFrame, on: dict[str, str], suffixes: tuple[str, str]) -> DataFrame:
    """Left join on differently named keys; other columns of one name get suffixes."""
    clash = set(left.columns) & set(right.columns) - set(on.values()) - set(on)
    a = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    b = right.withColumnsRenamed({c: c + suffixes[1] for c in clash} | {r: f"__{r}" for r in on.values()})
    condition = [a[k] == b[f"__{r}"] for k, r in on.items()]
    return a.join(b, condition, "left").drop(*(f"__{r}" for r in on.values()))


#: Different keys up to which they are broadcast (about 100 bytes each): a key of most rows is then not dealt to one task.
SMALL_KEYS = 100_000


def membership(df: DataFrame, keys: DataFrame, on: str, flag: str) -> DataFrame:
    """A flag column: is the key in another table? Never null."""
    marked = stored(keys.select(on).distinct()).withColumn("__in", F.lit(True))
    if marked.limit(SMALL_KEYS + 1).count() <= SMALL_KEYS:
        marked = F.broadcast(marked)
    return df.join(marked, on, "left").withColumn(flag, F.coalesce("__in", F.lit(False))).drop("__in")


def lookup_replace(df: DataFrame, table: DataFrame, key: str, new: str, target: str | None = None) -> DataFrame:
    """target := the table's new value where there is one; the table is made unique by key first."""
    target = target or key
    pairs = table.groupBy(F.col(key)).agg(F.min(new).alias("__new"))
    return df.join(pairs, key, "left").withColumn(target, F.coalesce("__new", F.col(target))).drop("__new").select(*df.columns)

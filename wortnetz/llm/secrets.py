"""Operator 8, secret scans: a trigram inverted index and verified candidates, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, text_of
from .trigrams import Query, trigram_query, trigrams_of


class Rule(NamedTuple):
    kind: str
    pattern: str
    #: The group whose length counts, and the least length.
    group: int = 0
    least: int = 1
    base: bool = False


#: Fixed values. The base kinds come first, in the order in which equal starts are listed. Runs that are too short for
#: hex and access can be left to the pattern: a shorter run never hides a longer one.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
#: Texts in one block of the index, about; a posting list holds so many numbers at most, about.
BLOCK_TEXTS = 4096
#: What a found secret is replaced by.
MASK = "[secret]"
#: Code points in a segment of a text; a part of a long text is cut from its segments, not counted from the text's start.
SEGMENT = 4096


def postings(df: DataFrame, text_col: str, grams: list[str], blocks: int) -> DataFrame:
    """(block, lists): the inverted index, per block of texts a map from trigram number to the texts that hold it.

    A text is known by its hash, so copies of one text are one entry. Only trigrams that some rule demands are indexed.
    """
    low = df.select(F.xxhash64(text_of(text_col)).alias("text_key"), F.lower(text_of(text_col)).alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(k)) for k, g in enumerate(grams))))
    rows = low.select("text_key", F.explode(held).alias("gram"))
    lists = rows.groupBy(F.pmod("text_key", F.lit(blocks)).alias("block"), "gram").agg(F.collect_set("text_key").alias("keys"))
    return lists.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "keys"))).alias("lists"))


def _answer(query: Query, grams: list[str]) -> Column:
    """The texts of a block that meet the query: posting lists intersected and united."""
    none = F.array().cast("array<bigint>")
    if isinstance(query, str):
        return F.coalesce(F.element_at("lists", F.lit(grams.index(query))), none)
    parts = [_answer(q, grams) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = F.array_intersect(out, p) if query[0] == "and" else F.array_union(out, p)
    return out


def candidates(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(text_key, maybe): for each text that may match, the numbers of the rules with mandatory trigrams that may."""
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted(set().union(*map(trigrams_of, queries)))
    n = df.select(F.lit(1)).count()
    blocks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // BLOCK_TEXTS))
    index = postings(df, text_col, grams, blocks)
    hits = F.array(*(F.struct(F.lit(k).alias("rule"), _answer(q, grams).alias("keys")) for k, q in enumerate(queries) if q is not True))
    flat = index.select(F.explode(hits).alias("h")).select("h.rule", F.explode("h.keys").alias("text_key"))
    return flat.groupBy("text_key").agg(F.collect_set("rule").alias("maybe"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value's name bound, so that it is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scanned(items: Column, zero: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """Running states: step(state before, item) of each item, zero before the first one, as an array of ``kind``.

    Appending to an array copies it, so n items are worked off in about sqrt(n) chunks of about sqrt(n).
    """
    last = lambda states: F.element_at(states, F.lit(-1))
    rest = lambda states: F.slice(states, 2, F.size(states))

    def body(x: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x))).cast("int"))
        chunks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.lit(0), F.size(x) - 1) / width).cast("int")), lambda k: F.slice(x, k * width + 1, width))
        through = lambda chunk, first: F.aggregate(chunk, F.array(first), lambda states, item: F.concat(states, F.array(step(last(states), item).cast(kind))))
        runs = F.aggregate(chunks, F.array(F.array(zero.cast(kind))), lambda runs, chunk: F.concat(runs, F.array(through(chunk, last(last(runs))))))
        return F.flatten(F.transform(rest(runs), rest))

    return let(items, body)


def _spans(text: Column, rule: Rule, number: int, found: Column) -> Column:
    """Spans (start, kind number, end) of a rule's matches that are long enough; found: all matches.

    What lies between the matches gives their places, in code points.
    """
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda p: F.length(p))
    sizes = F.transform(found, lambda m: F.length(m))
    long = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.least > 1 else found, lambda m: F.length(m) >= rule.least)
    each = F.slice(F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), long.alias("long")), 1, F.size(found))
    kind = "struct<start:int,end:int,long:boolean>"
    zero = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(False).alias("long"))
    step = lambda a, x: F.struct((a["end"] + x["gap"]).alias("start"), (a["end"] + x["gap"] + x["size"]).alias("end"), x["long"].alias("long"))
    spans = F.transform(F.filter(scanned(each, zero, step, kind), lambda s: s["long"]), lambda s: F.struct(s["start"], F.lit(number).alias("kind"), s["end"]))
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def find_secrets(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, name: str = "secrets") -> DataFrame:
    """df with one more column, secrets (or ``name``): array of (start, kind, end), ordered by start, then by kind as the rules list.

    start and end are code points, end exclusive; kind is a rule's name. Rules with mandatory trigrams are tried only on
    the index's candidates, the others on every text. Matches are the leftmost non-overlapping ones of each rule; spans
    of different rules may overlap. Null and empty texts hold no secrets; a table without rows gives none. All other
    columns stay, whatever their names, except one of that name, which is replaced.
    """
    # stored, so that the join deals out both sides anew and Spark can split a text that many rows share
    maybe = cut(candidates(df, text_col, rules).select(F.col("text_key").alias("__key"), F.col("maybe").alias("__maybe")))
    rows = df.drop(name).withColumn("__key", F.xxhash64(text_of(text_col))).join(maybe, "__key", "left")
    none = F.array().cast("array<string>")
    found = {}
    for k, r in enumerate(rules):
        every = F.regexp_extract_all(text_of(text_col), F.lit(r.pattern), F.lit(0))
        found[f"__m{k}"] = every if trigram_query(r.pattern) is True else F.when(F.array_contains("__maybe", k), every).otherwise(none)
    rows = rows.withColumns(found)
    spans = [_spans(text_of(text_col), r, k, F.col(f"__m{k}")) for k, r in enumerate(rules)]
    names = F.array(*(F.lit(r.kind) for r in rules))
    out = F.transform(F.array_sort(F.concat(*spans)), lambda s: F.struct(s["start"], F.get(names, s["kind"]).alias("kind"), s["end"]))
    some = F.lit(False)
    for k in range(len(rules)):
        some = some | (F.size(f"__m{k}") > 0)
    out = F.when(some, out).otherwise(F.array().cast("array<struct<start:int,kind:string,end:int>>"))
    return rows.withColumn(name, out).drop("__key", "__maybe", *found)


def masked(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with every secret in the text replaced by MASK; overlapping spans are replaced as one. Columns as before, one named secrets too; null and
    empty texts stay as they are. The work is about in proportion to a text's length and its number of secrets."""
    rows = find_secrets(df, text_col, name="__spans")
    whole = F.length(text_col)
    zero = F.struct(F.lit(0).alias("done"), F.lit(0).alias("start"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct(a["end"].alias("done"), s["start"].alias("start"), F.greatest(a["end"], s["end"]).alias("end"))
    runs = F.filter(scanned(F.col("__spans"), zero, step, "struct<done:int,start:int,end:int>"), lambda x: x["start"] >= x["done"])
    # what lies before each run of spans, and after the last one
    last = F.array(F.struct(F.array_max(F.transform("__spans", lambda s: s["end"])).alias("done"), whole.alias("start"), whole.alias("end")))

    def part(segments: Column, x: Column) -> Column:
        first = F.floor(x["done"] / SEGMENT).cast("int")
        some = F.slice(segments, first + 1, F.floor((x["start"] - 1) / SEGMENT).cast("int") - first + 1)
        return F.when(x["start"] > x["done"], F.substr(F.array_join(some, ""), x["done"] % SEGMENT + 1, x["start"] - x["done"])).otherwise("")

    between = let(F.regexp_extract_all(text_col, F.lit(f"(?s).{{1,{SEGMENT}}}"), F.lit(0)), lambda segments: F.transform(F.concat(runs, last), lambda x: part(segments, x)))
    return rows.withColumn(text_col, F.when(F.size("__spans") > 0, F.array_join(between, MASK)).otherwise(F.col(text_col))).drop("__spans")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of every document; null and empty texts and a table without rows as find_secrets has them, repeated rows
    each."""
    rows = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    base = [r.kind for r in RULES if r.base]
    counted = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    count = {f"n_{k}": counted(k) for k in base}
    first = F.filter("secrets", lambda s: s["kind"].isin(base))
    return rows.select("doc_id", *(c.alias(n) for n, c in count.items()), F.sha2(joined(first), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def _sql_spans(rule: Rule, number: int) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {number} AS k, '{rule.kind}' AS kind, {str(rule.base).lower()} AS base,
    unnest(list_transform(range(1, len(regexp_extract_all(t, '{p}')) + 1), lambda i: {{
      'start': list_sum(list_transform(string_split_regex(t, '{p}')[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{p}')[1:i - 1], lambda x: length(x))), 0),
      'size': length(regexp_extract_all(t, '{p}')[i]), 'long': length(regexp_extract_all(t, '{p}', {rule.group})[i]) >= {rule.least}}})) AS s
  FROM d WHERE regexp_matches(t, '{p}')"""


OP8_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
u AS ({" UNION ALL ".join(_sql_spans(r, k) for k, r in enumerate(RULES))}),
w AS (SELECT doc_id, k, kind, base, CAST(s.start AS BIGINT) AS a, CAST(s.start + s.size AS BIGINT) AS b FROM u WHERE s.long),
g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (base) AS base_list, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans
  FROM w GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base_list, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""

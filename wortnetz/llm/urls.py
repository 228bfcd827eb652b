"""Operator 11, URL filters: rules by host and path, and for hosts without one the trust and distrust that links carry."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HUB_ROWS, HUBS, cut, join_groups, shared_path, spread, table

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = r"[\x20\x09-\x0D]"
#: The target of an anchor; possessive, so that no page makes it slow.
HREF = rf"(?i)<a(?:{BLANK}|{BLANK}[^<>]*?[\x20\x09-\x0D\x22\x27])href{BLANK}*+={BLANK}*+[\x22\x27]?+{BLANK}*+([^\x22\x27\x20\x09-\x0D<>]++)"
#: Links that leave their host name one; other schemes (mailto:, javascript:) are no links between hosts.
ABSOLUTE = "(?i)^(?:https?:)?//"
#: The share of its standing that a host hands on, the rounds, and the distrust over which a host is blocked (a blocked
#: host that no other links to has 1). Hosts are seeds if rules decide more than this share of their pages alike.
DAMPING, ROUNDS, LEAST_DISTRUST, SEED_SHARE = 0.85, 20, 0.1, 0.5


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


#: The rules of the query (fixed values).
RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def _host(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), CAPITALS, SMALL)


def host_of(url: Column) -> Column:
    return F.coalesce(_host(_rest(url)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does; of equally long ones that with the longer host.

    Rules are a list of some hundreds at most: they become one expression. What such a list leaves open, links decide.
    """
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), len(r.host), r.host)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def judged_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, said): a row per page, said is the rule's verdict."""
    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    return rows.withColumn("m", matched(F.col("host"), F.col("path"), rules)).select("id", "host", "path", F.col("m.rule").alias("rule"), F.col("m.verdict").alias("said"))


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst): distinct pairs of different hosts, the first with a page that links to the second."""
    links = spread(pages.select(host_of(F.col(url_col)).alias("src"), F.col(html_col).alias("__html"))).where("src <> ''")
    out = F.filter(F.regexp_extract_all("__html", F.lit(HREF), F.lit(1)), lambda x: x.rlike(ABSOLUTE))
    hosts = F.array_distinct(F.transform(out, lambda x: _host(F.regexp_replace(x, ABSOLUTE, ""))))
    return links.select("src", F.explode(hosts).alias("dst")).where("dst <> '' AND src <> dst").distinct()


def host_arcs(hosts: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst), distinct: the links; a host and the one its name is a subdomain of by one label, both ways, where both
    occur (``m.a.example`` and ``a.example``); and each host to itself."""
    nodes = cut(hosts.union(links.select("src")).union(links.select("dst")).distinct())
    up = nodes.select(F.col("host").alias("child"), F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1).alias("host")).where("host <> ''")
    known = up.groupBy("host").agg(F.count("*").alias("n")).join(nodes.withColumn("known", F.lit(True)), "host")
    up = join_groups(up, known, ["host"], nodes.count()).where("known").select("child", F.col("host").alias("parent"))
    return cut(links.union(up.select("child", "parent")).union(up.select("parent", "child")).union(nodes.select("host", F.col("host").alias("dst"))).distinct())


def flows(arcs: DataFrame) -> DataFrame:
    """(node, dst, trust_share, distrust_share): trust goes along the arcs, an even share of it to each; distrust against them.

    Both ways of one pair are one row.
    """
    total = arcs.count()
    out = arcs.groupBy("src").agg((1 / F.count("*")).alias("share"), F.count("*").alias("n"))
    back = arcs.groupBy("dst").agg((1 / F.count("*")).alias("share"), F.count("*").alias("n"))
    zero = F.lit(0.0)
    along = join_groups(arcs, out, ["src"], total).select(F.col("src").alias("node"), F.col("dst"), F.col("share").alias("trust_share"), zero.alias("distrust_share"))
    against = join_groups(arcs, back, ["dst"], total).select(F.col("dst").alias("node"), F.col("src").alias("dst"), zero.alias("trust_share"), F.col("share").alias("distrust_share"))
    return along.union(against).groupBy("node", "dst").agg(F.sum("trust_share").alias("trust_share"), F.sum("distrust_share").alias("distrust_share"))


def propagate(seeds: DataFrame, arcs: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust): personalised PageRank from the seeds (host, trusted, blocked), both from 0 to 1.

    In each round a host's trust is its seed's, weighed with 1 - damping, and the damped shares of the hosts that link to
    it; its distrust comes from the hosts it links to. A host that links to none but itself keeps what it has.
    The flows are written once, bucketed by their start, so a round shuffles hosts, not links; the flows of hubs, of which there are
    HUBS at most, meet their standing by broadcast. Every round is stored.
    """
    spark = arcs.sparkSession
    links = cut(flows(arcs))
    degree = links.groupBy("node").agg(F.count("*").alias("n"))
    hubs = cut(degree.where(F.col("n") > max(HUB_ROWS, links.count() // HUBS)).select("node", F.lit(True).alias("hub")))
    marked = links.join(F.broadcast(hubs), "node", "left")
    busy = cut(marked.where("hub").drop("hub"))
    name = f"flows_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    quiet = marked.where("hub IS NULL").drop("hub").repartition(n, "node")
    quiet.write.format("parquet").option("path", shared_path(spark, "flows")).bucketBy(n, "node").sortBy("node").saveAsTable(name)
    try:
        nodes = arcs.select("src").distinct().join(F.broadcast(hubs.withColumnRenamed("node", "src")), "src", "left").join(seeds.withColumnRenamed("host", "src"), "src", "left")
        base = cut(nodes.select(F.col("src").alias("node"), F.coalesce("trusted", F.lit(0.0)).alias("trust"), F.coalesce("blocked", F.lit(0.0)).alias("distrust"), F.coalesce("hub", F.lit(False)).alias("hub")))
        start = base.select("node", ((1 - damping) * F.col("trust")).alias("trust"), ((1 - damping) * F.col("distrust")).alias("distrust"), "hub")
        state = base
        for _ in range(rounds):
            moved = spark.table(name).join(state.where("NOT hub").drop("hub"), "node").unionByName(busy.join(F.broadcast(state.where("hub").drop("hub")), "node"))
            given = moved.select(F.col("dst").alias("node"), (damping * F.col("trust") * F.col("trust_share")).alias("trust"), (damping * F.col("distrust") * F.col("distrust_share")).alias("distrust"), F.lit(False).alias("hub"))
            state = cut(given.union(start).groupBy("node").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"), F.max("hub").alias("hub")))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # its files stay
    return state.select(F.col("node").alias("host"), F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, damping: float = DAMPING, rounds: int = ROUNDS, least: float = LEAST_DISTRUST, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, host, path, rule, verdict, trust, distrust: a row per page.

    A page that a rule fits has the rule's verdict. Seeds are the hosts of which rules allow, or block, more than half of
    the pages, with that share; trust runs along links between hosts, distrust against them. A page without a rule is blocked if its
    host's distrust is over ``least`` and over its trust. Null urls, and those without ``://``, have an empty host and path, no
    standing (null) and are allowed; null html has no links; repeated rows are judged alike; a table without rows gives none; other columns
    are not read. A host of any number of pages, or of links, does not land in one task.
    """
    urls = judged_urls(pages, rules, id_col, url_col)
    hosts = cut(urls.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.when(F.col("said") == "allow", 1).otherwise(0)).alias("allowed"), F.sum(F.when(F.col("said") == "block", 1).otherwise(0)).alias("stopped")))
    share = lambda c: F.when(F.col(c) > SEED_SHARE * F.col("n"), F.col(c) / F.col("n")).otherwise(0.0)
    seeds = hosts.select("host", share("allowed").alias("trusted"), share("stopped").alias("blocked"))
    standing = propagate(seeds, host_arcs(hosts.select("host"), cut(page_links(pages, url_col, html_col))), damping, rounds)
    sized = cut(hosts.select("host", "n").join(standing, "host"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    bad = (F.col("distrust") > least) & (F.col("distrust") > F.col("trust"))
    out = join_groups(urls, sized, ["host"], total)
    verdict = F.coalesce("said", F.when(bad, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), F.round("trust", 6).alias("trust"), F.round("distrust", 6).alias("distrust"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the four rules and by links; nulls, ties, repeated rows and a table without rows as
    filter_urls has them."""
    return filter_urls(table(spark, sf_dir, "pages"))


_SQL_HREF = r"(?i)<a(?:[\x20\x09-\x0D]|[\x20\x09-\x0D][^<>]*?[\x20\x09-\x0D\x22\x27])href[\x20\x09-\x0D]*=[\x20\x09-\x0D]*[\x22\x27]?[\x20\x09-\x0D]*([^\x22\x27\x20\x09-\x0D<>]+)"
OP11_SQL = rf"""
WITH RECURSIVE u AS (
  SELECT page_id, html, coalesce(instr(url, '://'), 0) > 0 AS has, substr(url, instr(url, '://') + 3) AS rest FROM pages
), p AS (
  SELECT page_id, html, CASE WHEN has THEN translate(regexp_extract(rest, '^[^/?#]*', 0), '{CAPITALS}', '{SMALL}') ELSE '' END AS host,
    CASE WHEN has THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u
), j AS (
  SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND path LIKE '/en/%' THEN 'example.net/en/' WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/' WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p
), v AS (
  SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS said FROM j
), h AS (
  SELECT host, CASE WHEN a > {SEED_SHARE} * n THEN a / n ELSE 0 END AS t, CASE WHEN b > {SEED_SHARE} * n THEN b / n ELSE 0 END AS d
  FROM (SELECT host, count(*) AS n, count(*) FILTER (said = 'allow') AS a, count(*) FILTER (said = 'block') AS b FROM v WHERE host <> '' GROUP BY 1) x
), raw AS (
  SELECT host AS src, unnest(regexp_extract_all(html, '{_SQL_HREF}', 1)) AS x FROM p WHERE host <> ''
), l AS (
  SELECT DISTINCT src, translate(regexp_extract(regexp_replace(x, '{ABSOLUTE}', ''), '^[^/?#]*', 0), '{CAPITALS}', '{SMALL}') AS dst FROM raw WHERE regexp_matches(x, '{ABSOLUTE}')
), links AS (SELECT * FROM l WHERE dst <> '' AND src <> dst
), n AS (SELECT host FROM h UNION SELECT src FROM links UNION SELECT dst FROM links
), up AS (
  SELECT host AS child, regexp_extract(host, '^[^.]+\.(.+\..+)$', 1) AS parent FROM n
), arcs AS (
  SELECT src, dst FROM links UNION SELECT child, parent FROM up WHERE parent IN (SELECT host FROM n) UNION SELECT parent, child FROM up WHERE parent IN (SELECT host FROM n) UNION SELECT host, host FROM n
), o AS (SELECT src, count(*) AS k FROM arcs GROUP BY 1
), b AS (SELECT dst, count(*) AS k FROM arcs GROUP BY 1
), f AS (
  SELECT a.node, a.dst, sum(ts) AS ts, sum(ds) AS ds, any_value(coalesce(h.t, 0)) AS st, any_value(coalesce(h.d, 0)) AS sd FROM (
    SELECT arcs.src AS node, arcs.dst AS dst, 1 / o.k AS ts, 0 AS ds FROM arcs JOIN o ON o.src = arcs.src UNION ALL SELECT arcs.dst, arcs.src, 0, 1 / b.k FROM arcs JOIN b ON b.dst = arcs.dst) a
  LEFT JOIN h ON h.host = a.dst GROUP BY a.node, a.dst
), r AS (
  SELECT 0 AS k, n.host AS node, coalesce(t, 0.0) AS t, coalesce(d, 0.0) AS d FROM n LEFT JOIN h ON h.host = n.host
  UNION ALL
  SELECT r.k + 1, f.dst, {1 - DAMPING} * any_value(f.st) + {DAMPING} * sum(r.t * f.ts), {1 - DAMPING} * any_value(f.sd) + {DAMPING} * sum(r.d * f.ds) FROM r JOIN f ON f.node = r.node WHERE r.k < {ROUNDS} GROUP BY r.k, f.dst
), s AS (SELECT node, round(t, 9) AS t, round(d, 9) AS d FROM r WHERE k = {ROUNDS})
SELECT page_id, v.host, path, rule, coalesce(said, CASE WHEN s.d > {LEAST_DISTRUST} AND s.d > s.t THEN 'block' ELSE 'allow' END) AS verdict, round(s.t, 6) AS trust, round(s.d, 6) AS distrust
FROM v LEFT JOIN s ON s.node = v.host
"""

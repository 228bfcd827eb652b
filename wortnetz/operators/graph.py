"""Weighted graphs as edge tables (src, dst, weight)."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Edges up to which a whole graph may be held by one task (about 100 bytes each); larger ones are worked on in rounds.
SMALL_EDGES = 500_000


def infer_edges(long: DataFrame, by: Sequence[str] = (), directed: bool = True, cue: str = "cue", response: str = "response") -> DataFrame:
    """(by, src, dst, weight): answers that are cues of the same group too, with their frequency. Undirected: src <= dst."""
    pairs = long.select(*by, F.col(cue).alias("src"), F.col(response).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")
    pairs = pairs.groupBy(*by, "src", "dst").agg(F.count("*").alias("weight"))
    cues = long.select(*by, F.col(cue).alias("dst")).distinct()
    edges = pairs.join(cues, [*by, "dst"], "left_semi")
    if directed:
        return edges.select(*by, "src", "dst", "weight")
    return edges.groupBy(*by, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").alias("weight"))


def vertices(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return edges.select(*by, F.explode(F.array("src", "dst")).alias("id")).distinct()


def sizes(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_nodes, n_edges, total_weight)."""
    nodes = vertices(edges, by).groupBy(*by).agg(F.count("*").alias("n_nodes"))
    links = edges.groupBy(*by).agg(F.count("*").alias("n_edges"), F.sum("weight").alias("total_weight"))
    return nodes.join(links, list(by)) if by else nodes.join(F.broadcast(links))  # one row


def strengths(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, id, strength): incoming and outgoing weights; a loop counts twice."""
    return edges.select(*by, F.explode(F.array("src", "dst")).alias("id"), "weight").groupBy(*by, "id").agg(F.sum("weight").alias("strength"))


def mean_strength(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return strengths(edges, by).groupBy(*by).agg(F.avg("strength").alias("avg_strength"))


def simple(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The undirected graph without loops and parallel edges: (by, a, b) with a < b."""
    return edges.where("src <> dst").select(*by, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def local_clustering(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, id, degree, triangles, clustering); clustering is null below degree 2.

    Each edge points from the end of lower degree to the other, so no vertex has more than about sqrt(2 * edges) outgoing
    ones; triangles are found among these, which bounds the work around hubs.
    """
    e = stored(simple(edges, by))
    degree = e.select(*by, F.explode(F.array("a", "b")).alias("id")).groupBy(*by, "id").agg(F.count("*").alias("degree"))
    end = lambda c, d: degree.select(*by, F.col("id").alias(c), F.col("degree").alias(d))
    ranked = e.join(end("a", "da"), [*by, "a"]).join(end("b", "db"), [*by, "b"])
    low = F.struct("da", "a") < F.struct("db", "b")
    out = stored(ranked.select(*by, F.when(low, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("y")))
    two = out.join(out.withColumnRenamed("y", "z"), [*by, "x"]).where("y < z")
    closed = two.join(e.select(*by, F.col("a").alias("y"), F.col("b").alias("z")), [*by, "y", "z"])
    triangles = closed.select(*by, F.explode(F.array("x", "y", "z")).alias("id")).groupBy(*by, "id").agg(F.count("*").alias("triangles"))
    per = vertices(edges, by).join(degree, [*by, "id"], "left").join(triangles, [*by, "id"], "left").na.fill(0, ["degree", "triangles"])
    return per.withColumn("clustering", F.try_divide(2 * F.col("triangles"), F.col("degree") * (F.col("degree") - 1)))


def mean_clustering(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Over vertices of degree 2 or more."""
    return local_clustering(edges, by).groupBy(*by).agg(F.avg("clustering").alias("avg_local_cc"))


#: Rows of one vertex from which it may be a hub, and hubs at most: so many rows are broadcast in a round.
HUB_ROWS, HUBS = 256, 4096


def with_least(rows: DataFrame, key: str, value: str, total: int) -> DataFrame:
    """rows with the column m: the least value of the key's rows; total: how many rows there are, or more.

    A vertex with more than total / HUBS rows is a hub, so there are HUBS at most, whatever the graph: these are broadcast, and
    no task gets a hub's rows; the others meet in a join on the key.
    """
    least = rows.groupBy(key).agg(F.min(value).alias("m"), F.count("*").alias("n"))
    limit = max(HUB_ROWS, total // HUBS)
    hubs = least.where(F.col("n") > limit).select(key, "m")
    split = rows.join(F.broadcast(hubs), key, "left")
    rest = split.where("m IS NULL").drop("m").join(least.where(F.col("n") <= limit).select(key, "m"), key)
    return split.where("m IS NOT NULL").unionByName(rest)


def star_links(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(v, u): each vertex that is not the smallest of its component, with the smallest one; links: distinct, u < v.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): a round is two minimum aggregates and two joins on
    vertices, stored, and the number of rounds grows with the logarithm of the longest path. Hubs do not land in one task.
    """
    e, before = stored(links), None
    for _ in range(rounds):
        mark = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before or not mark[0]:
            return e
        before = mark
        both = e.select("u", "v").union(e.select("v", "u"))
        large = with_least(both, "u", "v", 2 * mark[0]).where("v > u").select("v", F.least("u", "m").alias("u")).where("u < v").distinct()
        small = with_least(large, "v", "u", mark[0]).select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct("v", F.col("m").alias("u")))).alias("e")).select("e.v", "e.u")
        e = stored(small.where("u < v").distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def weak_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, component): the smallest vertex of each weak component."""
    edges = stored(edges.select("src", "dst"))
    links = edges.where("src <> dst").select(F.greatest("src", "dst").alias("v"), F.least("src", "dst").alias("u")).distinct()
    e = star_links(links, rounds)
    return vertices(edges).join(e.select(F.col("v").alias("id"), F.col("u").alias("component")), "id", "left").withColumn("component", F.coalesce("component", "id"))


def _tarjan(src: Sequence, dst: Sequence) -> dict:
    """Component name (its smallest vertex) of each vertex, without recursion."""
    out: dict = defaultdict(list)
    for a, b in zip(src, dst):
        out[a].append(b)
        out.setdefault(b, [])
    index: dict = {}
    low: dict = {}
    stack: list = []
    on: set = set()
    names: dict = {}
    for start in list(out):
        if start in index:
            continue
        work = [(start, iter(out[start]))]
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    members = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        members.append(w)
                        if w == v:
                            break
                    name = min(members)
                    names.update(dict.fromkeys(members, name))
    return names


def strong_components(edges: DataFrame, small: int = SMALL_EDGES, rounds: int = 1000) -> DataFrame:
    """(id, component): the smallest vertex of each strong component.

    A graph of ``small`` edges or fewer is walked in one task. A larger one is worked on in rounds: vertices without
    incoming or outgoing edges are components of their own and go; in what is left each vertex takes the smallest vertex
    that reaches it as its colour, and what reaches a colour's vertex within the colour is its component.
    """
    links = stored(edges.select("src", "dst").distinct())
    kind = dict(links.dtypes)["src"]
    if links.limit(small + 1).count() <= small:

        def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = pd.concat(list(parts), ignore_index=True)
            if len(rows):
                names = _tarjan(rows["src"].tolist(), rows["dst"].tolist())
                yield pd.DataFrame({"id": list(names), "component": list(names.values())})

        return links.coalesce(1).mapInPandas(walk, f"id {kind}, component {kind}")
    left = stored(links.where("src <> dst"))
    done = links.sparkSession.createDataFrame([], f"id {kind}, component {kind}")
    tasks = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(rounds):
        while True:  # trim
            kept = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
            n, left = left.count(), stored(kept)
            if left.count() == n:
                break
        if not n:
            break
        color = stored(vertices(left).select("id", F.col("id").alias("c"), F.lit(True).alias("moved")))
        dealt = left.repartition(tasks, "src").persist(StorageLevel.DISK_ONLY)
        while True:  # the smallest vertex that reaches each vertex; only those whose colour is new tell it
            came = dealt.join(color.where("moved").select(F.col("id").alias("src"), "c").hint("shuffle_hash"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("m"))
            color = stored(color.join(came, "id", "left").select("id", F.least("c", "m").alias("c"), F.coalesce(F.col("m") < F.col("c"), F.lit(False)).alias("moved")))
            if color.where("moved").isEmpty():
                break
        dealt.unpersist()
        end = lambda v, c: color.select(F.col("id").alias(v), F.col("c").alias(c))
        inside = left.join(end("src", "cs"), "src").join(end("dst", "cd"), "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("c"))
        inside = inside.repartition(tasks, "dst").persist(StorageLevel.DISK_ONLY)
        reach = more = stored(color.where("id = c").select("id", "c"))
        while True:  # backwards from each colour's vertex; only those that are new go on
            more = stored(inside.join(more.select(F.col("id").alias("dst")).hint("shuffle_hash"), "dst", "left_semi").select(F.col("src").alias("id"), "c").distinct().join(reach, "id", "left_anti"))
            if more.isEmpty():
                break
            reach = stored(reach.union(more))
        inside.unpersist()
        done = stored(done.union(reach.select("id", F.col("c").alias("component"))))
        left = stored(left.join(reach.select(F.col("id").alias("src")), "src", "left_anti").join(reach.select(F.col("id").alias("dst")), "dst", "left_anti"))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return vertices(links).join(done, "id", "left").withColumn("component", F.coalesce("component", "id"))


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count("*").alias("size"))


def largest_component(edges: DataFrame, mode: str = "weak") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges inside it, removed vertices, sizes of all components); of equally large ones the one with the smallest vertex."""
    edges = stored(edges)
    parts = stored(weak_components(edges) if mode == "weak" else strong_components(edges))
    best = component_sizes(parts).orderBy(F.desc("size"), "component").limit(1).select("component")
    inside = parts.join(best, "component", "left_semi").select("id")
    within = edges.join(inside.withColumnRenamed("id", "src"), "src", "left_semi").join(inside.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)
    return within, parts.join(inside, "id", "left_anti").select("id"), component_sizes(parts)


def inverted(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Lengths: the largest weight (of the group) plus one, less the weight."""
    if by:
        return edges.join(edges.groupBy(*by).agg(F.max("weight").alias("__m")), list(by)).withColumn("length", F.col("__m") + 1 - F.col("weight")).drop("__m")
    top = edges.agg(F.max("weight").alias("__m"))
    return edges.join(F.broadcast(top)).withColumn("length", F.col("__m") + 1 - F.col("weight")).drop("__m")  # one row


def distances(edges: DataFrame, directed: bool = False, small: int = SMALL_EDGES, rounds: int = 10_000) -> DataFrame:
    """(a, b, distance) of all ordered pairs that are connected, those of a vertex with itself included.

    Lengths are inverted weights; undirected, the shorter of opposite edges counts. Up to ``small`` edges the graph is
    sent to every task, which walks from its own vertices; beyond that, rounds of joins relax all pairs.
    """
    return _walks(edges, directed, small, rounds, False)


def distance_sums(edges: DataFrame, directed: bool = False, small: int = SMALL_EDGES, rounds: int = 10_000, by: Sequence[str] = ()) -> DataFrame:
    """(a, n, total, eccentricity) per vertex: how many it reaches, itself included, and the sum and the largest of their
    distances, as ``distances`` has them; small graphs' pairs are summed where they are found. With ``by``, weights are inverted
    within their group, and groups share no vertices."""
    return _walks(edges, directed, small, rounds, True, by)


def _walks(edges: DataFrame, directed: bool, small: int, rounds: int, summed: bool, by: Sequence[str] = ()) -> DataFrame:
    arcs = inverted(edges, by).where("src <> dst").select("src", "dst", "length")
    if not directed:
        arcs = arcs.union(arcs.select("dst", "src", "length"))
    arcs = stored(arcs.groupBy("src", "dst").agg(F.min("length").alias("length")))
    nodes = vertices(edges)
    kind = dict(nodes.dtypes)["id"]
    spark = edges.sparkSession
    if arcs.limit(small + 1).count() <= small:
        local = spark.sparkContext.broadcast(arcs.toPandas())  # at most ``small`` rows

        def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import heapq

            out: dict = defaultdict(list)
            for a, b, d in zip(local.value["src"], local.value["dst"], local.value["length"]):
                out[a].append((b, d))
            for part in parts:
                sums = []
                for start in part["id"]:
                    best, heap = {start: 0}, [(0, 0, start)]
                    tick = 1
                    while heap:
                        d, _, v = heapq.heappop(heap)
                        if d > best[v]:
                            continue
                        for w, length in out.get(v, ()):
                            if d + length < best.get(w, float("inf")):
                                best[w] = d + length
                                heapq.heappush(heap, (d + length, tick, w))
                                tick += 1
                    if summed:
                        sums.append((start, len(best), sum(best.values()), max(best.values())))
                    else:
                        yield pd.DataFrame({"a": start, "b": list(best), "distance": list(best.values())})
                if sums:
                    yield pd.DataFrame(sums, columns=["a", "n", "total", "eccentricity"])

        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return nodes.repartition(n).mapInPandas(walk, f"a {kind}, n long, total long, eccentricity long" if summed else f"a {kind}, b {kind}, distance long")
    reach = stored(nodes.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0).cast("long").alias("distance")))
    for _ in range(rounds):
        further = reach.join(arcs.withColumnRenamed("src", "b"), "b").select("a", F.col("dst").alias("b"), (F.col("distance") + F.col("length")).alias("distance"))
        fresh = stored(reach.union(further).groupBy("a", "b").agg(F.min("distance").alias("distance")))
        same = fresh.agg(F.count("*"), F.sum("distance")).first() == reach.agg(F.count("*"), F.sum("distance")).first()
        reach = fresh
        if same:
            return reach.groupBy("a").agg(F.count("*").alias("n"), F.sum("distance").alias("total"), F.max("distance").alias("eccentricity")) if summed else reach
    raise RuntimeError(f"distances did not settle in {rounds} rounds")


def mean_distance(edges: DataFrame, directed: bool = False, exclude_self: bool = False, small: int = SMALL_EDGES) -> DataFrame:
    """Mean over all ordered pairs, infinite if some are not connected."""
    d = distance_sums(edges, directed, small).agg(F.sum("n").alias("k"), F.sum("total").alias("t"), F.count("*").alias("n"))
    k = F.col("k") - F.col("n") if exclude_self else F.col("k")
    wanted = F.col("n") * (F.col("n") - 1) if exclude_self else F.col("n") * F.col("n")
    return d.select(F.when(k < wanted, F.lit(float("inf"))).otherwise(F.try_divide("t", k)).alias("aspl"))


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Weighted modularity of an undirected graph (each edge once) under a membership (id, community)."""
    total = edges.agg(F.sum("weight").alias("w"))
    end = lambda c: membership.select(F.col("id").alias(c), F.col("community").alias(f"c_{c}"))
    inside = edges.join(end("src"), "src").join(end("dst"), "dst").where("c_src = c_dst").groupBy(F.col("c_src").alias("community")).agg(F.sum("weight").alias("in_w"))
    degree = strengths(edges).join(membership, "id").groupBy("community").agg(F.sum("strength").alias("deg"))
    return degree.join(inside, "community", "left").join(F.broadcast(total)).agg(F.sum(F.try_divide(F.coalesce("in_w", F.lit(0)), "w") - F.pow(F.try_divide("deg", 2 * F.col("w")), F.lit(2))).alias("modularity"))


def louvain_local(src: Sequence, dst: Sequence, weight: Sequence, seed: int = 0) -> dict:
    """Communities by greedy moves and aggregation; vertices in order of name, so that a graph has one answer."""
    names = sorted(set(src) | set(dst))
    at = {v: i for i, v in enumerate(names)}
    label = list(range(len(names)))
    adj: list[dict[int, float]] = [defaultdict(float) for _ in names]
    for a, b, w in zip(src, dst, weight):
        i, j = at[a], at[b]
        adj[i][j] += w
        adj[j][i] += w  # a loop counts twice
    while True:
        n = len(adj)
        degree = [sum(x.values()) for x in adj]
        total = sum(degree)
        if not total:
            break
        com, tot = list(range(n)), degree[:]
        queue, waiting = deque(range(n)), [True] * n
        while queue:
            i = queue.popleft()
            waiting[i] = False
            near: dict[int, float] = defaultdict(float)
            for j, w in adj[i].items():
                if j != i:
                    near[com[j]] += w
            old = com[i]
            tot[old] -= degree[i]
            best, gain = old, near.get(old, 0.0) - tot[old] * degree[i] / total
            for c in sorted(near):
                g = near[c] - tot[c] * degree[i] / total
                if g > gain + 1e-12:
                    best, gain = c, g
            tot[best] += degree[i]
            if best != old:
                com[i] = best
                for j in adj[i]:
                    if com[j] != best and not waiting[j]:
                        waiting[j] = True
                        queue.append(j)
        kept = {c: k for k, c in enumerate(sorted(set(com)))}
        if len(kept) == n:
            break
        label = [kept[com[c]] for c in label]
        merged: list[dict[int, float]] = [defaultdict(float) for _ in kept]
        for i, x in enumerate(adj):
            for j, w in x.items():
                merged[kept[com[i]]][kept[com[j]]] += w
        adj = merged
    return {v: label[i] for v, i in at.items()}


#: Rounds of moves on one level of a large graph, at most, and of its own vertices at the end; the share of vertices that must move for another one.
MOVE_ROUNDS, LAST_ROUNDS, LEAST_MOVED = 12, 6, 0.005
#: Vertices up to which their communities are broadcast in each round (about 100 bytes each), so that no link is dealt out again.
BROADCAST_VERTICES = 2_500_000
#: Links of one task at most, about.
TASK_LINKS = 500_000


def louvain(edges: DataFrame, small: int = SMALL_EDGES) -> DataFrame:
    """(id, community) of an undirected graph; communities are numbered.

    Up to ``small`` edges the graph is walked in one task. A larger one is worked on in levels: in rounds, half of its
    vertices, drawn by hash, move to the neighbouring community that gains most; then communities become the vertices of a
    smaller graph, whose communities are found in the same way. Where nothing moves the level's vertices are the answer. At
    the end the graph's own vertices move between the communities that were found, until few do or the rounds are over.
    """
    kind = dict(edges.dtypes)["src"]
    if edges.limit(small + 1).count() <= small:

        def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = pd.concat(list(parts), ignore_index=True).sort_values(["src", "dst"])  # so that sums of fractions have one order
            if len(rows):
                found = louvain_local(rows["src"].tolist(), rows["dst"].tolist(), rows["weight"].tolist())
                yield pd.DataFrame({"id": list(found), "community": list(found.values())})

        return edges.select("src", "dst", "weight").coalesce(1).mapInPandas(walk, f"id {kind}, community long")
    if kind == "bigint":
        return _levels(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst", "weight"), small, LAST_ROUNDS)
    from .sampling import numbered

    ids = stored(numbered(vertices(edges), "id", name="k"))
    end = lambda names, c: names.select(F.col("id").alias(c), F.col("k").alias(f"k_{c}"))
    plain = stored(edges.join(end(ids, "src"), "src").join(end(ids, "dst"), "dst").select(F.col("k_src").alias("src"), F.col("k_dst").alias("dst"), "weight"))
    return stored(ids.join(_levels(plain, small, LAST_ROUNDS).toDF("k", "community"), "k").select("id", "community"))


def _levels(plain: DataFrame, small: int, last: int = 0, degree: DataFrame | None = None) -> DataFrame:
    """(id, community) of a large graph whose vertices are numbers, with so many rounds of its own vertices at the end; degree: (id, deg), if known."""
    dealt = _dealt(plain, degree)
    n = dealt[1].count()
    label = _moved(plain, n, dealt)
    k = label.select("community").distinct().count()
    if k < n:
        end = lambda c, name: _sent(label.toDF(c, name), n)
        merged = plain.join(end("src", "a"), "src").join(end("dst", "b"), "dst").groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("weight").alias("weight"))
        merged = stored(merged)
        if merged.limit(small + 1).count() <= small:
            upper = louvain(merged, small)
        else:
            upper = _levels(merged, small, 0, dealt[1].join(_sent(label, n), "id").groupBy(F.col("community").alias("id")).agg(F.sum("deg").alias("deg")))
        label = stored(label.join(_sent(upper.toDF("community", "upper"), k), "community").select("id", F.col("upper").alias("community")))
        if last:
            label = _moved(plain, n, dealt, label, last)
    dealt[0].unpersist()
    return label


def _sent(df: DataFrame, n: int) -> DataFrame:
    """For a join on vertices, of which there are n: few are broadcast."""
    return F.broadcast(df) if n <= BROADCAST_VERTICES else df


def _dealt(plain: DataFrame, degree: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, degree) of a level, in both directions, dealt out for all rounds: where communities are broadcast, a row for each
    vertex with its neighbours (id, draw, near array, weight array), else a row for each link (id, near, weight), with one of weight 0 from each vertex to itself."""
    plain = plain.withColumn("weight", F.col("weight").cast("double"))
    degree = stored(strengths(plain).withColumnRenamed("strength", "deg") if degree is None else degree)
    n, tasks = degree.count(), max(int(plain.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * plain.count() // TASK_LINKS)
    other = plain.where("src <> dst")
    both = other.select(F.col("src").alias("id"), F.col("dst").alias("near"), "weight").union(other.select("dst", "src", "weight")).union(degree.select("id", "id", F.lit(0.0)))
    both = both.repartition(tasks, "id")
    if n <= BROADCAST_VERTICES:
        both = both.groupBy("id").agg(F.collect_list("near").alias("near"), F.collect_list("weight").alias("weight")).withColumn("draw", _draw("id", n))
    return both.persist(StorageLevel.DISK_ONLY), degree


def _draw(vertex: str, n: int) -> Column:
    """Random bits of a vertex, one for each round; others on each level, since names that are left after a level lie unevenly in its own draws."""
    return F.xxhash64(F.lit(n), vertex)


def _best(v: np.ndarray, c: np.ndarray, w: np.ndarray, tot: np.ndarray, deg: np.ndarray, own: np.ndarray, two_m: float) -> pd.DataFrame:
    """Of rows for each vertex, neighbour and the vertex itself (own): the community that each gains most in, its own or else the smallest of equals."""
    order = np.lexsort((c, v))
    v, c, w, tot, deg, own = (x[order] for x in (v, c, w, tot, deg, own))
    deg = np.repeat(deg[own], np.diff(np.flatnonzero(np.r_[True, v[1:] != v[:-1], True])))
    first = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (c[1:] != c[:-1])])
    w, own = np.add.reduceat(w, first), np.logical_or.reduceat(own, first)
    v, c, tot, deg = v[first], c[first], tot[first], deg[first]
    gain = w - (tot - np.where(own, deg, 0)) * deg / two_m
    order = np.lexsort((-np.arange(len(v)), own, gain, v))
    last = order[np.r_[v[1:] != v[:-1], True]]
    return pd.DataFrame({"id": v[last], "c": c[last], "deg": deg[last], "moved": ~own[last]})


def _moved(plain: DataFrame, n: int, dealt: tuple[DataFrame, DataFrame] | None = None, start: DataFrame | None = None, rounds: int | None = None) -> DataFrame:
    """(id, community) after the rounds of one level, from the communities of start, or from each vertex as its own.

    In a round each vertex learns its neighbours' communities and their weights, and half of the vertices move. Up to
    BROADCAST_VERTICES a round moves a row per vertex; beyond it, half as many as there are links.
    """
    both, degree = dealt or _dealt(plain)
    two_m = degree.agg(F.sum("deg")).first()[0]
    state = degree.select("id", F.col("id").alias("c"), "deg") if start is None else degree.join(_sent(start.toDF("id", "c"), n), "id").select("id", "c", "deg")
    state = stored(state.withColumn("moved", F.lit(True)))
    for turn in range((rounds or MOVE_ROUNDS) if two_m else 0):
        state = stored(_round(both, state, n, turn, two_m))
        if state.where("moved").count() <= LEAST_MOVED * n and turn:
            break
    if dealt is None:
        both.unpersist()
    return state.select("id", F.col("c").alias("community"))


def _round(both: DataFrame, state: DataFrame, n: int, turn: int, two_m: float) -> DataFrame:
    """(id, c, deg, moved) of all vertices after a round."""
    kinds = "id long, c long, deg double, moved boolean"
    if n > BROADCAST_VERTICES:
        known = state.select("id", "c", "deg").join(state.groupBy("c").agg(F.sum("deg").alias("tot")), "c").hint("shuffle_hash")
        own = F.col("id") == F.col("near")
        told = both.join(known, "id").where(own | (F.shiftright(_draw("near", n), turn).bitwiseAND(F.lit(1)) == 1))
        told = told.select(F.col("near").alias("id"), "c", "weight", "tot", "deg", own.alias("own")).repartition(both.rdd.getNumPartitions(), "id")

        def hear(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if found := list(parts):  # about TASK_LINKS
                rows = pd.concat(found, ignore_index=True)
                yield _best(*(rows[x].to_numpy() for x in ("id", "c", "weight", "tot", "deg", "own")), two_m)

        return told.mapInPandas(hear, kinds)
    known = state.select("id", "c", "deg").orderBy("id").toArrow()  # at most BROADCAST_VERTICES rows
    sent = both.sparkSession.sparkContext.broadcast([x.to_numpy() for x in known.columns])

    def look(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, c, deg = sent.value
        names, at = np.unique(c, return_inverse=True)
        tot = np.bincount(at, deg, len(names))[at]
        for rows in parts:
            moves = (rows["draw"].to_numpy() >> turn & 1).astype(bool)
            at = np.searchsorted(ids, rows["id"].to_numpy()[~moves])
            yield pd.DataFrame({"id": ids[at], "c": c[at], "deg": deg[at], "moved": False})
            rows = rows[moves]
            if len(rows):
                v, at = np.repeat(rows["id"].to_numpy(), [len(x) for x in rows["near"]]), np.searchsorted(ids, np.concatenate(rows["near"].to_list()))
                yield _best(v, c[at], np.concatenate(rows["weight"].to_list()), tot[at], deg[at], v == ids[at], two_m)

    return both.mapInPandas(look, kinds)


#: Rounds of the permutation of pairs.
PAIR_ROUNDS = 6


def permuted_pairs(ranks: DataFrame, rank: str, n: int, seed: int) -> DataFrame:
    """ranks with p and q, the pair of two different numbers below n that a keyed permutation of all n * (n - 1) pairs puts at
    a rank (from 0): different ranks have different pairs, so the first m ranks are a draw of m pairs without a pool or a
    distinct. A Feistel network over the sides n and n - 1, which adds digests in turn to one side; q skips p."""
    out = ranks.withColumn("p", F.col(rank) % n).withColumn("q", F.floor(F.col(rank) / n))
    for turn in range(PAIR_ROUNDS):
        to, by, side = ("p", "q", n) if turn % 2 == 0 else ("q", "p", n - 1)
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(turn)), F.col(by).cast("string")))
        out = out.withColumn(to, (F.col(to) + F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")) % side)
    return out.withColumn("q", F.col("q") + F.when(F.col("q") >= F.col("p"), 1).otherwise(0))


def random_graph(edges: DataFrame, seed: int) -> DataFrame:
    """Uniform G(n, m), directed and without loops, on the same vertices; the k-th edge (by src, dst) lends its weight to the
    k-th pair of a permutation of all pairs. Two joins deal out the vertices' names; nothing else moves."""
    from .sampling import numbered

    names = stored(numbered(vertices(edges), "id", name="i"))
    n, m = names.count(), edges.count()
    if m > n * (n - 1):
        raise ValueError("more edges than pairs")
    ranks = numbered(edges.select("src", "dst", "weight"), "src", "dst", name="k").select((F.col("k") - 1).alias("k"), "weight")
    pairs = stored(permuted_pairs(ranks, "k", n, seed).select("p", "q", "weight"))  # else conditions on p and q repeat all rounds of digests
    end = lambda i, c: names.select((F.col("i") - 1).alias(i), F.col("id").alias(c))
    return pairs.join(end("p", "src"), "p").join(end("q", "dst"), "q").select("src", "dst", "weight")


def lattice(spark, n: int, nei: int) -> DataFrame:
    """(src, dst): each of n vertices with the ``nei`` next ones on a line."""
    return spark.range(n - 1).select(F.col("id").alias("src"), F.explode(F.sequence(F.col("id") + 1, F.least(F.col("id") + nei, F.lit(n - 1)))).alias("dst"))


def lattice_graph(edges: DataFrame, nei: int, seed: int) -> DataFrame:
    """The lattice on as many vertices, with weights drawn from the graph's with replacement."""
    from .sampling import numbered

    n = vertices(edges).count()
    pool = numbered(edges.select("weight", "src", "dst"), "src", "dst", name="k").select("k", "weight")
    m = edges.count()
    drawn = lattice(edges.sparkSession, n, nei).withColumn("k", F.pmod(F.xxhash64(F.lit(seed), "src", "dst"), F.lit(m)) + 1)
    return drawn.join(pool, "k").select("src", "dst", "weight")


def graph_metrics(edges: DataFrame, directed: bool = True) -> DataFrame:
    """One row: vertices, edges, components, the largest one's size, mean strength, clustering and distance; undirected
    graphs also have the modularity of their communities."""
    return metrics_by(edges.withColumn("__all", F.lit(1)), "__all", directed).drop("__all")


def metrics_by(edges: DataFrame, by: str, directed: bool = True) -> DataFrame:
    """graph_metrics of each data set, all in one pass: their graphs are parts of one, whose vertices are numbered over all data
    sets. Edges of a null data set are left out. Only communities of undirected graphs are found data set by data set, since
    their gains depend on the whole weight of a graph."""
    from .sampling import numbered

    edges = edges.where(F.col(by).isNotNull()).select(by, "src", "dst", "weight")
    names = stored(numbered(vertices(edges, [by]), by, "id", name="k").select(by, "id", "k"))
    end = lambda c: names.select(by, F.col("id").alias(c), F.col("k").alias(f"k_{c}"))
    plain = stored(edges.join(end("src"), [by, "src"]).join(end("dst"), [by, "dst"]).select(by, F.col("k_src").alias("src"), F.col("k_dst").alias("dst"), "weight"))
    of = names.select(by, "k")
    parts = weak_components(plain).join(of.withColumnRenamed("k", "id"), "id").groupBy(by, "component").agg(F.count("*").alias("size"))
    reach = distance_sums(plain, by=[by]).join(of.withColumnRenamed("k", "a"), "a").groupBy(by).agg(F.sum("n").alias("k"), F.sum("total").alias("t"), F.count("*").alias("n"))
    tables = [
        sizes(plain, [by]).drop("total_weight"), parts.groupBy(by).agg(F.count("*").alias("n_components"), F.max("size").alias("n_giant_component")),
        mean_strength(plain, [by]), mean_clustering(plain, [by]), reach.select(by, F.when(F.col("k") < F.col("n") * F.col("n"), F.lit(float("inf"))).otherwise(F.try_divide("t", "k")).alias("aspl")),
    ]
    if not directed:
        values = [r[0] for r in plain.select(by).distinct().collect()]  # a data set each
        found = []
        for v in values:
            one = plain.where(F.col(by) == F.lit(v)).drop(by)
            found.append(modularity(one, stored(louvain(one))).withColumn(by, F.lit(v)))
        if found:
            tables.append(reduce(DataFrame.unionByName, found))
    return reduce(lambda x, y: x.join(y, by, "left"), tables)

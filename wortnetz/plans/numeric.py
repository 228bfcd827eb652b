"""Queries on ratings, matrices, embeddings and graphs, and on sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import graph, ingest, lexical, matrix, models, reshape, sampling, similarity, statistics
from ..session import stored
from ..sources import readers, writers
from ..sources.enrich import LookupEnricher
from ..streaming import counts as streaming
from .fixtures import answers, load, norms, r6, sql, trials, trials_key, words


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def norms_full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = norms(spark, sf_dir), load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    long = load(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("double").alias("length"))
    joined = n.select("doc_id", "quality", "toxic").join(e, ["doc_id"], "full").join(long, ["doc_id"], "full")
    total = reshape.row_sum([f"__{c}" for c in ("quality", "toxic", "label", "length")])
    there = {f"__{c}": F.col(c).isNotNull().cast("int") for c in ("quality", "toxic", "label", "length")}
    return joined.withColumns(there).groupBy((F.col("doc_id") % 50).alias("g")).agg(*(r6(F.avg(c)).alias(c) for c in ("quality", "toxic", "label", "length")), F.sum(total).alias("n_there"))


def rating_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = norms(spark, sf_dir).select("doc_id", F.col("n_chars").cast("double").alias("rating"))
    frames = [n.where(f"doc_id % 3 = {i}").select("doc_id", F.lit(k).alias("source"), r6(scalars.rescaled(F.col("rating") % 20, a, b)).alias("rating")) for i, (k, (a, b)) in enumerate(scalars.SCALES.items())]
    return reshape.bind_rows(*frames)


def pearson_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = norms(spark, sf_dir).select("lang", F.log10("n_chars").alias("x"), (F.col("quality") + F.col("doc_id") % 7).cast("double").alias("y"))
    return _rounded(statistics.correlation_tests(n, "x", "y", ["lang"]).drop("p_value", "t"))


def pearson_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tests with p values, which SQL has no function for."""
    n = norms(spark, sf_dir).select("lang", F.log10("n_chars").alias("length"), F.col("toxic").cast("double").alias("toxic"), F.col("quality").cast("double").alias("y"))
    return statistics.predictor_tests(n, "y", ["length", "toxic"], ["lang"])


def steiger_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = norms(spark, sf_dir).select("lang", F.log10("n_chars").alias("j"), (F.col("quality") + F.col("doc_id") % 7).cast("double").alias("k"), (F.col("toxic") * 2 + F.col("doc_id") % 5).cast("double").alias("h"))
    return _rounded(statistics.steiger_tests(n, "j", "k", "h", ["lang"]).drop("p_value"))


def fisher_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = norms(spark, sf_dir).select("lang", F.log10("n_chars").alias("x"), (F.col("quality") + F.col("doc_id") % 7).cast("double").alias("y"))
    return _rounded(statistics.fisher_mean(statistics.correlation_tests(n, "x", "y", ["lang"])))


def perc_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").groupBy("event_type", F.dayofmonth("ts").alias("day")).agg(F.count("*").alias("n"))
    return _rounded(statistics.relative_increase(e, "n", ["event_type"]))


def kernel_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(statistics.kernel_density(load(spark, sf_dir, "events"), "value", 0.0, 100.0, 21, 4.0))


def _coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.counts_matrix(lexical.associations(answers(trials(spark, sf_dir))))


def cosine_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(matrix.cosine_pairs(_coo(spark, sf_dir)))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): the names of parts with neighbouring keys, as pairs that are asked for."""
    p = load(spark, sf_dir, "part").select("p_partkey", "p_name")
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b"))
    return p.withColumnRenamed("p_name", "a").join(after, "p_partkey").select("a", "b").distinct()


def cosine_requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(matrix.cosine_pairs(_coo(spark, sf_dir), _asked(spark, sf_dir)))


def ppmi_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(matrix.ppmi_joint(_coo(spark, sf_dir)))


def ppmi_colmean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(matrix.ppmi_colmean(matrix.normalize_rows(_coo(spark, sf_dir))))


def normalize_rows_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(matrix.normalize_rows(_coo(spark, sf_dir), "l1"))


def normalize_rows_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(matrix.normalize_rows(_coo(spark, sf_dir), "l2"))


def matrix_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(matrix.density(_coo(spark, sf_dir)))


def katz_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(matrix.katz(matrix.normalize_rows(_coo(spark, sf_dir)), 0.75, tol=1e-13, method="series"))


def katz_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(matrix.katz(matrix.normalize_rows(_coo(spark, sf_dir)), 0.75, method="dense"))


def spreading_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(matrix.spreading_activation(_coo(spark, sf_dir), _asked(spark, sf_dir)))


def _embedded(spark: SparkSession, sf_dir: str, least: int) -> DataFrame:
    counts = matrix.counts_matrix(lexical.associations(answers(trials(spark, sf_dir))), least=least)
    unit = stored(matrix.l2_normalize(matrix.svd_embedding(matrix.ppmi_joint(counts), 300)))
    end = lambda c, v: unit.select(F.col("word").alias(c), F.col("vec").alias(v))
    return _rounded(_asked(spark, sf_dir).join(end("a", "x"), "a").join(end("b", "y"), "b").select("a", "b", matrix.dot("x", "y").alias("cosine"))).withColumn("cosine", F.col("cosine") + 0.0)  # no negative zeros


def svd_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines, which do not depend on signs, of all pairs asked for, in an embedding of 300 dimensions or the rank. Where the rank
    is lower, they are those of the whole rows, which SQL can tell."""
    return _embedded(spark, sf_dir, 1)


def embedding_least_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from associations given five times or more."""
    return _embedded(spark, sf_dir, 5)


def l2_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("vec"))
    return matrix.l2_normalize(e).select("vec_id", F.posexplode("vec").alias("k", "x")).withColumn("x", r6(F.col("x")))


def embedding_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated query set, the ids divisible by 100, against all vectors; the five nearest of each."""
    e = matrix.l2_normalize(load(spark, sf_dir, "embeddings"), "embedding").select("vec_id", "embedding")
    return sampling.slice_max(matrix.nearest(e, F.col("vec_id") % 100 == 0, 5), ["query"], "cosine", 5)


def written_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, x, quality, toxic, diversity, word_length): 26 shares of letters and four of other characters of each whole text,
    and what may be predicted from them; quality and toxic are null where no label is."""
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    share = lambda pattern: F.try_divide(F.regexp_count("text", F.lit(pattern)) * 100.0, F.length("text"))
    spoken = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")
    d = d.select("doc_id", F.array(*(F.coalesce(share(p), F.lit(0.0)) for p in [f"[{c}{c.upper()}]" for c in LETTERS] + ["[A-Z]", "[0-9]", r"\s", r"[.,;:!?]"])).alias("x"), spoken.alias("w"))
    d = d.select("doc_id", "x", F.try_divide(F.size(F.array_distinct("w")) * 100.0, F.size("w")).alias("diversity"), F.try_divide(F.length(F.array_join("w", "")) * 1.0, F.size("w")).alias("word_length"))
    return d.join(load(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def ridge_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four properties of documents, two of them given for some only, each from the letters, the other characters and both: split,
    penalty by ten folds over the whole grid, test score and interval, all cells in one pass over the training rows."""
    sets = {"letters": range(26), "others": range(26, 30), "combined": range(30)}
    return _rounded(models.ridge_table(written_features(spark, sf_dir), ["quality", "toxic", "diversity", "word_length"], sets, "x", "doc_id"))


def r2_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = norms(spark, sf_dir).groupBy("lang", "source").agg(F.avg("quality").alias("rsq"))
    return _rounded(statistics.r2_summary(n, ["lang"]))


def edges_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.infer_edges(answers(trials(spark, sf_dir)))


def edges_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.infer_edges(answers(trials_key(spark, sf_dir)), directed=False)


def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.sizes(graph.infer_edges(answers(trials_key(spark, sf_dir)), ["section"]), ["section"])


def strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.strengths(graph.infer_edges(answers(trials_key(spark, sf_dir))))


def clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(graph.local_clustering(graph.infer_edges(answers(trials_key(spark, sf_dir)))))


def components_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.weak_components(graph.infer_edges(answers(trials_key(spark, sf_dir))))


def components_strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.strong_components(graph.infer_edges(answers(trials_key(spark, sf_dir))))


def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside, _, _ = graph.largest_component(graph.infer_edges(answers(trials_key(spark, sf_dir))), "strong")
    return inside


def path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(graph.mean_distance(graph.infer_edges(answers(trials(spark, sf_dir)))))


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.distance_sums(graph.infer_edges(answers(trials(spark, sf_dir)))).drop("n")


def lattice_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lattice on as many vertices as the graph of part keys has."""
    n = graph.vertices(graph.infer_edges(answers(trials_key(spark, sf_dir)))).count()
    return graph.lattice(spark, n, 42)


def random_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many edges as the graph of part keys has, between pairs drawn by a keyed permutation."""
    return graph.random_graph(stored(graph.infer_edges(answers(trials_key(spark, sf_dir)))), 1984)


def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the partition of part keys by remainder."""
    edges = stored(graph.infer_edges(answers(trials_key(spark, sf_dir)), directed=False))
    return _rounded(graph.modularity(edges, graph.vertices(edges).withColumn("community", F.col("id") % 7)))


def louvain_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = stored(graph.infer_edges(answers(trials_key(spark, sf_dir)), directed=False))
    return graph.modularity(edges, stored(graph.louvain(edges)))


#: Cosine from which two targets are linked.
ALIKE = 0.2


def _alike(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return similarity.similar_rows(matrix.ppmi_joint(stored(_coo(spark, sf_dir))), ALIKE)


def target_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many others each cue is linked to by its answers, and the sum of their cosines."""
    return _rounded(similarity.link_counts(*_alike(spark, sf_dir)))


def target_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The community of each cue in the graph of similar cues, and how often the cue is an answer."""
    often = lexical.associations(answers(trials(spark, sf_dir))).groupBy(F.col("response").alias("row_id")).agg(F.sum("n").alias("frequency"))
    return similarity.clusters(*_alike(spark, sf_dir)).join(often, "row_id", "left").select(F.col("row_id").alias("target"), "cluster", F.coalesce("frequency", F.lit(0)).alias("frequency"))


def metric_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.infer_edges(answers(trials(spark, sf_dir)), ["section"])
    m = graph.sizes(edges, ["section"]).join(graph.mean_strength(edges, ["section"]), "section").join(graph.mean_clustering(edges, ["section"]), "section")
    return _rounded(statistics.spread(m, ["n_nodes", "n_edges", "avg_strength", "avg_local_cc"]))


def graph_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(graph.graph_metrics(graph.infer_edges(answers(trials(spark, sf_dir)))))


def metrics_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same measures of each section's graph."""
    return _rounded(graph.metrics_by(graph.infer_edges(answers(trials(spark, sf_dir)), ["section"]), "section"))


def _out(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    import uuid

    stored(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def delimited_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written with semicolons, decimal commas and missing values, and read again."""
    path = _out(spark, "export")
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority")).alias("priority"), F.replace(F.format_string("%.2f", "o_totalprice"), F.lit("."), F.lit(",")).alias("price"))
    writers.write_export(o, path, sep=";")
    return readers.read_decimal_comma(spark, path, "o_orderkey long, priority string, price string", ["price"])


def vector_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector file with a header line, scanned for some words whose case may differ."""
    path = _out(spark, "vectors")
    e = load(spark, sf_dir, "embeddings")
    lines = e.select(F.concat_ws(" ", F.concat(F.lit("Word"), F.col("vec_id")), F.array_join(F.transform("embedding", lambda x: F.format_string("%.4f", x)), " ")).alias("value"))
    lines.union(spark.createDataFrame([("500 64",)], "value string")).write.text(path)
    v = readers.read_vectors(spark, path, e.select(F.concat(F.lit("wORD"), F.col("vec_id")).alias("word")))
    return v.select("word", F.posexplode("vec").alias("k", "x"))


def chunked_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks written one by one; a second run skips those that are there."""
    path = _out(spark, "chunks")
    rows = sampling.chunks(load(spark, sf_dir, "customer").select("c_custkey"), 100, "c_custkey")
    writers.write_chunks(rows.where("chunk <= 5"), path)
    writers.write_chunks(rows, path)
    return spark.read.parquet(path).groupBy(F.col("chunk").cast("long").alias("chunk")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"))


def title_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(spark, sf_dir).select("word").distinct()
    known = w.where(F.length("word") % 2 == 0).select("word", F.upper("word").alias("title"))
    return LookupEnricher(known).enrich(w, ["word"])


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per type and day, worked off as a stream; a last row moves the watermark on so that all days are final."""
    source, path, checkpoint = _out(spark, "in"), _out(spark, "out"), _out(spark, "state")
    e = load(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    e.write.parquet(source)
    e.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit("end").alias("event_type")).write.mode("append").parquet(source)
    stream = streaming.windowed_counts(streaming.read_folder(spark, source, e.schema, 1000), "event_type")
    streaming.run_available(stream, path, checkpoint)
    return spark.read.parquet(path).where("event_type <> 'end'").select("event_type", "start", "n")


def histogram_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = lexical.zipf(lexical.frequencies(words(spark, sf_dir), "word", ["lang"]), ["lang"])
    return ingest.histogram(z.withColumn("long", F.length("word") > 6), "zipf", 50, 0.0, 10.0, ["long"]).withColumn("density", r6(F.col("density")))


QUERIES = {f.__name__: f for f in (norms_full_join, rating_rescale, pearson_by_group, pearson_p_values, steiger_test, fisher_mean, perc_increase, kernel_density, cosine_counts, cosine_requested, ppmi_joint, ppmi_colmean, normalize_rows_l1, normalize_rows_l2, matrix_density, katz_series, katz_exact, spreading_activation, svd_embedding, embedding_least_count, l2_embedding, embedding_cosine, ridge_norms, r2_summary, edges_directed, edges_undirected, graph_counts, strength, clustering, components_weak, components_strong, largest_component, path_length, distances, lattice_edges, random_graph, modularity, louvain_modularity, target_similarity, target_clusters, metric_spread, graph_metrics, metrics_by_section, delimited_round_trip, vector_file, chunked_export, title_enrichment, stream_counts, histogram_by_flag)}

_XY = "x AS (SELECT lang, log10(n_chars) AS x, CAST(quality + doc_id % 7 AS DOUBLE) AS y FROM norms)"
_R = "SELECT lang, count(*) AS n, corr(x, y) AS r FROM x GROUP BY lang"
_NORM = "g AS (SELECT cue AS i, response AS j, n / sum(n) OVER (PARTITION BY cue) AS v FROM counts)"
_KATZ = _NORM + ", p0 AS MATERIALIZED (SELECT i, j, v * 0.75 AS v FROM g), w AS (SELECT i FROM p0 UNION SELECT j FROM p0), s0 AS MATERIALIZED (SELECT i, j, sum(v) AS v FROM (SELECT i, i AS j, CAST(1 AS DOUBLE) AS v FROM w UNION ALL SELECT * FROM p0) x GROUP BY 1, 2)" + "".join(
    f", p{k} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM p{k - 1} a JOIN p{k - 1} b ON a.j = b.i GROUP BY 1, 2), s{k} AS MATERIALIZED (SELECT i, j, sum(v) AS v FROM (SELECT * FROM s{k - 1} UNION ALL SELECT a.i, b.j, sum(a.v * b.v) FROM p{k} a JOIN s{k - 1} b ON a.j = b.i GROUP BY 1, 2) x GROUP BY 1, 2)"
    for k in range(1, 8)
)
_K = "SELECT i AS row_id, j AS col_id, round(v, 6) AS value FROM s7"
_COS = "u AS (SELECT cue AS i, response AS k, n / sqrt(sum(n * n) OVER (PARTITION BY cue)) AS v FROM counts)"
_PPMI_COS = "p AS (SELECT cue AS i, response AS k, log2(n * (sum(n) OVER ()) / (sum(n) OVER (PARTITION BY cue) * sum(n) OVER (PARTITION BY response))) AS v FROM counts), u AS (SELECT i, k, v / sqrt(sum(v * v) OVER (PARTITION BY i)) AS v FROM p WHERE v > 0), d AS (SELECT x.i, y.i AS j, sum(x.v * y.v) AS c FROM u x JOIN u y ON x.k = y.k AND x.i <> y.i GROUP BY 1, 2 HAVING round(sum(x.v * y.v), 9) >= 0.2)"


def _svd(least: int) -> str:
    """Of rows whose rank is below the number of dimensions."""
    ppmi = f"p AS (SELECT cue AS i, response AS k, log2(n * (sum(n) OVER ()) / (sum(n) OVER (PARTITION BY cue) * sum(n) OVER (PARTITION BY response))) AS v FROM counts WHERE n >= {least}), u AS (SELECT i, k, v / sqrt(sum(v * v) OVER (PARTITION BY i)) AS v FROM p WHERE v > 0)"
    pairs = "SELECT DISTINCT q.p_name AS a, r.p_name AS b FROM part q JOIN part r ON r.p_partkey = q.p_partkey + 1 WHERE q.p_name IN (SELECT i FROM u) AND r.p_name IN (SELECT i FROM u)"
    return sql("counts", f"SELECT p.a, p.b, round(coalesce(sum(x.v * y.v), 0), 6) + 0 AS cosine FROM ({pairs}) p LEFT JOIN u x ON x.i = p.a LEFT JOIN u y ON y.i = p.b AND y.k = x.k GROUP BY 1, 2", more=ppmi)


#: The permutation of pairs, a round each.
_PAIRS = "vn AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM (SELECT src AS id FROM edges_key UNION SELECT dst FROM edges_key) v), m AS (SELECT count(*) AS n FROM vn), q0 AS (SELECT k % n AS p, k // n AS q, weight, n FROM (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS k, weight FROM edges_key) e CROSS JOIN m)" + "".join(
    f", q{t + 1} AS (SELECT {a} AS p, {b} AS q, weight, n FROM q{t})"
    for t, (a, b) in enumerate((f"(p + CAST('0x' || substr(md5('1984:{t}:' || q), 1, 12) AS BIGINT)) % n", "q") if t % 2 == 0 else ("p", f"(q + CAST('0x' || substr(md5('1984:{t}:' || p), 1, 12) AS BIGINT)) % (n - 1)") for t in range(graph.PAIR_ROUNDS))
)
_SIMPLE = "e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges_key WHERE src <> dst), n AS (SELECT a AS v, b AS w FROM e UNION ALL SELECT b, a FROM e), d AS (SELECT v, count(*) AS degree FROM n GROUP BY v), tr AS (SELECT x.v, count(*) AS triangles FROM n x JOIN n y ON x.v = y.v AND x.w < y.w JOIN e ON e.a = x.w AND e.b = y.w GROUP BY x.v), vs AS (SELECT src AS id FROM edges_key UNION SELECT dst FROM edges_key)"
_ARCS = "len AS (SELECT src, dst, (SELECT max(weight) + 1 FROM edges) - weight AS l FROM edges WHERE src <> dst), vs AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges), arc AS (SELECT src, dst, min(l) AS l FROM (SELECT * FROM len UNION ALL SELECT dst, src, l FROM len) x GROUP BY 1, 2), d0 AS (SELECT a.id AS a, b.id AS b, CASE WHEN a.id = b.id THEN 0 ELSE arc.l END AS d FROM vs a CROSS JOIN vs b LEFT JOIN arc ON src = a.id AND dst = b.id)" + "".join(f", d{k} AS (SELECT x.a, y.b, min(x.d + y.d) AS d FROM d{k - 1} x JOIN d{k - 1} y ON x.b = y.a WHERE x.d IS NOT NULL AND y.d IS NOT NULL GROUP BY 1, 2)" for k in range(1, 7))
_SECTION_ARCS = "len AS (SELECT section, src, dst, max(weight) OVER (PARTITION BY section) + 1 - weight AS l FROM s), arc AS (SELECT section, src, dst, min(l) AS l FROM (SELECT * FROM len UNION ALL SELECT section, dst, src, l FROM len) x WHERE src <> dst GROUP BY 1, 2, 3), d0 AS (SELECT section, id AS a, id AS b, 0 AS d FROM vs UNION ALL SELECT section, src, dst, l FROM arc)" + "".join(f", d{k} AS MATERIALIZED (SELECT x.section, x.a, y.b, min(x.d + y.d) AS d FROM d{k - 1} x JOIN d{k - 1} y ON x.section = y.section AND x.b = y.a GROUP BY 1, 2, 3)" for k in range(1, 7))
_BY_SECTION = "s AS (SELECT section, cue AS src, response AS dst, count(*) AS weight FROM answers WHERE response IS NOT NULL AND (section, response) IN (SELECT (section, cue) FROM answers) GROUP BY 1, 2, 3), e AS (SELECT DISTINCT section, least(src, dst) AS a, greatest(src, dst) AS b FROM s WHERE src <> dst), n AS (SELECT section, a AS v, b AS w FROM e UNION ALL SELECT section, b, a FROM e), d AS (SELECT section, v, count(*) AS degree FROM n GROUP BY 1, 2), tr AS (SELECT x.section, x.v, count(*) AS t FROM n x JOIN n y ON x.section = y.section AND x.v = y.v AND x.w < y.w JOIN e ON e.section = x.section AND e.a = x.w AND e.b = y.w GROUP BY 1, 2), cc AS (SELECT section, avg(2 * coalesce(t, 0) / (degree * (degree - 1))) AS cc FROM d LEFT JOIN tr USING (section, v) WHERE degree > 1 GROUP BY 1), vs AS (SELECT section, src AS id FROM s UNION SELECT section, dst FROM s), k AS (SELECT section, count(*) AS n_nodes FROM vs GROUP BY 1), m AS (SELECT section, n_nodes, count(*) AS n_edges, 2 * sum(weight) / n_nodes AS st, cc FROM s JOIN k USING (section) JOIN cc USING (section) GROUP BY section, n_nodes, cc)"
SQL = {
    "norms_full_join": sql("norms", "SELECT doc_id % 50 AS g, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic, round(avg(label), 6) AS label, round(avg(length), 6) AS length, count(quality) + count(toxic) + count(label) + count(length) AS n_there FROM norms FULL JOIN (SELECT vec_id AS doc_id, label FROM embeddings) e USING (doc_id) FULL JOIN (SELECT doc_id, CAST(length(text) AS DOUBLE) AS length FROM documents) l USING (doc_id) GROUP BY 1"),
    "rating_rescale": sql("norms", "SELECT doc_id, ['ten', 'four', 'twenty'][doc_id % 3 + 1] AS source, round(CASE doc_id % 3 WHEN 0 THEN n_chars % 20 / 10 WHEN 1 THEN n_chars % 20 / 4 ELSE (n_chars % 20 - 1) / 19 END, 6) AS rating FROM norms"),
    "pearson_by_group": sql("norms", f"SELECT lang, n, round(r, 6) AS r, round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 6) AS ci_lower, round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 6) AS ci_upper FROM ({_R}) y", more=_XY),
    "steiger_test": sql("norms", "SELECT lang, round(jk, 6) AS r_jk, round(jh, 6) AS r_jh, round(kh, 6) AS r_kh, n, round((atanh(jk) - atanh(jh)) * sqrt(n - 3) / sqrt(2 - 2 * ((kh * (1 - 2 * m * m) - m * m / 2 * (1 - 2 * m * m - kh * kh)) / pow(1 - m * m, 2))), 6) AS z FROM (SELECT *, (jk + jh) / 2 AS m FROM (SELECT lang, corr(j, k) AS jk, corr(j, h) AS jh, corr(k, h) AS kh, count(j) AS n FROM (SELECT lang, log10(n_chars) AS j, CAST(quality + doc_id % 7 AS DOUBLE) AS k, CAST(toxic * 2 + doc_id % 5 AS DOUBLE) AS h FROM norms) a GROUP BY lang) b) c"),
    "fisher_mean": sql("norms", f"SELECT round(tanh(avg(atanh(r))), 6) AS mean_r FROM ({_R}) y", more=_XY),
    "perc_increase": "SELECT event_type, CAST(day AS INTEGER) AS day, n, round(n / min(n) OVER (PARTITION BY event_type) - 1, 6) AS increase FROM (SELECT event_type, dayofmonth(ts) AS day, count(*) AS n FROM events GROUP BY 1, 2) x",
    "kernel_density": "SELECT round(x, 6) AS x, round(sum(n * exp(-pow((x - b * 0.5) / 4, 2) / 2)) / ((SELECT count(value) FROM events) * 4 * 2.5066282746310002), 6) AS density FROM (SELECT round(value / 0.5) AS b, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1) c CROSS JOIN (SELECT i * 5.0 AS x FROM range(0, 21) r(i)) g GROUP BY x",
    "cosine_counts": sql("counts", "SELECT x.i AS a, y.i AS b, round(sum(x.v * y.v), 6) AS cosine FROM u x JOIN u y ON x.k = y.k AND x.i < y.i GROUP BY 1, 2", more=_COS),
    "cosine_requested": sql("counts", "SELECT p.a, p.b, round(coalesce(sum(x.v * y.v), 0), 6) AS cosine FROM (SELECT DISTINCT q.p_name AS a, r.p_name AS b FROM part q JOIN part r ON r.p_partkey = q.p_partkey + 1) p LEFT JOIN u x ON x.i = p.a LEFT JOIN u y ON y.i = p.b AND y.k = x.k GROUP BY 1, 2", more=_COS),
    "ppmi_joint": sql("counts", "SELECT row_id, col_id, round(v, 6) AS value FROM (SELECT cue AS row_id, response AS col_id, log2(n * (sum(n) OVER ()) / (sum(n) OVER (PARTITION BY cue) * sum(n) OVER (PARTITION BY response))) AS v FROM counts) x WHERE v > 0"),
    "ppmi_colmean": sql("counts", "SELECT i AS row_id, j AS col_id, round(v, 6) AS value FROM (SELECT i, j, log2(v * (SELECT count(DISTINCT i) FROM g) / sum(v) OVER (PARTITION BY j)) AS v FROM g) x WHERE v > 0", more=_NORM),
    "normalize_rows_l1": sql("counts", "SELECT i AS row_id, j AS col_id, round(v, 6) AS value FROM g", more=_NORM),
    "normalize_rows_l2": sql("counts", "SELECT i AS row_id, k AS col_id, round(v, 6) AS value FROM u", more=_COS),
    "matrix_density": sql("counts", "SELECT count(*) AS nnz, count(DISTINCT cue) AS n_rows, count(DISTINCT response) AS n_cols, round(count(*) / (count(DISTINCT cue) * count(DISTINCT response)), 6) AS density FROM counts"),
    "katz_series": sql("counts", _K, more=_KATZ),
    "katz_exact": sql("counts", _K, more=_KATZ),
    "svd_embedding": _svd(1),
    "embedding_least_count": _svd(5),
    "l2_embedding": "SELECT vec_id, CAST(k - 1 AS INTEGER) AS k, round(v[k] / n, 6) AS x FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS k, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3) AS v FROM embeddings) a) b",
    "embedding_cosine": "SELECT query, vec_id, cosine FROM (SELECT *, rank() OVER (PARTITION BY query ORDER BY cosine DESC) AS r FROM (SELECT q.vec_id AS query, e.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id) a) b WHERE r <= 5",
    "r2_summary": sql("norms", "SELECT lang, round(avg(rsq), 6) AS mean_rsq, round(min(rsq), 6) AS min_rsq, round(max(rsq), 6) AS max_rsq FROM (SELECT lang, source, avg(quality) AS rsq FROM norms GROUP BY 1, 2) x GROUP BY lang"),
    "edges_directed": sql("edges", "SELECT src, dst, weight FROM edges"),
    "edges_undirected": sql("edges_key", "SELECT least(src, dst) AS src, greatest(src, dst) AS dst, CAST(sum(weight) AS BIGINT) AS weight FROM edges_key GROUP BY 1, 2"),
    "graph_counts": sql("answers_key", "SELECT section, (SELECT count(*) FROM (SELECT src FROM s x WHERE x.section = s.section UNION SELECT dst FROM s x WHERE x.section = s.section) y) AS n_nodes, count(*) AS n_edges, CAST(sum(weight) AS BIGINT) AS total_weight FROM s GROUP BY section", more="s AS (SELECT section, cue AS src, response AS dst, count(*) AS weight FROM answers_key WHERE (section, response) IN (SELECT (section, cue) FROM answers_key) AND response IS NOT NULL GROUP BY 1, 2, 3)"),
    "strength": sql("edges_key", "SELECT id, CAST(sum(weight) AS BIGINT) AS strength FROM (SELECT src AS id, weight FROM edges_key UNION ALL SELECT dst, weight FROM edges_key) x GROUP BY id"),
    "clustering": sql("edges_key", "SELECT id, coalesce(degree, 0) AS degree, coalesce(triangles, 0) AS triangles, CASE WHEN degree > 1 THEN round(2 * coalesce(triangles, 0) / (degree * (degree - 1)), 6) END AS clustering FROM vs LEFT JOIN d ON d.v = id LEFT JOIN tr ON tr.v = id", more=_SIMPLE),
    "components_weak": sql("edges_key", "SELECT x AS id, min(y) AS component FROM r GROUP BY x", True, "b AS (SELECT src AS x, dst AS y FROM edges_key UNION SELECT dst, src FROM edges_key), r(x, y) AS (SELECT x, x FROM b UNION SELECT r.x, b.y FROM r JOIN b ON r.y = b.x)"),
    "components_strong": sql("edges_key", "SELECT p.x AS id, min(p.y) AS component FROM r p JOIN r q ON p.x = q.y AND p.y = q.x GROUP BY p.x", True, "v AS (SELECT src AS x FROM edges_key UNION SELECT dst FROM edges_key), r(x, y) AS (SELECT x, x FROM v UNION SELECT r.x, e.dst FROM r JOIN edges_key e ON r.y = e.src)"),
    "largest_component": sql("edges_key", "SELECT src, dst, weight FROM edges_key WHERE src IN (SELECT x FROM best) AND dst IN (SELECT x FROM best)", True, "v AS (SELECT src AS x FROM edges_key UNION SELECT dst FROM edges_key), r(x, y) AS (SELECT x, x FROM v UNION SELECT r.x, e.dst FROM r JOIN edges_key e ON r.y = e.src), c AS (SELECT p.x, min(p.y) AS k FROM r p JOIN r q ON p.x = q.y AND p.y = q.x GROUP BY p.x), best AS (SELECT x FROM c WHERE k = (SELECT k FROM c GROUP BY k ORDER BY count(*) DESC, k LIMIT 1))"),
    "path_length": sql("edges", "SELECT round(avg(d), 6) AS aspl FROM d6", more=_ARCS),
    "distances": sql("edges", "SELECT a, CAST(sum(d) AS BIGINT) AS total, max(d) AS eccentricity FROM d6 GROUP BY a", more=_ARCS),
    "lattice_edges": sql("edges_key", "SELECT i AS src, i + k AS dst FROM (SELECT i, unnest(range(1, 43)) AS k, n FROM (SELECT n, unnest(range(0, n)) AS i FROM vn) a) b WHERE i + k < n", more="vn AS (SELECT count(*) AS n FROM (SELECT src FROM edges_key UNION SELECT dst FROM edges_key) v)"),
    "random_graph": sql("edges_key", f"SELECT x.id AS src, y.id AS dst, weight FROM q{graph.PAIR_ROUNDS} JOIN vn x ON x.i = p JOIN vn y ON y.i = CASE WHEN q >= p THEN q + 1 ELSE q END", more=_PAIRS),
    "modularity": sql("edges_key", "SELECT round((SELECT sum(weight) FROM edges_key WHERE src % 7 = dst % 7) / (SELECT sum(weight) FROM edges_key) - sum(pow(s / (2 * (SELECT sum(weight) FROM edges_key)), 2)), 6) AS modularity FROM (SELECT id % 7 AS c, sum(weight) AS s FROM (SELECT src AS id, weight FROM edges_key UNION ALL SELECT dst, weight FROM edges_key) x GROUP BY 1) y"),
    "target_similarity": sql("counts", "SELECT row_id, count(c) AS n_links, round(coalesce(sum(c), 0), 6) AS strength FROM (SELECT DISTINCT i AS row_id FROM u) a LEFT JOIN d ON d.i = row_id GROUP BY row_id", more=_PPMI_COS),
    "metric_spread": sql("answers", "SELECT round(a, 6) AS n_nodes, round(b, 6) AS n_edges, round(c, 6) AS avg_strength, round(d, 6) AS avg_local_cc, round(greatest(a, b, c, d), 6) AS largest FROM (SELECT 1 - min(n_nodes) / max(n_nodes) AS a, 1 - min(n_edges) / max(n_edges) AS b, 1 - min(st) / max(st) AS c, 1 - min(cc) / max(cc) AS d FROM m) x", more=_BY_SECTION),
    "graph_metrics": sql("edges", "SELECT (SELECT count(*) FROM vs) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, count(*) AS n_components, max(size) AS n_giant_component, (SELECT round(2 * sum(weight) / (SELECT count(*) FROM vs), 6) FROM edges) AS avg_strength, (SELECT round(avg(2 * coalesce(triangles, 0) / (degree * (degree - 1))), 6) FROM d LEFT JOIN tr USING (v) WHERE degree > 1) AS avg_local_cc, (SELECT round(avg(d), 6) FROM d6) AS aspl FROM (SELECT c, count(*) AS size FROM (SELECT x, min(y) AS c FROM r GROUP BY x) y GROUP BY c) z", True, _ARCS + ", " + _SIMPLE.replace("edges_key", "edges").rpartition(", vs AS")[0] + ", bb AS (SELECT src AS x, dst AS y FROM edges UNION SELECT dst, src FROM edges), r(x, y) AS (SELECT x, x FROM bb UNION SELECT r.x, bb.y FROM r JOIN bb ON r.y = bb.x)"),
    "metrics_by_section": sql("answers", "SELECT m.section, n_nodes, n_edges, n_components, n_giant_component, round(st, 6) AS avg_strength, round(cc, 6) AS avg_local_cc, CASE WHEN reached < n_nodes * n_nodes THEN CAST('inf' AS DOUBLE) ELSE round(total / reached, 6) END AS aspl FROM m JOIN (SELECT section, count(*) AS n_components, max(size) AS n_giant_component FROM (SELECT section, c, count(*) AS size FROM (SELECT section, a, min(b) AS c FROM d6 WHERE d IS NOT NULL GROUP BY 1, 2) y GROUP BY 1, 2) z GROUP BY 1) p ON p.section = m.section JOIN (SELECT section, count(d) AS reached, sum(d) AS total FROM d6 GROUP BY 1) w ON w.section = m.section", more=_BY_SECTION + ", " + _SECTION_ARCS),
    "delimited_round_trip": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS priority, CAST(printf('%.2f', o_totalprice) AS DOUBLE) AS price FROM orders",
    "vector_file": "SELECT 'Word' || vec_id AS word, CAST(k - 1 AS INTEGER) AS k, CAST(printf('%.4f', embedding[k]) AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings) e",
    "chunked_export": "SELECT CAST((r - 1) // 100 + 1 AS BIGINT) AS chunk, count(*) AS n, min(c_custkey) AS first FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) x GROUP BY 1",
    "title_enrichment": sql("words", "SELECT DISTINCT word, CASE WHEN length(word) % 2 = 0 THEN replace(upper(word), 'ẞ', 'SS') END AS title, CASE WHEN length(word) % 2 = 0 THEN NULL ELSE 'not found' END AS error FROM words"),
    "stream_counts": "SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, count(*) AS n FROM events GROUP BY 1, 2",
    "histogram_by_flag": sql("words", "SELECT long, CAST(least(floor(z / 0.2), 49) AS INTEGER) AS bin, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY long) * 0.2), 6) AS density FROM (SELECT length(word) > 6 AS long, log10((n + 1) / (sum(n) OVER (PARTITION BY lang) / 1e6 + count(*) OVER (PARTITION BY lang) / 1e6)) + 3 AS z FROM (SELECT lang, word, count(*) AS n FROM words GROUP BY 1, 2) x) y WHERE z BETWEEN 0 AND 10 GROUP BY 1, 2"),
}

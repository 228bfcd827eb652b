"""Operator 10, quality classifier: weak labels by expectation-maximisation, then a hashed linear scorer.

Two heads share the method: ``junk`` (symbols, shouting, tables, stuttering) and ``toxic`` (insults). For each head,
overlapping heuristic labellers vote on every document; EM estimates how often each labeller is right; the posterior of
its votes is a document's weak label; and a linear scorer over hashed words learns these labels and scores all texts.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, cut, spread, table, text_of

HEADS = ("junk", "toxic")
#: A vote.
NONE, BAD, GOOD = 0, 1, 2
#: Bounds on what is fitted in the driver: labelled rows from which insults are mined, rows per weak class to train on.
LABELLED_ROWS, TRAIN_ROWS = 4000, 3000
#: Hashed features of the linear scorer (so many that a text's words seldom meet another's weight; only features with a
#: weight are kept), and the length of word stems.
WIDTH, STEM = 1 << 31, 4
#: Words whose features a worker remembers.
REMEMBERED = 300_000
#: Insults known beforehand (fixed values); the labelled rows add to them.
INSULTS = frozenset("idiot moron stupid loser pathetic worthless scum trash clown disgusting".split())
SYMBOLS, EDGES = "#$%&*|<>{}~^=", "#$%&*|<>{}~^=.,;:!?\"'()[]-_/"
#: A mined word or stem is in so many toxic rows, and such a share of them; such a share of the rows with it is toxic.
LEAST_ROWS, SUPPORT, PURITY = 4, 0.02, 0.8
#: A feature is trained on if it is in so many rows of the sample, and so many standard errors from no effect.
LEAST_SEEN, DOUBT = 5, 4.0
#: Mined stems are so many letters long. A lone mined word or stem counts only beside fewer other words than this.
STEMS, LONE_WORDS = (4, 5, 6, 7), 60


def words_of(text: str) -> set[str]:
    """The distinct lower-cased words without punctuation at their edges."""
    return {w.strip(EDGES) for w in set(text.lower().split())} - {""}


def shape(text: str) -> dict[str, float]:
    """Shares of a text's words, and of their count the symbols in it."""
    w = text.split()
    n = max(1, len(w))
    return {
        "words": len(w),
        "symbols": sum(map(text.count, SYMBOLS)) / n,
        "bangs": text.count("!!") / n,
        "bars": text.count("|") / n,
        "capitals": sum(map(str.isupper, w)) / n,
        "stutter": sum(map(operator.eq, w, w[1:])) / n,
        "variety": len(set(w)) / n,
        "length": sum(map(len, w)) / n,
    }


def kin(text: str) -> int:
    """The least hash of a text's pairs of neighbouring words: copies and most near copies share it, other texts seldom do."""
    w = text.encode().split()
    return min(map(zlib.crc32, map(b" ".join, zip(w, w[1:]))), default=zlib.crc32(text.encode()))


def junk_votes(s: dict[str, float]) -> list[int]:
    """Each labeller looks at other signs; most overlap with another one. All abstain on texts without words."""
    if not s["words"]:
        return [NONE] * 6
    rule = lambda bad, good: BAD if bad else GOOD if good else NONE
    return [
        rule(s["symbols"] > 0.5, s["symbols"] < 0.05),
        rule(s["bangs"] > 0.25 or s["bars"] > 0.15, s["bangs"] + s["bars"] < 0.02),
        rule(s["capitals"] > 0.5, s["capitals"] < 0.2),
        rule(s["stutter"] > 0.2, s["stutter"] < 0.05),
        rule(s["words"] >= 40 and s["variety"] < 0.12, s["variety"] > 0.35),
        rule(s["length"] > 14 or s["symbols"] > 0.25 or s["capitals"] > 0.35, 2 < s["length"] < 12),
    ]


def toxic_votes(words: set[str], mined: tuple[frozenset, frozenset]) -> list[int]:
    """Listed insults, mined words, mined stems, and more than one of any. A lone mined word in a long text is no vote."""
    hits = [len(words & INSULTS), len(words & mined[0]), sum(w[:k] in mined[1] for w in words for k in STEMS)]
    dense = [h > 1 or h and len(words) < LONE_WORDS for h in hits]
    rule = lambda bad, good: BAD if bad else GOOD if good else NONE
    return [*(rule(d, not h) for d, h in zip(dense, hits)), rule(sum(h > 1 for h in hits) > 1 or hits[0], not any(hits))]


def mine(rows: DataFrame) -> tuple[frozenset, frozenset]:
    """(words, stems) that toxic rows among the labelled ones (text, toxic) hold far more often than others. Of near copies
    one counts, or the idle words of a large family would look toxic.

    Words are counted in the executors; the driver gets the mined ones alone. Each is in a share of SUPPORT of the toxic rows
    or more, so there are 1 / SUPPORT times as many as a toxic row has words on average at most.
    """

    @F.pandas_udf("kin long, words array<string>, stems array<string>")
    def parts(texts: pd.Series) -> pd.DataFrame:
        words = [words_of(t) for t in texts]
        stems = [sorted({w[:k] for w in ws for k in STEMS if len(w) > k}) for ws in words]
        return pd.DataFrame({"kin": [kin(t) for t in texts], "words": list(map(sorted, words)), "stems": stems})

    held = rows.select("toxic", F.xxhash64("text").alias("key"), parts("text").alias("p")).select("toxic", "key", "p.*")
    one = cut(held.groupBy("kin", "toxic").agg(F.min_by(F.struct("words", "stems"), "key").alias("p")).select("toxic", "p.*"))
    n = {bool(r["toxic"]): r["n"] for r in one.groupBy((F.col("toxic") != 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return frozenset(), frozenset()
    least, found = max(LEAST_ROWS, SUPPORT * n[True]), []
    for c in ("words", "stems"):
        seen = one.select(F.explode(c).alias("w"), F.when(F.col("toxic") != 0, 1).otherwise(0).alias("bad")).groupBy("w").agg(F.sum("bad").alias("bad"), F.count("*").alias("n"))
        found.append(frozenset(r["w"] for r in seen.where((F.col("bad") >= least) & (F.col("bad") >= PURITY * F.col("n"))).collect()))
    return found[0], found[1]


def vote_patterns(column: Column, mined: tuple[frozenset, frozenset]) -> Column:
    """Per text the heads' votes, as two strings of digits, and its kin."""

    @F.pandas_udf("junk string, toxic string, kin long")
    def votes(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            out = [("".join(map(str, junk_votes(shape(t)))), "".join(map(str, toxic_votes(words_of(t), mined))), kin(t)) for t in texts]
            yield pd.DataFrame(out, columns=[*HEADS, "kin"])

    return votes(F.coalesce(column, F.lit("")))


def em(counts: dict[str, int], rounds: int = 60) -> tuple[dict[str, float], np.ndarray, float]:
    """Posterior that a text is bad for each pattern of votes, the labellers' accuracies, and the share of bad texts.

    Dawid and Skene's model over the pattern counts of all texts. Labellers are independent given the class; each has
    its own chance of every vote in either class. It starts from the share of bad votes.
    """
    patterns = sorted(counts)
    if not patterns:
        return {}, np.zeros(0), 0.0
    votes = np.array([[int(c) for c in p] for p in patterns])
    n = np.array([counts[p] for p in patterns], float)
    hot = (votes[:, :, None] == np.arange(3)).astype(float)  # pattern, labeller, vote
    bad = np.where((votes == BAD).any(axis=1), 0.9, 0.02)
    for _ in range(rounds):
        prior = np.clip((n * bad).sum() / n.sum(), 1e-4, 0.9)
        seen = np.stack([np.einsum("p,plv->lv", n * (1 - bad), hot), np.einsum("p,plv->lv", n * bad, hot)]) + 0.1
        chance = np.log(seen / seen.sum(axis=2, keepdims=True))
        score = np.log([1 - prior, prior])[:, None] + np.einsum("plv,clv->cp", hot, chance)
        fresh = 1 / (1 + np.exp(np.clip(score[0] - score[1], -50, 50)))
        # a pattern without a bad vote is no evidence of a bad text
        fresh = np.where((votes == BAD).any(axis=1), fresh, np.minimum(fresh, 0.4))
        if np.abs(fresh - bad).max() < 1e-9:
            break
        bad = fresh
    weights = n[:, None] * (votes != NONE)
    right = np.where(votes == BAD, bad[:, None], 1 - bad[:, None])
    return dict(zip(patterns, bad.tolist())), (weights * right).sum(axis=0) / np.maximum(weights.sum(axis=0), 1), float((n * bad).sum() / n.sum())


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) % WIDTH


def sign_features(text: str, words: set[str], mined: tuple[frozenset, frozenset]) -> list[int]:
    """Slots of the text's shape, by thresholds, and of the labellers that vote against it."""
    s = shape(text)
    steps = {"symbols": (0.1, 0.25, 0.5), "bangs": (0.1, 0.25), "bars": (0.08, 0.15), "capitals": (0.2, 0.35, 0.5), "stutter": (0.1, 0.2), "variety": (0.12, 0.2, 0.35), "length": (12, 14)}
    out = [f"\x00{k}>{v}" for k, vs in steps.items() for v in vs if s[k] > v and (k not in ("stutter", "variety") or s["words"] >= 40)]
    out += [f"\x00{head}{k}" for head, votes in zip(HEADS, (junk_votes(s), toxic_votes(words, mined))) for k, v in enumerate(votes) if v == BAD]
    return [_slot(f) for f in out]


def word_features(word: str) -> tuple[int, int]:
    return _slot(word), _slot(word[:STEM] + "\x00")


def features(text: str, mined: tuple[frozenset, frozenset]) -> list[int]:
    """Distinct slots of a text: signs, words and stems."""
    words = words_of(text)
    return sorted({*sign_features(text, words, mined), *(f for w in words for f in word_features(w))})


def telling(sample: DataFrame, heads: tuple[str, ...] = HEADS) -> DataFrame:
    """(slot, junk, toxic): for each slot of the sample (key, x, p_junk, p_toxic) whether it tells much about a head.

    That is, the share of bad rows among its rows lies at least halfway from the overall share to one, beyond doubt.
    """
    total = sample.agg(*(F.avg(f"p_{h}").alias(f"all_{h}") for h in heads))  # one row
    per = sample.select(F.explode("x").alias("slot"), *(f"p_{h}" for h in heads)).groupBy("slot").agg(F.count("*").alias("k"), *(F.sum(f"p_{h}").alias(f"bad_{h}") for h in heads))
    per = per.where(F.col("k") >= LEAST_SEEN).join(F.broadcast(total))
    k = F.col("k")

    def tells(h: str) -> Column:
        bad, share = F.col(f"bad_{h}"), F.col(f"all_{h}")
        return (bad >= k * (1 + share) / 2) & (bad - k * share > DOUBT * F.sqrt(F.greatest(k * share * (1 - share), F.lit(1e-9))))

    flags = per.select("slot", *(tells(h).alias(h) for h in heads))
    return flags.where(" OR ".join(heads))


def train(rows: list[tuple[np.ndarray, float]], passes: int = 10, rate: float = 0.3, shrink: float = 0.04) -> tuple[dict[int, float], float]:
    """Weights and intercept of a logistic regression on soft labels, by FTRL-proximal steps.

    rows: the telling features of each text, and its label. Their gradients must sum to ``shrink`` of the bad rows before
    they get a weight. A long text holds thousands of words that tell little, whose small weights would add up.
    """
    if not rows:
        return {}, 0.0
    target, sizes = np.array([y for _, y in rows]), np.array([len(x) for x, _ in rows])
    slots, at = np.unique(np.concatenate([x for x, _ in rows]), return_inverse=True)
    n = len(slots)
    data = [np.append(x, n) for x in np.split(at, np.cumsum(sizes)[:-1])]
    z, g2, w = np.zeros(n + 1), np.full(n + 1, 1e-6), np.zeros(n + 1)
    order, least = np.random.default_rng(0), max(2.0, shrink * float(target.sum()))
    for _ in range(passes):
        for i in order.permutation(len(data)):
            x = data[i]
            g = 1 / (1 + np.exp(-np.clip(w[x].sum(), -30, 30))) - target[i]
            step = (np.sqrt(g2[x] + g * g) - np.sqrt(g2[x])) / rate
            z[x] += g - step * w[x]
            g2[x] += g * g
            limit = np.where(x == n, 0.0, least)
            w[x] = np.where(np.abs(z[x]) <= limit, 0.0, -(z[x] - np.sign(z[x]) * limit) / ((1.0 + np.sqrt(g2[x])) / rate))
    return {int(s): float(v) for s, v in zip(slots, w) if v}, float(w[n])


class Model:
    """Weights of the heads; a text's score is a log-odds, over 0 bad."""

    def __init__(self, heads: dict[str, tuple[dict[int, float], float]], accuracies: dict[str, list[float]], mined: tuple[frozenset, frozenset]):
        both = [heads[h][0] for h in HEADS]
        self.weights = {s: tuple(w.get(s, 0.0) for w in both) for s in sorted({*both[0], *both[1]})}
        self.intercepts = [heads[h][1] for h in HEADS]
        self.accuracies, self.mined = accuracies, mined

    def scores(self, column: Column) -> Column:
        """struct(junk, toxic) of doubles."""
        table_, start, mined = self.weights, self.intercepts, self.mined

        @F.pandas_udf("junk double, toxic double")
        def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            known: dict[str, tuple | None] = {}
            for texts in parts:
                out = []
                for t in texts:
                    words = words_of(t)
                    slots: dict[int, None] = dict.fromkeys(f for f in sign_features(t, words, mined) if f in table_)
                    for w in words:
                        if w not in known:
                            if len(known) >= REMEMBERED:
                                known.clear()
                            known[w] = tuple(f for f in word_features(w) if f in table_) or None
                        if known[w]:
                            slots.update(dict.fromkeys(known[w]))
                    sums = list(start)
                    for f in slots:
                        sums[0] += table_[f][0]
                        sums[1] += table_[f][1]
                    out.append(sums)
                yield pd.DataFrame(out, columns=list(HEADS), dtype="float64")

        return score(F.coalesce(column, F.lit("")))


def fit(df: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", labelled_rows: int = LABELLED_ROWS, train_rows: int = TRAIN_ROWS) -> Model:
    """The model of a corpus. Votes and EM cover all of its rows.

    labels (id_col, toxic), if given, serve only to mine insults, from ``labelled_rows`` rows at most. The scorer learns
    from ``train_rows`` rows at most of each weak class: junk, toxic, and twice as many others. Both samples are the
    rows with the smallest hashes, and both bounds are parameters that do not grow with the corpus. Null texts count
    as empty, on which all labellers abstain. A corpus without rows, or without bad votes, gives a model that keeps all.
    """
    bound_batches(df.sparkSession)
    rows = spread(df.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")))
    mined: tuple[frozenset, frozenset] = (frozenset(), frozenset())
    if labels is not None:
        # the sample of labels is bounded, so its join needs no shuffle of texts; of rows that repeat an id one is taken
        present = rows.select("id").distinct()
        toxic = labels.where("toxic IS NOT NULL").select(F.col(id_col).cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).join(present, "id", "left_semi").distinct().orderBy(F.xxhash64("id"), "toxic").limit(labelled_rows)
        mined = mine(rows.join(F.broadcast(toxic), "id").groupBy("id", "toxic").agg(F.min("text").alias("text")))
    voted = cut(rows.select(F.xxhash64("text").alias("key"), vote_patterns(F.col("text"), mined).alias("v")).select("key", "v.*"))
    seen = {h: {r[h]: r["count"] for r in voted.groupBy(h).count().collect()} for h in HEADS}  # at most 3 ** labellers rows
    posterior, accuracies = {}, {}
    for h in HEADS:
        posterior[h], right, _ = em(seen[h])
        accuracies[h] = right.tolist()
    spark = df.sparkSession
    # as many rows as there are patterns of votes: at most 3 ** labellers, whatever the corpus
    maps = [F.broadcast(spark.createDataFrame(list(posterior[h].items()) or [("", 0.0)], f"{h} string, p_{h} double")) for h in HEADS]
    # copies and near copies with the same votes are one example: else the idle words of a large family would tell much
    weak = cut(voted.groupBy("kin", "junk", "toxic").agg(F.min("key").alias("key")).join(maps[0], "junk").join(maps[1], "toxic").select("key", "p_junk", "p_toxic"))
    some = lambda where, n: weak.where(where).orderBy("key").limit(n)
    chosen = some("p_junk >= 0.5", train_rows).union(some("p_toxic >= 0.5", train_rows)).union(some("p_junk < 0.5 AND p_toxic < 0.5", 2 * train_rows)).dropDuplicates(["key"])

    @F.pandas_udf("array<int>")
    def slots(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t, mined) for t in texts])

    picked = rows.withColumn("key", F.xxhash64("text")).join(F.broadcast(chosen), "key").groupBy("key").agg(F.min("text").alias("text"), *(F.first(f"p_{h}").alias(f"p_{h}") for h in HEADS))
    sample = cut(picked.select("key", slots("text").alias("x"), *(f"p_{h}" for h in HEADS)))
    used = telling(sample)
    # only telling slots reach the driver: a bounded number of rows, each with a few of them
    long = sample.select("key", F.explode("x").alias("slot")).join(used, "slot")
    kept = long.groupBy("key").agg(*(F.array_sort(F.collect_list(F.when(F.col(h), F.col("slot")))).alias(h) for h in HEADS))
    none = F.array().cast("array<int>")
    got = sample.join(kept, "key", "left").select("key", *(F.coalesce(h, none).alias(h) for h in HEADS), *(f"p_{h}" for h in HEADS)).toArrow().sort_by("key")
    heads = {h: train([(x.values.to_numpy().astype(np.int64), p) for x, p in zip(got[h], got[f"p_{h}"].to_pylist())]) for h in HEADS}
    return Model(heads, accuracies, mined)


def classify(df: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with the columns junk_score, toxic_score (log-odds) and keep (both 0 or less).

    Null and empty texts hold no sign of either and stay. Rows are never lost or repeated; equal texts have equal
    scores. Columns of those three names are replaced, all others stay.
    """
    model = fit(df, labels, id_col, text_col)
    out = df.drop("junk_score", "toxic_score", "keep").withColumn("__s", model.scores(F.col(text_col)))
    out = out.withColumns({"junk_score": F.col("__s.junk"), "toxic_score": F.col("__s.toxic")}).drop("__s")
    return out.withColumn("keep", (F.col("junk_score") <= 0) & (F.col("toxic_score") <= 0))


def keep_good(df: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that classify keeps, with all columns as they are, those named as its scores too."""
    scored = df.withColumn("__quality", fit(df, labels, id_col, text_col).scores(F.col(text_col)))
    return scored.where("__quality.junk <= 0 AND __quality.toxic <= 0").drop("__quality")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both scores of every document and whether it stays; null and empty texts stay, repeated rows have equal scores, a table
    without rows gives none. The labels serve to mine insults."""
    out = classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.round("junk_score", 6).alias("junk_score"), F.round("toxic_score", 6).alias("toxic_score"), "keep")

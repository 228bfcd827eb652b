"""Ridge regression with cross-validation, and bootstrap intervals of its test score."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .sampling import draw, numbered

#: A grid of 25 penalties over ten decades, ten folds, four fifths for training.
PENALTIES = tuple(10 ** (-10 + 10 * k / 24) for k in range(25))
FOLDS, TRAIN_SHARE = 10, 0.8
RESAMPLES = 1000


def uniform(seed: int, *keys: str):
    """A number in [0, 1) that depends on the seed and the keys alone."""
    return F.conv(F.substring(draw(seed, *keys), 1, 12), 16, 10).cast("double") / float(16**12)


def moments(df: DataFrame, fold: str, features: str, label: str) -> dict[int, np.ndarray]:
    """Per fold the sums of products of (1, features, label). Partitions add up theirs, then Spark does; the driver gets one
    square of the number of features per fold, however many rows there are."""

    def products(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for rows in parts:
            for k, part in rows.groupby("fold"):
                z = np.column_stack([np.ones(len(part)), np.stack([np.asarray(v, float) for v in part["x"]]), part["y"].to_numpy(float)])
                held[k] = held.get(k, 0) + z.T @ z
        yield pd.DataFrame({"fold": list(held), "m": [m.ravel() for m in held.values()]})

    slim = df.select(F.col(fold).cast("int").alias("fold"), F.col(features).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"))
    sums = slim.mapInPandas(products, "fold int, m array<double>").select("fold", F.posexplode("m").alias("at", "v")).groupBy("fold", "at").agg(F.sum("v").alias("v"))
    rows = sums.toPandas().sort_values(["fold", "at"])
    return {int(k): part["v"].to_numpy().reshape(2 * (int(len(part) ** 0.5),)) for k, part in rows.groupby("fold")}


def ridge_path(m: np.ndarray, penalties: Sequence[float]) -> np.ndarray:
    """(penalty, 1 + features): intercept and weights of the ridge regressions on the rows behind the moments m, by one
    eigendecomposition. The intercept is free, and a penalty counts in units of the label's standard deviation."""
    n = m[0, 0]
    mean = m[0, 1:] / n
    cov = m[1:, 1:] / n - np.outer(mean, mean)
    values, axes = np.linalg.eigh(cov[:-1, :-1])
    values, sd = np.maximum(values, 0.0), np.sqrt(max(cov[-1, -1], 0.0))
    turned = axes.T @ cov[:-1, -1]
    out = []
    for p in penalties:
        by = values + (p / sd if sd else 0.0)
        w = axes @ np.where(by > 1e-300, turned / np.maximum(by, 1e-300), 0.0)
        out.append(np.r_[mean[-1] - w @ mean[:-1], w])
    return np.array(out)


def best_ridge(per: dict[int, np.ndarray], penalties: Sequence[float]) -> tuple[np.ndarray, float]:
    """(intercept and weights for predictors as they are, the best penalty) from the moments of each fold of the training part.

    Predictors are standardised on the training part; the penalty with the least cross-validated squared error, the largest
    of equals, is fitted on all of it.
    """
    whole = sum(per.values())
    n = whole[0, 0]
    mean = whole[0, 1:-1] / n
    sd = np.sqrt(np.maximum(np.diag(whole)[1:-1] - n * mean**2, 0.0) / max(n - 1, 1))
    scale = np.where(sd > 0, 1 / np.where(sd > 0, sd, 1), 0.0)
    to = np.diag(np.r_[1.0, scale, 1.0])  # products of standardised predictors: to.T @ m @ to
    to[0, 1:-1] = -mean * scale
    standard = lambda m: to.T @ m @ to
    errors = np.zeros(len(penalties))
    for m in per.values():
        if n > m[0, 0]:
            v = np.column_stack([ridge_path(standard(whole - m), penalties), -np.ones(len(penalties))])
            errors += np.einsum("pi,ij,pj->p", v, standard(m), v)
    best = min(range(len(penalties)), key=lambda k: (errors[k], -penalties[k]))
    w = ridge_path(standard(whole), [penalties[best]])[0]
    return np.r_[w[0] - (w[1:] * scale) @ mean, w[1:] * scale], penalties[best]


def ridge_cv(df: DataFrame, label: str, features: str, key: str, seed: int = 1984, penalties: Sequence[float] = PENALTIES, folds: int = FOLDS) -> tuple[DataFrame, float]:
    """(test rows with label and prediction, the best penalty).

    The split and the folds depend on keys and seed alone. Rows with a null go. One pass over the training rows gives the
    moments of all folds, from which every fold and penalty is fitted and scored.
    """
    data = df.where(F.col(label).isNotNull() & F.col(features).isNotNull()).select(key, F.col(label).cast("double").alias("label"), F.col(features).cast("array<double>").alias("x"), uniform(seed, key).alias("__u"), F.floor(uniform(seed + 1, key) * folds).cast("int").alias("__fold"))
    train, test = data.where(F.col("__u") < TRAIN_SHARE), data.where(F.col("__u") >= TRAIN_SHARE)
    per = moments(train, "__fold", "x", "label")
    if not per:
        return test.where(F.lit(False)).select(key, "label", F.lit(0.0).alias("prediction")), max(penalties)
    w, penalty = best_ridge(per, penalties)
    sums = F.aggregate(F.zip_with("x", F.array(*(F.lit(float(x)) for x in w[1:])), lambda x, y: x * y), F.lit(float(w[0])), lambda s, x: s + x)
    return test.select(key, "label", sums.alias("prediction")), penalty


def masked_moments(df: DataFrame, labels: Sequence[str]) -> dict[tuple[int, int], np.ndarray]:
    """moments for several labels at once, from rows of fold, x and labels: (fold, label's place) -> sums over the rows where it is
    not null. Rows with the same labels given share one product; partitions hand on upper triangles, which Spark adds up."""
    names = list(labels)

    def products(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for rows in parts:
            if not len(rows):
                continue
            x, y, fold = np.stack([np.asarray(v, float) for v in rows["x"]]), rows[names].to_numpy(float), rows["fold"].to_numpy()
            there = ~np.isnan(y)
            z, d = np.column_stack([np.ones(len(x)), x, np.where(there, y, 0.0)]), x.shape[1] + 1
            _, kind = np.unique(np.column_stack([fold, there]), axis=0, return_inverse=True)
            for k in range(kind.max() + 1):
                mine = np.flatnonzero(kind.ravel() == k)
                gram = z[mine].T @ z[mine]
                for t in np.flatnonzero(there[mine[0]]):
                    at, cell = np.r_[0:d, d + t], (int(fold[mine[0]]), int(t))
                    held[cell] = held.get(cell, 0) + gram[np.ix_(at, at)]
        for (k, t), m in held.items():  # one at a time, since each may be large
            yield pd.DataFrame({"fold": [k], "label": [t], "m": [m[np.triu_indices(len(m))]]})

    sums = df.select("fold", "x", *names).mapInPandas(products, "fold int, label int, m array<double>")
    sums = sums.select("fold", "label", F.posexplode("m").alias("at", "v")).groupBy("fold", "label", "at").agg(F.sum("v").alias("v"))
    out = {}
    for cell, part in sums.toPandas().sort_values(["fold", "label", "at"]).groupby(["fold", "label"]):
        width = int(((8 * len(part) + 1) ** 0.5 - 1) / 2)
        m = np.zeros((width, width))
        m[np.triu_indices(width)] = part["v"]
        out[tuple(map(int, cell))] = m + np.triu(m, 1).T
    return out


def ridge_grid(df: DataFrame, labels: Sequence[str], sets: dict[str, Sequence[int]], features: str, key: str, seed: int = 1984, penalties: Sequence[float] = PENALTIES, folds: int = FOLDS) -> DataFrame:
    """(key, word_property, data, penalty, label, prediction): test rows of every label under every feature set, a set being places
    in the array of features. Each cell equals ridge_cv on its columns.

    One pass over the training rows, whatever the number of cells, and one over the test rows. Rows without features go, and
    rows with a null label are left out for that label alone. The driver holds, per fold and label, one square of the number of
    features.
    """
    names = [f"y{t}" for t in range(len(labels))]
    data = df.where(F.col(features).isNotNull()).select(key, F.col(features).cast("array<double>").alias("x"), *(F.col(c).cast("double").alias(n) for c, n in zip(labels, names)), uniform(seed, key).alias("__u"), F.floor(uniform(seed + 1, key) * folds).cast("int").alias("fold"))
    per = masked_moments(data.where(F.col("__u") < TRAIN_SHARE), names)
    cells, weights = [], []
    for t, prop in enumerate(labels):
        mine = {k: m for (k, u), m in per.items() if u == t}
        for name, places in sets.items():
            if mine:
                at = [0, *(p + 1 for p in places), -1]
                w, penalty = best_ridge({k: m[np.ix_(at, at)] for k, m in mine.items()}, penalties)
                wide = np.zeros(len(next(iter(mine.values()))) - 1)
                wide[at[:-1]] = w
                cells.append((t, prop, name, float(penalty)))
                weights.append(wide)

    def predict(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            if not len(rows):
                continue
            x = np.stack([np.asarray(v, float) for v in rows["x"]])
            for (t, prop, name, penalty), w in zip(cells, weights):
                y = rows[f"y{t}"].to_numpy(float)
                there = ~np.isnan(y)
                yield pd.DataFrame({key: rows[key][there], "word_property": prop, "data": name, "penalty": penalty, "label": y[there], "prediction": w[0] + x[there] @ w[1:]})

    test = data.where(F.col("__u") >= TRAIN_SHARE).select(key, "x", *names)
    return test.mapInPandas(predict, f"`{key}` {dict(df.dtypes)[key]}, word_property string, data string, penalty double, label double, prediction double")


def r_squared(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Squared correlation of label and prediction."""
    return df.groupBy(*by).agg(F.pow(F.corr("label", "prediction"), F.lit(2)).alias("rsq"))


#: Rows of which one task step draws the copies, for all resamples at once.
DRAW_BLOCK = 2048


def drawn_copies(rows: int, block: int, resamples: int, seed: int, size: int = DRAW_BLOCK) -> np.ndarray:
    """(resamples, rows of the block): how often each row of the block is drawn, where every resample draws ``rows`` of the table's rows
    with replacement.

    The draws are halved over the blocks by binomials along a tree, each seeded by its node, so any task finds its block's share
    alone, and the shares of all blocks add up to ``rows``; within the block they are dealt out evenly.
    """
    low, high = 0, -(-rows // size)
    left = np.full(resamples, rows)
    held = lambda a, b: min(b * size, rows) - a * size
    while high - low > 1:
        middle = (low + high) // 2
        first = np.random.default_rng([seed, low, high]).binomial(left, held(low, middle) / held(low, high))
        left, low, high = (first, low, middle) if block < middle else (left - first, middle, high)
    here = held(low, high)
    return np.random.default_rng([seed, low, high]).multinomial(left, np.full(here, 1 / here))


def resample_sums(predictions: DataFrame, key: str, resamples: int, seed: int, by: Sequence[str] = (), size: int = DRAW_BLOCK) -> DataFrame:
    """(by, b, n, x, y, xx, yy, xy): sums over label x and prediction y of each resample of exactly as many rows as the group has.

    Rows are numbered by key within their group; a block of them is drawn from at a time, so neither a group's size nor the
    number of resamples decides what a task holds, and results do not depend on partitioning.
    """
    slim = predictions.where("label IS NOT NULL AND prediction IS NOT NULL").select(*by, F.col(key).alias("__key"), "label", "prediction")
    ranked = numbered(slim, *by, "__key", "label", "prediction")
    groups = ranked.groupBy(*by).agg(F.min("rn").alias("__first"), F.count("*").alias("__rows"))
    same = None
    for c in by:  # groups may be null
        same = F.col(f"g.{c}").eqNullSafe(F.col(f"r.{c}")) if same is None else same & F.col(f"g.{c}").eqNullSafe(F.col(f"r.{c}"))
    both = ranked.alias("r").join(groups.alias("g"), same if by else F.lit(True)).select(*(F.col(f"r.{c}") for c in by), "label", "prediction", "__rows", (F.col("rn") - F.col("__first")).alias("__at"))
    blocks = both.withColumn("__block", F.floor(F.col("__at") / size))

    def sums(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__at")
        copies = drawn_copies(int(rows["__rows"].iloc[0]), int(rows["__block"].iloc[0]), resamples, seed, size)
        x, y = rows["label"].to_numpy(), rows["prediction"].to_numpy()
        total = copies @ np.column_stack([np.ones(len(x)), x, y, x * x, y * y, x * y])
        out = pd.DataFrame(total, columns=["n", "x", "y", "xx", "yy", "xy"])
        out.insert(0, "b", np.arange(1, resamples + 1))
        for c in reversed(by):
            out.insert(0, c, rows[c].iloc[0])
        return out

    kinds = dict(predictions.dtypes)
    parts = blocks.groupBy(*by, "__block").applyInPandas(sums, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "b long", *(f"{c} double" for c in ("n", "x", "y", "xx", "yy", "xy"))]))
    return parts.groupBy(*by, "b").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")))


def bootstrap_rsq(predictions: DataFrame, key: str, resamples: int = RESAMPLES, alpha: float = 0.05, seed: int = 1984, by: Sequence[str] = ()) -> DataFrame:
    """(by, rsq, ci_lower, ci_upper): squared correlation and its percentile interval over resamples, per group."""
    s = resample_sums(predictions, key, resamples, seed, by)
    cov, vx, vy = F.col("n") * F.col("xy") - F.col("x") * F.col("y"), F.col("n") * F.col("xx") - F.col("x") * F.col("x"), F.col("n") * F.col("yy") - F.col("y") * F.col("y")
    per = s.select(*by, F.when((vx > 0) & (vy > 0), cov * cov / (vx * vy)).alias("r2"))
    ends = per.groupBy(*by).agg(F.percentile("r2", F.lit(alpha / 2)).alias("ci_lower"), F.percentile("r2", F.lit(1 - alpha / 2)).alias("ci_upper"))
    scores = r_squared(predictions, by)
    return scores.join(ends, list(by)) if by else scores.join(F.broadcast(ends))  # one row each


def ridge_table(df: DataFrame, labels: Sequence[str], sets: dict[str, Sequence[int]], features: str, key: str, resamples: int = RESAMPLES, **options) -> DataFrame:
    """(word_property, data, rsq, ci_lower, ci_upper) for each label and feature set."""
    predictions = stored(ridge_grid(df, labels, sets, features, key, **options))
    return bootstrap_rsq(predictions, key, resamples, by=["word_property", "data"])

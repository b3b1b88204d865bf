"""Parameter search over tree ensembles where draws share fits.

Every prefix of a forest or of boosted rounds is itself a model, and so is every tree cut off at a smaller depth of a forest. So
draws that differ only in the number of trees or rounds (and, for forests, in depth) share one fit of the largest size on
each fold. Fits run side by side, one per task, on the counted cells of all rows (``cells``); rows held out
by the fold go down the trees with the others at weight 0, so every prefix is scored as it grows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.ml import cells, metrics, trees

#: Parameters of which all smaller values come with the largest.
NESTED = {"forest": ("numTrees", "maxDepth"), "boosting": ("maxIter",)}
# Defaults of the library's estimators.
DEFAULTS = {
    "forest": {"numTrees": 20, "maxDepth": 5, "maxBins": 32, "minInstancesPerNode": 1, "subsamplingRate": 1.0, "featureSubsetStrategy": "sqrt"},
    "boosting": {"maxIter": 20, "maxDepth": 5, "maxBins": 32, "minInstancesPerNode": 1, "subsamplingRate": 1.0, "featureSubsetStrategy": "all", "stepSize": 0.1}}
# End of fixed values.


def grid_draws(grid: dict[str, Sequence]) -> list[dict]:
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def binned(x: np.ndarray, bins: int) -> np.ndarray:
    """Numbers of at most ``bins`` bins per column; a column with few values has one bin for each."""
    out = np.empty(x.shape, dtype=np.uint16)
    for j in range(x.shape[1]):
        values, counts = np.unique(x[:, j], return_counts=True)
        if len(values) > bins:
            places = np.searchsorted(np.cumsum(counts), np.arange(1, bins) * len(x) / bins)
            values = values[np.unique(np.minimum(places, len(values) - 1))]
        out[:, j] = np.searchsorted(values, x[:, j])
    return out


def features_used(strategy: str | float, n: int) -> int:
    named = {"all": n, "sqrt": int(np.ceil(np.sqrt(n))), "auto": int(np.ceil(np.sqrt(n))), "onethird": int(np.ceil(n / 3)), "log2": max(1, int(np.ceil(np.log2(n))))}
    if strategy in named:
        return named[strategy]
    return max(1, min(n, int(np.ceil(float(strategy) * n))))


def levels(x: np.ndarray, target: np.ndarray, weight: np.ndarray, depth: int, least: float, used: int, rng: np.random.Generator,
           nodes: list[dict] | None = None, squares: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """The prediction for every row after 0, 1, ... ``depth`` levels of one tree of least squares.

    For 0/1 targets that is the tree of least Gini impurity. Rows of weight 0 are led along and change nothing. ``nodes`` takes
    the nodes of each level, where those that split lead to two nodes each of the next, in order; ``squares`` are
    weighted sums of squared targets for it.
    """
    n, f = x.shape
    columns = [np.asarray(x[:, j], dtype=np.int64) for j in range(f)]
    bins = [int(c.max(initial=0)) + 1 for c in columns]
    weights, moments = weight, weight * target
    mean = np.full(n, moments.sum() / max(weight.sum(), 1e-300))
    yield mean
    seen, at, k = np.arange(n), np.zeros(n, dtype=np.int64), 1   # rows whose node may still be split, and their nodes
    for level in range(depth + 1):
        if nodes is not None and (k or not level):
            wt, st = np.bincount(at, weights, k), np.bincount(at, moments, k)
            nodes.append({"weight": wt, "sum": st, "squares": np.bincount(at, squares[seen], k), "feature": np.full(k, -1), "cut": np.zeros(k, int), "gain": np.full(k, -1.0)})
        if level == depth:
            return
        if not k:
            yield mean
            continue
        picked = np.argsort(np.argsort(rng.random((k, f)), axis=1), axis=1) < used if used < f else None
        top, cut, lw, ls = np.empty((f, k)), np.empty((f, k), dtype=np.int64), np.empty((f, k)), np.empty((f, k))
        every = np.arange(k)
        for j, c in enumerate(columns):
            flat = at * bins[j]
            flat += c
            wl = np.cumsum(np.bincount(flat, weights, k * bins[j]).reshape(k, -1), axis=1)
            sl = np.cumsum(np.bincount(flat, moments, k * bins[j]).reshape(k, -1), axis=1)
            wt, st = wl[:, -1].copy(), sl[:, -1].copy()
            wr, sr = wt[:, None] - wl, st[:, None] - sl
            valid = (wl >= max(least, 1e-9)) & (wr >= max(least, 1e-9))
            if picked is not None:
                valid &= picked[:, j, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = sl * sl / wl
                sr *= sr
                sr /= wr
                gain += sr
            gain[~valid] = -np.inf
            cut[j] = gain.argmax(axis=1)
            top[j], lw[j], ls[j] = gain[every, cut[j]], wl[every, cut[j]], sl[every, cut[j]]
        feature = top.argmax(axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            won = top[feature, every] - st * st / wt
        split = won > 1e-9 * np.maximum(1.0, wt)
        cut, lw, ls = cut[feature, every], lw[feature, every], ls[feature, every]
        if nodes is not None:
            nodes[-1]["feature"], nodes[-1]["cut"] = np.where(split, feature, -1), np.where(split, cut, 0)
            nodes[-1]["gain"] = np.where(split, won / np.maximum(wt, 1e-300), -1.0)
        if not split.all():
            kept = split[at]
            seen, at, weights, moments, columns = seen[kept], at[kept], weights[kept], moments[kept], [c[kept] for c in columns]
        right, its, limit = np.zeros(len(at), dtype=bool), feature[at], cut[at]
        for j, c in enumerate(columns):
            right |= (its == j) & (c > limit)
        at = 2 * (np.cumsum(split) - 1)[at] + right
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.stack([ls / lw, (st - ls) / (wt - lw)], axis=1)[split].ravel()
        k = len(value)
        mean = mean.copy()
        mean[seen] = value[at]
        yield mean


def auc(y: np.ndarray, score: np.ndarray, n: np.ndarray | None = None) -> float:
    """Of ``n`` rows an entry, by their share ``y`` of class 1. Equal scores count one half; 0.5 where a class is missing."""
    n = np.ones(len(y)) if n is None else n
    up = y * n
    positives, negatives = up.sum(), (n - up).sum()
    if positives <= 0 or negatives <= 0:
        return 0.5
    _, which = np.unique(score, return_inverse=True)
    below = np.bincount(which, n - up)
    return float((np.bincount(which, up) * (np.cumsum(below) - below / 2)).sum() / (positives * negatives))


def classes(y: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of class 1 and 0 by entry, of ``train`` rows with a share ``y`` of class 1."""
    rows = train.astype(np.int64)
    up = np.rint(y * rows).astype(np.int64)
    return up, rows - up


def forest_tree(x: np.ndarray, up: np.ndarray, down: np.ndarray, p: dict, depth: int, rng: np.random.Generator, nodes: list[dict] | None = None) -> Iterator[np.ndarray]:
    """``levels`` of one tree on a bootstrap: a sum of n Poisson draws of a rate is one of n times the rate."""
    one, none = ((rng.poisson(p["subsamplingRate"] * c) if p.get("bootstrap", True) else c).astype(float) for c in (up, down))
    weight = one + none
    return levels(x, np.divide(one, weight, out=np.zeros(len(x)), where=weight > 0), weight, depth, p["minInstancesPerNode"],
                  features_used(p["featureSubsetStrategy"], x.shape[1]), rng, nodes, one)


def forest_scores(x: np.ndarray, y: np.ndarray, train: np.ndarray, p: dict, trees: set[int], depths: set[int], rng: np.random.Generator) -> Iterator[tuple[int, int, np.ndarray]]:
    """(trees, depth, score of every entry) for every wanted size, from one forest of the largest, fitted on ``train`` rows an entry."""
    total = {d: np.zeros(len(y)) for d in depths}
    up, down = classes(y, train)
    for t in range(1, max(trees) + 1):
        for d, mean in enumerate(forest_tree(x, up, down, p, max(depths), rng)):
            if d in total:
                total[d] += mean
        if t in trees:
            yield from ((t, d, total[d] / t) for d in depths)


def boosted_rounds(x: np.ndarray, up: np.ndarray, down: np.ndarray, p: dict, rounds: int, rng: np.random.Generator, nodes: list[list[dict]] | None = None) -> Iterator[np.ndarray]:
    """The margin of every entry after each round; log loss on labels of -1 and 1. Of n equal rows a binomial number joins a round."""
    margin, used = np.zeros(len(x)), features_used(p["featureSubsetStrategy"], x.shape[1])
    for t in range(rounds):
        one, none = (rng.binomial(c, p["subsamplingRate"]) if p["subsamplingRate"] < 1 else c for c in (up, down))
        lift = np.ones(len(x)) if t == 0 else 4 / (1 + np.exp(np.clip(2 * margin, -500, 500)))
        drop = np.ones(len(x)) if t == 0 else 4 - lift
        weight, grown = (one + none).astype(float), None if nodes is None else []
        target = np.divide(one * lift - none * drop, weight, out=np.zeros(len(x)), where=weight > 0)
        squares = None if nodes is None else one * lift ** 2 + none * drop ** 2
        *_, mean = levels(x, target, weight, p["maxDepth"], p["minInstancesPerNode"], used, rng, grown, squares)
        margin = margin + (mean if t == 0 else p["stepSize"] * mean)
        if nodes is not None:
            nodes.append(grown)
        yield margin


def boosted_scores(x: np.ndarray, y: np.ndarray, train: np.ndarray, p: dict, rounds: set[int], rng: np.random.Generator) -> Iterator[tuple[int, np.ndarray]]:
    """(rounds, margin of every entry) for every wanted number of rounds, from one run of the longest, fitted on ``train`` rows an entry."""
    for t, margin in enumerate(boosted_rounds(x, *classes(y, train), p, max(rounds), rng), 1):
        if t in rounds:
            yield t, margin


def single(p: dict, kind: str) -> dict:
    """What a forest of one tree differs in: as in Spark, it sees every row once, and every feature unless told otherwise."""
    if kind != "forest" or p["numTrees"] > 1:
        return {}
    strategy = p["featureSubsetStrategy"]
    return {"bootstrap": False, "featureSubsetStrategy": "all" if strategy in ("auto", DEFAULTS[kind]["featureSubsetStrategy"]) else strategy}


def shared_fits(draws: Sequence[dict], kind: str) -> list[tuple[dict, list[int]]]:
    """Draws gathered by all that is not nested: (those parameters, numbers of the draws)."""
    out: dict[tuple, tuple[dict, list[int]]] = {}
    for i, draw in enumerate(draws):
        unknown = set(draw) - set(DEFAULTS[kind])
        if unknown:
            raise ValueError(f"cannot search over {sorted(unknown)}")
        whole = DEFAULTS[kind] | draw
        own = {k: v for k, v in (whole | single(whole, kind)).items() if k not in NESTED[kind]}
        out.setdefault(tuple(sorted((k, str(v)) for k, v in own.items())), (own, []))[1].append(i)
    return list(out.values())


def nested_search(df: DataFrame, label: str, features: Sequence[str], draws: Sequence[dict], kind: str, folds: int = 5, seed: int = 42,
                  counted: cells.Counted | None = None) -> DataFrame:
    """(draw, auc): the cross-validated AUC of every parameter draw of a ``forest`` or of ``boosting``, over all rows of ``df``.

    Trees on bins tell rows of a cell apart by their class only, so the fits go over counted cells (``counted``, made here if not
    given), and each row of a cell falls into a fold by chance. What goes to the tasks is bounded by the cells that the bins cut,
    however many rows there are; where they cut too many, Spark fits each draw and fold over the rows. Rows with a null label or
    feature do not count. One task per fold and set of draws that share a fit, the longest first; equal draws get equal values.
    """
    spark = df.sparkSession
    every = [DEFAULTS[kind] | d for d in draws]
    shared = shared_fits(draws, kind)
    if counted is None:
        counted = cells.count(df, label, features, {p["maxBins"] for p in every})
    if counted is None:
        return plain_search(df, label, features, draws, kind, folds, seed)
    up, down = (np.random.default_rng([seed, c]).multinomial(n, [1 / folds] * folds) for c, n in enumerate((counted.up, counted.down)))
    tables = {b: cells.merged(counted.bins(b), np.hstack([up, down])) for b in {p["maxBins"] for p in every}}
    work = [np.prod([max(every[i][name] for i in members) for name in ("numTrees", "maxIter", "maxDepth") if name in every[members[0]]]) * len(tables[p["maxBins"]][0])
            for p, members in shared]
    tasks = [(g, f) for g in sorted(range(len(shared)), key=lambda g: -work[g]) for f in range(folds)]
    sent = spark.sparkContext.broadcast((tables, shared, tasks, every))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables, shared, tasks, every = sent.value
        for b in batches:
            for task in b["id"]:
                g, f = tasks[task]
                p, members = shared[g]
                x, rows = tables[p["maxBins"]]
                x, rng, others = np.asfortranarray(x, dtype=np.int64), np.random.default_rng([seed, f, g]), [i for i in range(folds) if i != f]
                held, up = rows[:, [f, folds + f]], rows[:, others].sum(axis=1)
                train = up + rows[:, [folds + i for i in others]].sum(axis=1)
                y, told = up / np.maximum(train, 1), held.sum(axis=1)
                share = held[:, 0] / np.maximum(told, 1)
                wanted = [every[i] for i in members]
                if kind == "forest":
                    sizes = forest_scores(x, y, train, p, {d["numTrees"] for d in wanted}, {d["maxDepth"] for d in wanted}, rng)
                    found = {(t, d): auc(share, s, told) for t, d, s in sizes}
                    values = [found[d["numTrees"], d["maxDepth"]] for d in wanted]
                else:
                    found = {t: auc(share, s, told) for t, s in boosted_scores(x, y, train, p, {d["maxIter"] for d in wanted}, rng)}
                    values = [found[d["maxIter"]] for d in wanted]
                yield pd.DataFrame({"draw": np.array(members, dtype=np.int32), "fold": np.int32(f), "auc": values})

    scores = spark.range(0, len(tasks), 1, len(tasks)).mapInPandas(fit, "draw int, fold int, auc double")
    return scores.groupBy("draw").agg(F.avg("auc").alias("auc"))


#: Spark's estimator of each kind.
ESTIMATORS = {"forest": RandomForestClassifier, "boosting": GBTClassifier}


def plain_search(df: DataFrame, label: str, features: Sequence[str], draws: Sequence[dict], kind: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """``nested_search`` by Spark's own fits, one after the other over all rows: bounded in memory, with a fit for each draw and fold."""
    spark = df.sparkSession
    names = [f"x{i}" for i in range(len(features))]
    rows = df.select(F.col(label).cast("double").alias("y"), *[F.col(c).cast("double").alias(n) for c, n in zip(features, names)]).na.drop() \
        .withColumn("fold", (F.rand(seed) * folds).cast("int")).persist()
    out = []
    try:
        for i, draw in enumerate(draws):
            estimator = ESTIMATORS[kind](labelCol="y", featuresCol="features", seed=seed)
            estimator.setParams(**draw)
            stages = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), estimator])
            for f in range(folds):
                scored = trees.with_probability(stages.fit(rows.filter(F.col("fold") != f)), rows.filter(F.col("fold") == f), "p")
                found = metrics.auc_exact(scored, "y", "p").first()["auc"]
                out.append((i, 0.5 if found is None else float(found)))
    finally:
        rows.unpersist()
    return spark.createDataFrame(out, "draw int, auc double").groupBy("draw").agg(F.avg("auc").alias("auc"))


def grown(tree: int, nodes: list[dict], kind: str, thresholds: list[np.ndarray]) -> pd.DataFrame:
    """The nodes of ``levels`` as rows in the form of Spark's own tree files, numbered level by level."""
    out, start = [], 0
    for level in nodes:
        k, split = len(level["weight"]), level["feature"] >= 0
        left = np.where(split, start + k + 2 * (np.cumsum(split) - 1), -1)
        w, s = np.maximum(level["weight"], 1e-300), level["sum"]
        if kind == "forest":
            up = s / w
            prediction, impurity, gain = (up > 0.5).astype(float), 2 * up * (1 - up), np.where(split, 2 * level["gain"], -1.0)
            stats = np.stack([level["weight"] - s, s], axis=1)
        else:
            prediction, impurity, gain = s / w, np.maximum(level["squares"] / w - (s / w) ** 2, 0.0), level["gain"]
            stats = np.stack([level["weight"], s, level["squares"]], axis=1)
        out.append(pd.DataFrame({
            "tree": np.int32(tree), "id": np.arange(start, start + k, dtype=np.int32), "prediction": prediction, "impurity": impurity, "stats": list(stats),
            "cover": np.rint(level["weight"]).astype(np.int64), "gain": gain, "left": left.astype(np.int32), "right": np.where(split, left + 1, -1).astype(np.int32),
            "feature": level["feature"].astype(np.int32),
            "threshold": [thresholds[f][c] if f >= 0 else None for f, c in zip(level["feature"], level["cut"])]}))
        start += k
    return pd.concat(out)


def fitted(counted: cells.Counted, p: dict, kind: str, spark, seed: int = 42, factors: Sequence[float] | None = None) -> DataFrame:
    """The trees of one model of ``kind`` with the parameters ``p`` on all rows, a row each node (``grown``). The trees of a forest are dealt over
    tasks; boosted rounds follow one another in one. ``factors`` are what the pipeline multiplies the features by."""
    x, rows = cells.merged(counted.bins(p["maxBins"]), np.stack([counted.up, counted.down], axis=1))
    by = [1.0] * len(counted.cuts) if factors is None else factors
    sent = spark.sparkContext.broadcast((x, rows, [c * by[j] for j, c in enumerate(counted.at(p["maxBins"]))]))
    whole = p | single(p, kind)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, rows, thresholds = sent.value
        x = np.asfortranarray(x, dtype=np.int64)
        for b in batches:
            for t in b["id"]:
                if kind == "forest":
                    nodes: list[dict] = []
                    for _ in forest_tree(x, rows[:, 0], rows[:, 1], whole, whole["maxDepth"], np.random.default_rng([seed, t]), nodes):
                        pass
                    yield grown(t, nodes, kind, thresholds)
                else:
                    rounds: list[list[dict]] = []
                    for i, _ in enumerate(boosted_rounds(x, rows[:, 0], rows[:, 1], whole, whole["maxIter"], np.random.default_rng(seed), rounds)):
                        yield grown(i, rounds.pop(), kind, thresholds)

    n = whole["numTrees"] if kind == "forest" else 1
    return spark.range(0, n, 1, min(n, 4 * spark.sparkContext.defaultParallelism)).mapInPandas(
        fit, "tree int, id int, prediction double, impurity double, stats array<double>, cover bigint, gain double, left int, right int, feature int, threshold double")


def best_draw(search: DataFrame) -> int:
    """The draw with the highest AUC, the first of equal ones. The sums of a draw may differ in their last digits by order."""
    return search.orderBy(F.round("auc", 12).desc(), "draw").first()["draw"]

"""Fitted tree ensembles as arrays: scores and exact Shapley values in Arrow batches, one row in and one row out."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import scratch_path

#: Cells (rows x leaves x features of a path) worked on at once.
CELLS = 1_000_000

#: Cells that a table of an ensemble's scores may have, and leaves x corners that a table of Shapley values may take; larger
#: ensembles are walked tree by tree, with the same results.
TABLE, CORNERS = 1 << 20, 1 << 26


@dataclass
class Leaves:
    """The leaves of one tree: the distinct features of each path with the interval (low, high] that leads to the leaf and
    the share of the training rows that went along (padded with intervals that hold everything), and the leaf's value."""

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray


@dataclass
class Trees:
    """Nodes by tree: ``feature`` is -1 at leaves; ``value`` already carries the tree's weight. ``vote`` and ``against`` are a
    classifying forest's shares of classes 1 and 0."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    features: int
    vote: np.ndarray | None = None
    against: np.ndarray | None = None

    def score(self, x: np.ndarray, value: np.ndarray | None = None, block: int = 16_384) -> np.ndarray:
        """Sum of the leaves' values (or of other ``value`` by node), by row; a leaf leads to itself until the deepest path has ended."""
        value = self.value if value is None else value
        trees, nodes = self.feature.shape
        leaf = self.feature < 0
        feature = np.where(leaf, 0, self.feature)
        down = np.stack([np.where(leaf, np.arange(nodes), self.right), np.where(leaf, np.arange(nodes), self.left)], axis=2).reshape(trees, -1)
        out = np.zeros(len(x))
        for lo in range(0, len(x), block):
            values = np.ascontiguousarray(x[lo:lo + block]).ravel()
            start = np.arange(0, len(values), x.shape[1])
            for t in range(trees):
                at = np.zeros(len(start), dtype=np.int64)
                while True:
                    goes_left = values.take(start + feature[t].take(at)) <= self.threshold[t].take(at)
                    below = down[t].take(2 * at + goes_left)
                    if (below == at).all():
                        break
                    at = below
                out[lo:lo + block] += value[t].take(at)
        return out

    def leaves(self, t: int) -> Leaves:
        paths = []

        def walk(node: int, path: dict[int, tuple[float, float, float]]) -> None:
            f = int(self.feature[t, node])
            if f < 0:
                paths.append((path, self.value[t, node]))
                return
            low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
            cut = float(self.threshold[t, node])
            for child, a, b in ((self.left[t, node], low, min(high, cut)), (self.right[t, node], max(low, cut), high)):
                walk(int(child), path | {f: (a, b, share * float(self.cover[t, child] / self.cover[t, node]))})

        walk(0, {})
        width = max(1, max(len(p) for p, _ in paths))
        shape = (len(paths), width)
        out = Leaves(np.zeros(shape, np.int64), np.full(shape, -np.inf), np.full(shape, np.inf), np.ones(shape), np.array([v for _, v in paths]))
        for i, (path, _) in enumerate(paths):
            for d, (f, (low, high, share)) in enumerate(sorted(path.items())):
                out.feature[i, d], out.low[i, d], out.high[i, d], out.share[i, d] = f, low, high, share
        return out

    def expected(self) -> float:
        """The score when no feature is known: every branch weighs by the training rows it saw."""
        return float(sum((leaf.value * leaf.share.prod(axis=1)).sum() for leaf in map(self.leaves, range(len(self.feature)))))


@dataclass
class Table:
    """What an ensemble gives in every cell of the grid that its thresholds cut, so a row costs a search a feature and one look-up."""

    cuts: list[np.ndarray]
    values: np.ndarray

    def at(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        """The values in the cells of points, given by feature: x <= threshold leads left, so a feature's place is its number of thresholds below x.

        A few thresholds are compared one by one, which costs less than a search.
        """
        cell = np.zeros(columns[0].shape, dtype=np.int64)
        for x, c in zip(columns, self.cuts):
            if len(c) > 64:
                cell *= len(c) + 1
                cell += np.searchsorted(c, x)
            elif len(c):
                left, above = np.empty(x.shape, dtype=bool), np.full(x.shape, len(c), dtype=np.uint8)
                for cut in c:
                    above -= np.less_equal(x, cut, out=left).view(np.uint8)
                cell *= len(c) + 1
                cell += above
        return self.values.take(cell, axis=0)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.at(np.ascontiguousarray(x.T))


def grid(trees: Trees) -> list[np.ndarray] | None:
    """The thresholds by feature; None if they cut more than ``TABLE`` cells."""
    cuts = [np.unique(trees.threshold[trees.feature == j]) for j in range(trees.features)]
    return cuts if np.prod([len(c) + 1.0 for c in cuts]) <= TABLE else None


def corner_points(cuts: list[np.ndarray]) -> np.ndarray:
    """A row of each cell, in the order of cells."""
    axes = np.meshgrid(*[np.append(c, np.inf) if len(c) else np.zeros(1) for c in cuts], indexing="ij")
    return np.stack([a.ravel() for a in axes], axis=1)


def shapley_table(trees: Trees, every: list[Leaves]) -> Table | None:
    """Scores (first column) and exact Shapley values of every cell; None if the grid is too large.

    The score that is expected when the features of a set are known is a sum over leaves of boxes on the grid of these features. Boxes are put
    down by their corners and summed along the axes, once for each set.
    """
    cuts = grid(trees)
    if cuts is None:
        return None
    used = [j for j, c in enumerate(cuts) if len(c)]
    k, n = len(used), sum(len(leaf.value) for leaf in every)
    sizes = [len(cuts[j]) + 1 for j in used]
    if n * 3 ** k > CORNERS or 2 ** k * int(np.prod(sizes)) > CORNERS:
        return None
    value = np.concatenate([leaf.value for leaf in every])
    low, high, share = (np.full((n, trees.features), x) for x in (-np.inf, np.inf, 1.0))
    start = 0
    for leaf in every:
        stop, (rows, width) = start + len(leaf.value), leaf.feature.shape
        at = np.repeat(np.arange(start, stop), width), leaf.feature.ravel()
        given = np.isfinite(leaf.low.ravel()) | np.isfinite(leaf.high.ravel())   # the rest are padding
        for out, part in ((low, leaf.low), (high, leaf.high), (share, leaf.share)):
            out[at[0][given], at[1][given]] = part.ravel()[given]
        start = stop
    first = [np.where(np.isinf(low[:, j]), 0, np.searchsorted(cuts[j], low[:, j], "right")) for j in used]
    end = [np.where(np.isinf(high[:, j]), len(cuts[j]) + 1, np.searchsorted(cuts[j], high[:, j], "right")) for j in used]
    end = [np.maximum(a, b) for a, b in zip(first, end)]   # a path that contradicts itself holds nothing
    told = {}
    for known in product((False, True), repeat=k):
        weight, shape = value.copy(), [size + 1 if on else 1 for size, on in zip(sizes, known)]
        for i, on in enumerate(known):
            if not on:
                weight *= share[:, used[i]]
        put = np.zeros(int(np.prod(shape)))
        for corner in product(*[((first[i], 1.0), (end[i], -1.0)) if on else ((None, 1.0),) for i, on in enumerate(known)]):
            at = np.zeros(n, dtype=np.int64)
            for (place, _), size in zip(corner, shape):
                at = at * size + (0 if place is None else place)
            put += np.prod([sign for _, sign in corner]) * np.bincount(at, weight, len(put))
        put = put.reshape(shape)
        for i, on in enumerate(known):
            if on:
                put = np.cumsum(put, axis=i).take(np.arange(sizes[i]), axis=i)
        told[known] = put
    values = np.zeros((int(np.prod(sizes)), 1 + trees.features))
    values[:, 0] = trees.score(corner_points(cuts))
    for i, j in enumerate(used):
        phi = np.zeros(sizes)
        for known, without in told.items():
            if not known[i]:
                m = sum(known)
                phi += factorial(m) * factorial(k - m - 1) / factorial(k) * (told[known[:i] + (True,) + known[i + 1:]] - without)
        values[:, 1 + j] = phi.ravel()
    return Table(cuts, values)


def shapley(every: list[Leaves], features: int, x: np.ndarray) -> np.ndarray:
    """Exact path-dependent Shapley values, by row and feature.

    For one leaf the score is a product over its features: o (0 or 1: the row stays on the path) if the feature is known, z (the
    share that went along) if not. Its Shapley value for feature i is value (o_i - z_i) times the integral over t in [0, 1] of
    the product of (1 - t) z_j + t o_j over the other features, a polynomial that a Gauss-Legendre rule integrates exactly.
    A padded entry has o = z = 1 and changes nothing. Work grows with rows x leaves x depth squared.
    """
    out = np.zeros((len(x), features))
    for leaf in every:
        width = leaf.feature.shape[1]
        nodes, weights = np.polynomial.legendre.leggauss((width + 1) // 2)
        add = np.zeros((leaf.feature.size, features))
        add[np.arange(leaf.feature.size), leaf.feature.ravel()] = 1.0
        step = max(1, CELLS // leaf.feature.size)
        for lo in range(0, len(x), step):
            v = x[lo:lo + step][:, leaf.feature]
            o = ((v > leaf.low) & (v <= leaf.high)).astype(float)
            total = np.zeros_like(o)
            for node, weight in zip((nodes + 1) / 2, weights / 2):
                m = (1 - node) * leaf.share + node * o
                total += weight * m.prod(axis=2, keepdims=True) / m
            total *= (o - leaf.share) * leaf.value[:, None]
            out[lo:lo + step] += total.reshape(len(o), -1) @ add
    return out


def scale_factors(scaler) -> np.ndarray:
    """What a fitted scaler without centring multiplies the features by."""
    spread = scaler.std.toArray()
    return np.where(spread > 0, 1 / np.where(spread > 0, spread, 1.0), 0.0)


def is_ensemble(model: PipelineModel) -> bool:
    """Whether ``flatten`` can read the last stage."""
    return type(model.stages[-1]).__name__ in {
        "RandomForestClassificationModel", "RandomForestRegressionModel", "GBTClassificationModel", "GBTRegressionModel"}


def flatten(model: PipelineModel, spark) -> tuple[Trees, str]:
    """The trees of the last stage, and what their values add up to: ``probability`` of class 1, ``margin`` or ``prediction``.

    Read from the model as Spark writes it. Its size follows from the number and depth of the trees, not from the data.
    Splits must be on numbers; null or NaN inputs are the assembler's to reject.
    """
    stage = model.stages[-1]
    path = scratch_path(spark, "trees")
    stage.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").selectExpr(
        "treeID AS tree", "nodeData.id AS id", "nodeData.prediction AS prediction", "nodeData.impurityStats AS stats", "nodeData.rawCount AS cover",
        "nodeData.leftChild AS left", "nodeData.rightChild AS right", "nodeData.split.featureIndex AS feature",
        "try_element_at(nodeData.split.leftCategoriesOrThreshold, 1) AS threshold", "nodeData.split.numCategories AS categories").toPandas()
    if ((nodes["feature"] >= 0) & (nodes["categories"] != -1)).any():
        raise ValueError("splits on categories are not supported")
    trees, kind = int(nodes["tree"].max()) + 1, type(stage).__name__
    if kind == "RandomForestClassificationModel":
        stats = np.stack(nodes["stats"].to_numpy())
        votes = [stats[:, 1] / stats.sum(axis=1), stats[:, 0] / stats.sum(axis=1)]
        value, target = votes[0] / trees, "probability"
    else:
        votes = []
        weights = np.array(stage.treeWeights) / (trees if kind.startswith("RandomForest") else 1)
        value, target = nodes["prediction"].to_numpy() * weights[nodes["tree"].to_numpy()], "margin" if kind == "GBTClassificationModel" else "prediction"
    at = nodes["tree"].to_numpy(), nodes["id"].to_numpy()
    shape = (trees, int(nodes["id"].max()) + 1)

    def filled(values, empty=0, dtype=float) -> np.ndarray:
        out = np.full(shape, empty, dtype=dtype)
        out[at] = values
        return out

    return Trees(filled(nodes["feature"], -1, np.int32), filled(nodes["threshold"].fillna(0.0)), filled(nodes["left"], -1, np.int32),
                 filled(nodes["right"], -1, np.int32), filled(value), filled(nodes["cover"], 1), stage.numFeatures, *map(filled, votes)), target


def shap_trees(model: PipelineModel, rows: DataFrame, id_col: str) -> DataFrame:
    """(id, score, base, contributions) per row of ``rows``: exact Shapley values of the tree ensemble.

    ``contributions`` are in the order of the assembled features and add up to ``score`` - ``base``, where ``score`` is the
    probability of class 1 of a forest, the margin of boosted classifiers (their probability is 1 / (1 + exp(-2 margin))),
    or the prediction of a regressor. Where the thresholds cut few cells, all are explained once (``shapley_table``) and rows look theirs up. Rows are prepared by the pipeline's other stages and never multiplied or shuffled.
    """
    spark = rows.sparkSession
    trees, _ = flatten(model, spark)
    every = [trees.leaves(t) for t in range(len(trees.feature))]
    base = float(sum((leaf.value * leaf.share.prod(axis=1)).sum() for leaf in every))
    table = shapley_table(trees, every)
    sent = spark.sparkContext.broadcast((trees, every, None) if table is None else (None, None, table))
    prepared = rows
    for stage in model.stages[:-1]:
        prepared = stage.transform(prepared)
    inputs = prepared.select(id_col, vector_to_array(model.stages[-1].getFeaturesCol()).alias("x"))

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees, every, table = sent.value
        for b in batches:
            if len(b):
                x = np.stack(b["x"].to_numpy())
                told = np.column_stack([trees.score(x), shapley(every, trees.features, x)]) if table is None else table(x)
                yield pd.DataFrame({id_col: b[id_col], "score": told[:, 0], "base": base, "contributions": list(told[:, 1:])})

    kind = rows.schema[id_col].dataType.simpleString()
    return inputs.mapInPandas(explain, f"`{id_col}` {kind}, score double, base double, contributions array<double>")


@dataclass
class Scorer:
    """The probability of class 1 by the trees themselves. Forests add up the votes of both classes and divide, as Spark does."""

    trees: Trees

    def __call__(self, x: np.ndarray) -> np.ndarray:
        t = self.trees
        if t.vote is None:
            return 1 - 1 / (1 + np.exp(np.clip(2 * t.score(x), -700, 700)))
        up, down = t.score(x, t.vote), t.score(x, t.against)
        return up / (up + down)


def class_scorer(model: PipelineModel, spark) -> Scorer | Table | None:
    """From inputs of the last stage (rows x features) to the probability of class 1: a look-up where the thresholds cut few
    cells, else the trees; None for a stage that is no classifier of trees."""
    if type(model.stages[-1]).__name__ not in {"RandomForestClassificationModel", "GBTClassificationModel"}:
        return None
    trees = flatten(model, spark)[0]
    cuts, score = grid(trees), Scorer(trees)
    return score if cuts is None else Table(cuts, score(corner_points(cuts)))


def with_probability(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    """``model.transform(df)`` with the probability of class 1 as ``name``; trees are scored in Arrow batches, other models by Spark.

    Columns of the transform that nothing reads are not computed.
    """
    scored, scorer = model.transform(df), class_scorer(model, df.sparkSession)
    if scorer is None:
        return scored.withColumn(name, vector_to_array("probability")[1])
    sent = df.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    def class_1(x: pd.Series) -> pd.Series:
        return pd.Series(sent.value(np.stack(x.to_numpy())) if len(x) else [], dtype=float)

    return scored.withColumn(name, class_1(vector_to_array(model.stages[-1].getFeaturesCol())))

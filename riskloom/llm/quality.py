"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees grow on binned statistics of a bounded sample of labelled documents, and are flattened into arrays, so that a
batch of documents walks down all trees with a few numpy steps per level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import labelled_sample, remainder

KEEP_AT = 0.3
_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_SYMBOLS = np.frombuffer(b"#$%&*+/<=>@[\\]^_`{|}~", dtype=np.uint8)
_MARKS = np.frombuffer(b"!\"'(),-.:;?", dtype=np.uint8)
NAMES = ["log_bytes", "log_words", "word_bytes", "upper", "digits", "symbols", "marks", "bangs", "bars", "stops", "spaces",
         "beyond_ascii", "controls", "entropy", "distinct_words", "short_words", "long_words", "log_lines", "line_bytes",
         "distinct_lines", "longest_word", "most_frequent_word", "upper_words"]


def statistics(text: str) -> list[float]:
    """The statistics of one text; all are zero for a text without characters."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    share = counts[counts > 0] / n
    words = text.split()
    tally: dict[str, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    lines = [x for x in text.split("\n") if x.strip()]
    w, ln = max(len(words), 1), max(len(lines), 1)
    return [
        np.log1p(n), np.log1p(len(words)), n / w, counts[_UPPER].sum() / n, counts[_DIGIT].sum() / n, counts[_SYMBOLS].sum() / n,
        counts[_MARKS].sum() / n, counts[33] / n, counts[124] / n, counts[46] / n, counts[32] / n, counts[128:].sum() / n,
        (counts[:32].sum() - counts[10]) / n, float(-(share * np.log2(share)).sum()), len(tally) / w,
        (lengths <= 3).sum() / w, (lengths >= 12).sum() / w, np.log1p(len(lines)), n / ln, len(set(lines)) / ln,
        float(np.log1p(lengths.max())), max(tally.values(), default=0) / w, sum(map(str.isupper, tally)) / w,
    ]


@dataclass
class Forest:
    """Flattened trees. Node k of tree t sends a row to ``left`` or ``right``; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))[None, :]
        at = np.zeros((len(x), len(self.feature)), dtype=np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            below = x[rows, self.feature[trees, at]] <= self.threshold[trees, at]
            at = np.where(below, self.left[trees, at], self.right[trees, at])
        return 1 / (1 + np.exp(-np.clip(self.base + self.value[trees, at].sum(axis=1), -60, 60)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15,
         leaf_rows: int = 10, ridge: float = 1.0) -> Forest:
    """Boost ``trees`` trees on the logistic loss. One class only, or no rows, give a forest without trees."""
    prior = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    base = float(np.log(prior / (1 - prior)))
    if len(y) == 0 or y.min() == y.max():
        none = np.zeros((0, 1))
        return Forest(none.astype(np.int64), none, none.astype(np.int64), none.astype(np.int64), none, 0, base)
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)], axis=1)
    nodes = 2 ** (depth + 1) - 1
    feature, threshold = np.zeros((trees, nodes), dtype=np.int64), np.zeros((trees, nodes))
    left, value = np.tile(np.arange(nodes), (trees, 1)), np.zeros((trees, nodes))
    right = left.copy()
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, many = 2 ** level - 1, 2 ** level
            open_rows = at >= first
            node = at[open_rows] - first
            gain, pick, cut = np.zeros(many), np.full(many, -1), np.zeros(many, dtype=np.int64)
            for j in range(width):
                slot = node * bins + binned[open_rows, j]
                sums = [np.bincount(slot, weights=v, minlength=many * bins).reshape(many, bins).cumsum(axis=1)
                        for v in (g[open_rows], h[open_rows], np.ones(len(node)))]
                (gl, hl, nl), (gt, ht, nt) = sums, [s[:, -1:] for s in sums]
                better = (gl ** 2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt ** 2 / (ht + ridge))
                better[(nl < leaf_rows) | (nt - nl < leaf_rows)] = 0
                best = better.argmax(axis=1)
                top = better[np.arange(many), best]
                won = top > gain + 1e-9
                gain[won], pick[won], cut[won] = top[won], j, best[won]
            for k in np.flatnonzero(pick >= 0):
                i = first + k
                feature[t, i], threshold[t, i] = pick[k], cuts[pick[k]][cut[k]]
                left[t, i], right[t, i] = 2 * i + 1, 2 * i + 2
                mine = np.flatnonzero(at == i)
                at[mine] = np.where(binned[mine, pick[k]] <= cut[k], 2 * i + 1, 2 * i + 2)
        gs, hs = np.bincount(at, weights=g, minlength=nodes), np.bincount(at, weights=h, minlength=nodes)
        value[t] = -rate * gs / (hs + ridge)
        margin += value[t][at]
    return Forest(feature, threshold, left, right, value, depth, base)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, label and the statistics of each text."""
    def stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"], "x": [statistics(t) for t in b["text"]]})

    return docs.mapInPandas(stats, "doc_id bigint, label int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, train_rows: Column, label: str = "quality", max_rows: int = 20_000) -> Forest:
    """Fit on at most ``max_rows`` labelled rows; only their statistics come to the driver."""
    sample = features(labelled_sample(docs, labels, label, train_rows, max_rows)).orderBy("doc_id").toPandas()
    x = np.array(sample["x"].tolist(), dtype=float).reshape(len(sample), len(NAMES))
    return grow(x, sample["label"].to_numpy(dtype=float))


def score_column(forest: Forest, text: Column) -> Column:
    """Score of a text as a column."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            x = np.array([statistics(t) for t in b], dtype=float).reshape(len(b), len(NAMES))
            yield pd.Series(forest.score(x))

    return score(F.coalesce(text, F.lit("")))


def classify(docs: DataFrame, labels: DataFrame, fold: int = 5, max_rows: int = 20_000) -> DataFrame:
    """Every row of ``docs`` with ``held_out``, ``score`` and ``predicted``.

    Rows whose id falls into fold 0 are never learnt from. A null or empty text is scored like any other (its statistics
    are zero); repeated rows are scored alike; without labels every score is one half. Columns of ``docs`` beside doc_id
    and text are dropped.
    """
    forest = train(docs, labels, remainder("doc_id", fold) != 0, max_rows=max_rows)
    return docs.select("doc_id", F.coalesce(remainder("doc_id", fold) == 0, F.lit(False)).alias("held_out"),
                       score_column(forest, F.col("text")).alias("score")) \
        .withColumn("predicted", (F.col("score") >= KEEP_AT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, fold: int = 5, max_rows: int = 20_000) -> DataFrame:
    """``docs`` without the rows the classifier rejects; columns and their order stay."""
    forest = train(docs, labels, remainder("doc_id", fold) != 0, max_rows=max_rows)
    return docs.filter(score_column(forest, F.col("text")) >= KEEP_AT)

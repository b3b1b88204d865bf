"""Toxicity: a support vector machine on a subsequence string kernel with Nystroem landmarks.

The kernel compares words by all their subsequences of three characters, contiguous or not, each weighted by its decay to
the power of the stretch it spans (of at most six characters), so a word with inserted or left-out characters stays near. The machine
learns on the words of labelled texts through their kernel with some landmark words. As its decision is linear in the
subsequences of the landmarks, it is folded into one weight per subsequence for scoring. A text is judged by its strongest
words, put on the scale of chances by a logistic fit.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import labelled_sample, pieces_of, remainder, staged

DECAY = 0.6
SPAN = 6
FLAG_AT = 0.3
#: Single characters set apart by spaces, at least three in a row, are also read as one word.
_SPACED = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")
_EDGE = ".,;:!?()[]{}<>\"'*#$%&|-_ "


def units(text: str) -> set[str]:
    """The distinct words of a text in lower case."""
    low = text.lower()
    return set(low.split()).union(s.replace(" ", "") for s in _SPACED.findall(low))


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, subsequence code, weight) of all words; equal subsequences of a word are summed.

    A word begins with a mark, so that subsequences at its start are their own.
    """
    stripped = ["^" + w.strip(_EDGE) for w in words]
    sizes = np.array([len(w) for w in stripped], dtype=np.int64)
    chars = np.frombuffer("".join(stripped).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    word = np.repeat(np.arange(len(words)), sizes)
    end = np.repeat(np.cumsum(sizes), sizes)
    place = np.arange(len(chars))
    who, code, weight = [], [], []
    for b in range(2, SPAN):
        start = place[place + b < end]
        for a in range(1, b):
            who.append(word[start])
            code.append(chars[start] << 42 | chars[start + a] << 21 | chars[start + b])
            weight.append(np.full(len(start), DECAY ** (b + 1)))
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    who, code, weight = np.concatenate(who), np.concatenate(code), np.concatenate(weight)
    order = np.lexsort((code, who))
    who, code, weight = who[order], code[order], weight[order]
    first = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (code[1:] != code[:-1])]) if len(who) else np.zeros(0, np.int64)
    return who[first], code[first], np.add.reduceat(weight, first) if len(first) else weight


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """The normalised kernel of every word of ``a`` with every word of ``b``; words of under three characters give 0."""
    (wa, ca, xa), (wb, cb, xb) = subsequences(a), subsequences(b)
    codes = np.unique(cb)
    table = np.zeros((len(codes), len(b)))
    table[np.searchsorted(codes, cb), wb] = xb
    table /= np.maximum(np.sqrt((table ** 2).sum(axis=0)), 1e-12)
    out, norm = np.zeros((len(a), len(b))), np.sqrt(np.bincount(wa, weights=xa ** 2, minlength=len(a)))
    if len(codes):
        at = np.minimum(np.searchsorted(codes, ca), len(codes) - 1)
        hit = codes[at] == ca
        for lo in range(0, int(hit.sum()), 1 << 16):
            pick = np.flatnonzero(hit)[lo:lo + (1 << 16)]
            np.add.at(out, wa[pick], table[at[pick]] * xa[pick, None])
    return out / np.maximum(norm, 1e-12)[:, None]


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge loss, by Newton steps over its active rows."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = ridge * 1e-3
    for _ in range(rounds):
        active = y * (x @ w) < 1
        xa, ca = x[active], weight[active]
        new = np.linalg.solve((xa * ca[:, None]).T @ xa + np.diag(penalty), (xa * ca[:, None]).T @ y[active])
        if np.allclose(new, w, atol=1e-10):
            break
        w = new
    return w


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (y - p) - ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


@dataclass
class Machine:
    """Weight of each subsequence (sorted codes), bias, and the logistic weights over what ``strongest`` gives."""

    codes: np.ndarray
    weights: np.ndarray
    bias: float
    scale: np.ndarray

    def decide(self, words: list[str]) -> np.ndarray:
        who, code, x = subsequences(words)
        at = np.minimum(np.searchsorted(self.codes, code), max(len(self.codes) - 1, 0))
        value = np.where(self.codes[at] == code, self.weights[at], 0.0) if len(self.codes) else np.zeros(len(code))
        norm = np.sqrt(np.bincount(who, weights=x ** 2, minlength=len(words)))
        return np.bincount(who, weights=x * value, minlength=len(words)) / np.maximum(norm, 1e-12) + self.bias

    def chance(self, strongest: np.ndarray) -> np.ndarray:
        z = np.c_[strongest, np.ones(len(strongest))] @ self.scale
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


TOP = 4
#: What is known of each text: its strongest words, the logarithms of the numbers of words and of words beyond two margins,
#: and the shares of the latter.
WIDTH = TOP + 5
MARGINS = (0.0, 0.5)


def strongest(machine: Machine, batches: Iterator[pd.Series], cache_size: int = 400_000) -> Iterator[np.ndarray]:
    """One row of WIDTH numbers per text; every distinct word is judged once per task while it is remembered."""
    known: dict[str, float] = {}
    for values in batches:
        values, rows = values.tolist(), []
        for lo, hi in pieces_of(values, 1_000_000):
            each = [units(t) for t in values[lo:hi]]
            new = list(set().union(*each).difference(known))
            if len(known) + len(new) > cache_size:
                known.clear()
                new = list(set().union(*each))
            for a in range(0, len(new), 20_000):
                known.update(zip(new[a:a + 20_000], machine.decide(new[a:a + 20_000]).tolist()))
            for words in each:
                values_of, n = sorted([known[w] for w in words]), len(words)
                top = values_of[:-TOP - 1:-1] + [machine.bias] * (TOP - n)
                over = [n - bisect_right(values_of, m) for m in MARGINS]
                rows.append((*top, np.log1p(n), *np.log1p(over), *(o / max(n, 1) for o in over)))
        yield np.array(rows, dtype=float).reshape(-1, WIDTH)


def word_counts(sample: DataFrame) -> DataFrame:
    """(word, pos, neg): in how many texts of either label each distinct word occurs."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for label, text in zip(b["label"], b["text"]):
                words = sorted(units(text))
                if words:
                    yield pd.DataFrame({"word": [w.strip(_EDGE) for w in words], "label": label})

    each = sample.select("label", "text").mapInPandas(run, "word string, label int").filter(F.length("word") >= 3)
    return each.groupBy("word").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))


def without_copies(sample: DataFrame, width: int = 5) -> DataFrame:
    """One row of those that share the smallest hash of their word shingles, under each of two hashes.

    A text copied many times would else make all its words look like marks of its label.
    """
    @F.pandas_udf("array<bigint>")
    def sketch(values: pd.Series) -> pd.Series:
        out = []
        for t in values:
            w = t.lower().split()
            shingles = [" ".join(w[i:i + width]).encode("utf-8", "surrogatepass") for i in range(max(1, len(w) - width + 1))]
            out.append([min(xxhash.xxh64_intdigest(s, seed) for s in shingles) >> 1 for seed in (1, 2)])
        return pd.Series(out)

    told = staged(sample.withColumn("sketch", sketch("text")), "sketched")
    for i in (0, 1):
        first = told.groupBy(F.col("sketch")[i].alias("s")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
        told = told.join(first, "doc_id", "left_semi")
    return told.drop("sketch")


def train(docs: DataFrame, labels: DataFrame, train_rows: Column, label: str = "toxic", max_rows: int = 12_000, landmarks: int = 128,
          max_words: int = 12_000, clear: float = 3.0) -> Machine | None:
    """Fit on at most ``max_rows`` labelled texts; at most ``max_words`` of their words, with counts, come to the driver.

    A third each are the words whose share of texts differs most between the labels, the most frequent ones, and ones drawn
    by their hash, which stand for all the rest. A word is an example of the label if its share is larger by ``clear``
    standard errors, and of the contrary else. None without texts of both labels.
    """
    sample = staged(without_copies(labelled_sample(docs, labels, label, train_rows, max_rows)), "labelled")
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return None
    p, q = F.col("pos") / n[1], F.col("neg") / n[0]
    told = staged(word_counts(sample).select("word", p.alias("p"), q.alias("q"), (
        (p - q) / F.sqrt((F.col("pos") + F.col("neg")) / (n[0] + n[1]) * (1.0 / n[1] + 1.0 / n[0]))).alias("lift")), "words")
    third, mass = max_words // 3, F.col("p") + F.col("q")
    tops = staged(told.orderBy(F.col("lift").desc(), "word").limit(third).union(told.orderBy(mass.desc(), "word").limit(third)).distinct(), "tops")
    others = told.join(F.broadcast(tops.select("word")), "word", "left_anti")   # at most two thirds of max_words
    drawn = others.orderBy(F.xxhash64("word"), "word").limit(third)
    rest = others.agg(F.sum(mass)).first()[0] or 0.0
    rows = tops.orderBy(F.col("lift").desc(), "word").toPandas()
    more = drawn.orderBy("word").toPandas()
    positive = rows["lift"].to_numpy() >= clear
    if not positive.any():
        positive[:1] = True
    weight = np.r_[np.where(positive, rows["p"], rows["p"] + rows["q"]), (more["p"] + more["q"]) * (rest / max((more["p"] + more["q"]).sum(), 1e-12))]
    weight[:len(rows)][positive] *= weight[~np.r_[positive, np.zeros(len(more), bool)]].sum() / max(weight[:len(rows)][positive].sum(), 1e-12) / 4
    words, y = rows["word"].tolist() + more["word"].tolist(), np.r_[np.where(positive, 1.0, -1.0), -np.ones(len(more))]
    frequent = rows[~positive].sort_values(["q", "word"], ascending=[False, True])["word"].tolist()
    marks = list(dict.fromkeys(rows["word"][positive].tolist()[:landmarks * 3 // 4] + frequent[:landmarks // 4]))
    # Nystroem map: kernel with the landmarks, whitened by their own kernel
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    keep = values > 1e-6
    white = vectors[:, keep] / np.sqrt(values[keep])
    w = fit_svm(kernel(words, marks) @ white, y, weight)
    # fold into one weight per subsequence of a landmark
    who, code, share = subsequences(marks)
    norm = np.sqrt(np.bincount(who, weights=share ** 2, minlength=len(marks)))
    alpha = (white @ w[:-1]) / np.maximum(norm, 1e-12)
    codes, at = np.unique(code, return_inverse=True)
    machine = Machine(codes, np.bincount(at, weights=alpha[who] * share, minlength=len(codes)), float(w[-1]), np.zeros(WIDTH + 1))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = next(strongest(machine, iter([b["text"]])))
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"], "x": list(x)})

    seen = sample.mapInPandas(judge, "doc_id bigint, label int, x array<double>").orderBy("doc_id").toPandas()
    machine.scale = fit_logistic(np.array(seen["x"].tolist()), seen["label"].to_numpy(dtype=float))
    return machine


def score_column(machine: Machine | None, text: Column) -> Column:
    """Chance of a text to be toxic; one half if there was nothing to learn from."""
    if machine is None:
        return F.when(text.isNull() | text.isNotNull(), F.lit(0.5))
    sent = machine

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in strongest(sent, batches):
            yield pd.Series(sent.chance(x))

    return score(F.coalesce(text, F.lit("")))


def classify(docs: DataFrame, labels: DataFrame, fold: int = 4, held: int = 2, max_rows: int = 12_000) -> DataFrame:
    """Every row of ``docs`` with ``held_out``, ``score`` and ``predicted``.

    Rows whose id falls into fold ``held`` are never learnt from. Null and empty texts are scored as texts without words;
    repeated rows are scored alike; without labels of both kinds every score is one half. Columns of ``docs`` beside doc_id
    and text are dropped.
    """
    machine = train(docs, labels, remainder("doc_id", fold) != held, max_rows=max_rows)
    return docs.select("doc_id", F.coalesce(remainder("doc_id", fold) == held, F.lit(False)).alias("held_out"),
                       score_column(machine, F.col("text")).alias("score")).withColumn("predicted", (F.col("score") >= FLAG_AT).cast("int"))

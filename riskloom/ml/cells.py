"""All rows of a fit on binned values, as counts: trees on bins cannot tell the rows of a cell apart but by their class."""

from __future__ import annotations

from collections.abc import Collection, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells that the bins of all features may cut; beyond it fits go over the rows.
CELLS = 1 << 22

#: Numbers are told apart by their leading bits first, then by more of them where a wanted rank lies, and at last by all.
SHIFTS = (40, 20, 0)


@dataclass
class Counted:
    """The cells of the finest cuts, with their rows of class 1 and 0; ``edges`` has the cuts by number of bins and feature.
    A bin's cut is its largest value."""

    edges: dict[int, list[np.ndarray]]
    cuts: list[np.ndarray]
    x: np.ndarray
    up: np.ndarray
    down: np.ndarray

    def at(self, bins: int) -> list[np.ndarray]:
        return self.edges[bins]

    def bins(self, bins: int) -> np.ndarray:
        """The cells by the cuts of ``bins`` bins, which are some of the finest."""
        return np.stack([np.searchsorted(coarse, np.append(fine, np.inf))[self.x[:, j]]
                         for j, (coarse, fine) in enumerate(zip(self.edges[bins], self.cuts))], axis=1).astype(np.uint16)


def merged(x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows of ``x`` in order, and the sums of their ``rows``."""
    shape = tuple(int(m) + 1 for m in x.max(axis=0, initial=0))
    code, which = np.unique(np.ravel_multi_index(tuple(x.T.astype(np.int64)), shape), return_inverse=True)
    told = np.stack([np.bincount(which, c, len(code)) for c in rows.T], axis=1).astype(np.int64)
    return np.stack(np.unravel_index(code, shape), axis=1).astype(np.uint16), told


def ordered(v: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the numbers ``v``; 0.0 and -0.0 are one."""
    k = (v + 0.0).view(np.int64)
    return k ^ ((k >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def number(k: np.ndarray) -> np.ndarray:
    return (k ^ ((k >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)


class Tally:
    """Counts by key, merged as they come."""

    def __init__(self, most: int = 1 << 20):
        self.keys, self.counts, self.pending, self.most = [], [], 0, most

    def add(self, keys: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(np.ones(len(keys)))
        self.pending += len(keys)
        if self.pending > self.most:
            self.merge()
            self.pending = 0

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys, which = np.unique(np.concatenate([np.empty(0, np.int64), *self.keys]), return_inverse=True)
        counts = np.bincount(which, np.concatenate([np.empty(0), *self.counts]), len(keys))
        self.keys, self.counts = [keys], [counts]
        return keys, counts


def _tallied(known: DataFrame, columns: int, keys) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted keys and their counts, by column; ``keys`` gives those of a batch and a column."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tallies = [Tally() for _ in range(columns)]
        for b in batches:
            for j, t in enumerate(tallies):
                t.add(keys(b, j))
        for j, t in enumerate(tallies):
            key, n = t.merge()
            for lo in range(0, len(key), 100_000):
                yield pd.DataFrame({"j": np.int32(j), "key": key[lo:lo + 100_000], "n": n[lo:lo + 100_000].astype(np.int64)})

    told = known.mapInPandas(count, "j int, key bigint, n bigint").groupBy("j", "key").agg(F.sum("n").alias("n")).toPandas().sort_values(["j", "key"])
    return [(part["key"].to_numpy(np.int64), part["n"].to_numpy(np.int64)) for part in (told[told["j"] == j] for j in range(columns))]


def _places(n: int, bins: Collection[int]) -> np.ndarray:
    """Ranks, from 1, of the values that end the bins of equal shares of ``n`` rows."""
    return np.unique(np.concatenate([np.ceil(np.arange(1, b) * n / b) for b in bins] + [[n]])).astype(np.int64)


def cuts(known: DataFrame, names: Sequence[str], bins: Collection[int], most: int | None = None) -> dict[int, list[np.ndarray]] | None:
    """The exact cuts of all rows by number of bins: values at equal shares of the rows, or all values of a column with few of them.
    None if the finest cut more than ``most`` cells (``CELLS`` unless given).

    Three passes: rows are counted by the leading bits of their value, then by more bits in those groups that a wanted rank falls in. What
    reaches the driver is bounded by the ranks and the bits of a pass.
    """
    most = CELLS if most is None else most
    limit = max(bins)
    parents: list[np.ndarray] = [np.empty(0, np.int64)] * len(names)
    before: list[np.ndarray] = [np.empty(0, np.int64)] * len(names)
    few, n = [True] * len(names), 0
    for step, shift in enumerate(SHIFTS):
        up = SHIFTS[step - 1] if step else 0

        def keys(b: pd.DataFrame, j: int, shift=shift, up=up, first=not step, parents=parents) -> np.ndarray:
            k = ordered(b[names[j]].to_numpy(np.float64))
            return (k if first else k[np.isin(k >> up, parents[j])]) >> shift

        found = _tallied(known, len(names), keys)
        n = int(found[0][1].sum()) if not step else n
        next_parents, next_before = [], []
        for j, (key, count) in enumerate(found):
            below = np.cumsum(count) - count
            if step:   # counts start anew in each parent
                parent = key >> (up - shift)
                first = np.searchsorted(parent, parents[j])
                below = below - below[first][np.searchsorted(parents[j], parent)] + before[j][np.searchsorted(parents[j], parent)]
            few[j] = few[j] and len(key) <= limit
            if few[j]:
                at = np.arange(len(key))
            else:
                ranks = _places(n, bins)
                at = np.unique(np.clip(np.searchsorted(below, ranks) - 1, 0, None))
            next_parents.append(key[at])
            next_before.append(below[at])
        if not step and np.prod([min(len(key), limit) * 1.0 for key, _ in found]) > most:
            return None
        parents, before = next_parents, next_before
    out: dict[int, list[np.ndarray]] = {}
    for b in bins:
        out[b] = []
        for j, (key, below) in enumerate(zip(parents, before)):
            if few[j] and len(key) <= b:
                out[b].append(number(key[:-1]))
            else:
                ranks = np.ceil(np.arange(1, b) * n / b) if n else np.empty(0)
                out[b].append(number(key[np.unique(np.clip(np.searchsorted(below, ranks) - 1, 0, None))]) if len(key) else np.empty(0))
    finest = [np.unique(np.concatenate([out[b][j] for b in bins])) for j in range(len(names))]
    return None if np.prod([len(c) + 1.0 for c in finest]) > most else out


def count(df: DataFrame, label: str, features: Sequence[str], bins: Collection[int]) -> Counted | None:
    """All rows of ``df`` without a null label or feature by cells; None if the bins cut more than ``CELLS`` cells."""
    names = [f"x{j}" for j in range(len(features))]
    known = df.select(F.col(label).cast("double").alias("y"), *[F.col(c).cast("double").alias(n) for c, n in zip(features, names)]).na.drop()
    edges = cuts(known, names, bins)
    if edges is None:
        return None
    finest = [np.unique(np.concatenate([edges[b][j] for b in bins])) for j in range(len(names))]
    shape = tuple(len(c) + 1 for c in finest)

    def keys(b: pd.DataFrame, _: int) -> np.ndarray:
        code = np.zeros(len(b), dtype=np.int64)
        for j, c in enumerate(finest):
            code = code * shape[j] + np.searchsorted(c, b[names[j]].to_numpy(np.float64))
        return 2 * code + (b["y"].to_numpy(np.float64) > 0.5)

    (key, n), = _tallied(known, 1, keys)
    code, which = np.unique(key // 2, return_inverse=True)
    up, down = (np.bincount(which, n * (key % 2 == c), len(code)).astype(np.int64) for c in (1, 0))
    return Counted(edges, finest, np.stack(np.unravel_index(code, shape), axis=1).astype(np.uint16), up, down)

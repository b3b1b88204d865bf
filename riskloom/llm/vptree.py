"""Nearest vectors by cosine: a vantage-point tree per shard, searched for blocks of queries.

On unit vectors the Euclidean distance is a metric and orders like the cosine. A node keeps a vantage point and the radius
that halves its points. A query skips a half when the triangle inequality, relaxed by ``factor``, shows that it cannot
hold anything nearer than the k-th found so far; factor 1 is the exact search.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import staged

#: Far above rounding of a distance in double precision, far below any difference that matters.
SLACK = 1e-7


@dataclass
class Node:
    rows: np.ndarray | None = None      # of a leaf
    vantage: int = -1
    radius: float = 0.0
    inner: Node | None = None
    outer: Node | None = None


def build(points: np.ndarray, leaf: int = 512, seed: int = 7) -> Node:
    """A tree over all rows; halves are cut by rank, so equal distances cannot unbalance it."""
    rng = np.random.default_rng(seed)

    def grow(rows: np.ndarray) -> Node:
        if len(rows) <= leaf:
            return Node(rows=rows)
        some = rng.choice(rows, size=min(8, len(rows)), replace=False)   # the vantage point whose distances spread most
        probe = rng.choice(rows, size=min(64, len(rows)), replace=False)
        v = int(some[np.argmax([np.linalg.norm(points[probe] - points[c], axis=1).std() for c in some])])
        far = np.linalg.norm(points[rows] - points[v], axis=1)
        order = np.argsort(far, kind="stable")
        half = len(rows) // 2
        return Node(None, v, float(far[order[half - 1]]), grow(rows[order[:half]]), grow(rows[order[half:]]))

    return grow(np.arange(len(points)))


class Search:
    """The k nearest ids of one shard for a block of queries; queries walk the tree together and part at its nodes.

    ``vectors`` stand for the ``ids`` listed with each. Rows within SLACK of the k-th distance are never cut by distance: their
    exact cosines and ids decide, so ties (scaled copies of a vector among them) fall to the smaller id.
    """

    def __init__(self, vectors: np.ndarray, ids: list, k: int, factor: float) -> None:
        self.vectors, self.points, self.k, self.factor = vectors, _unit(vectors), k, factor
        self.root = build(self.points)
        self.first = np.r_[0, np.cumsum([len(i) for i in ids])]
        self.ids = np.concatenate([np.asarray(i, dtype=np.int64) for i in ids])
        self.compared = 0

    def __call__(self, queries: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, cosine) of the k nearest ids of each query, its own id left out."""
        self.asked, self.q, self.own = queries, _unit(queries), own
        shape = (len(queries), self.k)
        self.far, self.score, self.found = np.full(shape, np.inf), np.full(shape, -np.inf), np.full(shape, -1, dtype=np.int64)
        self._visit(self.root, np.arange(len(queries)))
        at, place = np.nonzero(self.score > -np.inf)
        return at, self.found[at, place], self.score[at, place]

    def _take(self, who: np.ndarray, rows: np.ndarray, far: np.ndarray) -> None:
        """Pairs of a query and a row join the lists of their queries."""
        score = cosine(self.asked[who], self.vectors[rows])
        n = self.first[rows + 1] - self.first[rows]
        which = np.repeat(np.arange(len(who)), n)
        ids = self.ids[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[rows], n)]
        other = ids != self.own[who[which]]
        which, ids = which[other], ids[other]
        some = np.unique(who)
        slot = np.r_[who[which], np.repeat(some, self.k)]
        score, ids = np.r_[score[which], self.score[some].ravel()], np.r_[ids, self.found[some].ravel()]
        far = np.r_[far[which], self.far[some].ravel()]
        order = np.lexsort((ids, -score, slot))
        slot, score, ids, far = slot[order], score[order], ids[order], far[order]
        starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        place = np.arange(len(slot)) - np.repeat(starts, np.diff(np.r_[starts, len(slot)]))
        best = place < self.k
        slot, place = slot[best], place[best]
        self.score[slot, place], self.found[slot, place], self.far[slot, place] = score[best], ids[best], far[best]

    def _visit(self, node: Node, who: np.ndarray) -> None:
        if not len(who):
            return
        if node.rows is not None:
            self.compared += len(who) * len(node.rows)
            apart = np.sqrt(np.maximum(2 - 2 * self.q[who] @ self.points[node.rows].T, 0))
            limit = self.far[who].max(axis=1)
            if len(node.rows) > self.k + 1:  # one of the nearest may be the query itself
                limit = np.minimum(limit, np.partition(apart, self.k, axis=1)[:, self.k])
            a, r = np.nonzero(apart <= (limit + SLACK)[:, None])
            for lo in range(0, len(a), 100_000):
                part = slice(lo, lo + 100_000)
                self._take(who[a[part]], node.rows[r[part]], apart[a[part], r[part]])
            return
        gap = np.linalg.norm(self.q[who] - self.points[node.vantage], axis=1) - node.radius
        inside = gap <= 0
        self._visit(node.inner, who[inside])
        self._visit(node.outer, who[~inside])
        reach = self.far[who].max(axis=1) / self.factor + SLACK
        self._visit(node.outer, who[inside & (-gap <= reach)])
        self._visit(node.inner, who[~inside & (gap <= reach)])


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def cosine(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines summed from the first component to the last, so that every run gives the same digits."""
    def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.cumsum(a * b, axis=-1)[..., -1]

    return np.clip(dot(q, rows) / np.sqrt(dot(q, q) * dot(rows, rows)), -1.0, 1.0)


def search_group(group: pd.DataFrame, k: int, factor: float) -> pd.DataFrame:
    """The k nearest ids of each query (``own`` set) among the stored rows (``ids`` set) of one shard and block."""
    asks = group["own"].notna().to_numpy()
    queries, stored = group[asks], group[~asks]
    if not len(queries) or not len(stored):
        return pd.DataFrame({"query_id": np.zeros(0, "i8"), "vec_id": np.zeros(0, "i8"), "score": np.zeros(0)})
    held, asked = np.stack(stored["v"].to_numpy()), np.stack(queries["v"].to_numpy())
    own = queries["own"].to_numpy(dtype=np.int64)
    at, ids, scores = Search(held, list(stored["ids"]), k, factor)(asked, own)
    return pd.DataFrame({"query_id": own[at], "vec_id": ids, "score": scores})


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and the double-precision vector of every row that takes part: no null, zero or non-finite ones."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")) \
        .filter(ok & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, factor: float = 1.0, shard_rows: int = 32_768,
            block_queries: int = 8_192) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by ``every``, against all other rows.

    Nearest first, ties to the smaller vec_id; the score is the cosine of the original vectors in double precision. Vectors
    of another length than the query's are not candidates. A vec_id listed with several vectors asks and is found with
    each, its best score counts, and it never finds its own id. Rows are dealt by a hash of their vector, so copies share a shard; only the k + 1
    smallest ids of equal vectors enter a tree, since no query can return more. Shards hold about ``shard_rows`` distinct
    vectors, and each block of ``block_queries`` queries visits each shard once. Other columns are dropped.
    """
    rows = usable_vectors(vectors).withColumns({"width": F.size("v"), "hash": F.xxhash64("v")})
    same = ["width", "hash", "v"]
    # ids of equal vectors are thinned within each of 32 salts first, then among what the salts left
    salted = rows.groupBy(*same, F.pmod(F.xxhash64("vec_id"), F.lit(32)).alias("salt")).agg(_smallest(F.collect_set("vec_id"), k + 1).alias("ids"))
    points = staged(salted.groupBy(*same).agg(_smallest(F.array_distinct(F.flatten(F.collect_list("ids"))), k + 1).alias("ids")), "points")
    asked = staged(rows.filter(F.col("vec_id") % every == 0).select("vec_id", *same).distinct(), "asked")
    sizes = points.groupBy("width").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    blocks = asked.groupBy("width").agg(F.ceil(F.count(F.lit(1)) / block_queries).cast("int").alias("blocks"))
    deal = sizes.join(blocks, "width")
    no_ids = F.array().cast("array<bigint>")
    shard, block = F.pmod("hash", F.col("shards")).cast("int"), F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    held = points.join(deal, "width").select("width", shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                                             F.lit(None).cast("bigint").alias("own"), "ids", "v")
    sent = asked.join(deal, "width").select("width", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), block.alias("block"),
                                            F.col("vec_id").alias("own"), no_ids.alias("ids"), "v")
    found = held.unionByName(sent).groupBy("width", "shard", "block").applyInPandas(
        lambda group: search_group(group, k, factor), "query_id bigint, vec_id bigint, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _smallest(ids: Column, n: int) -> Column:
    return F.slice(F.array_sort(ids), 1, n)

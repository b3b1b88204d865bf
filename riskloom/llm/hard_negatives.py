"""Hard negatives by inner product, pruned by length and by coordinates.

Rows are dealt into shards. Within a shard, length buckets hold, for every coordinate, the list of its values on unit vectors
in order. An anchor skips a bucket whose longest vector cannot reach its threshold; in the others the threshold confines
the values of its largest (focus) coordinates, and only rows inside all those ranges are verified exactly. The threshold
is the last score an anchor would still return, so it rises from bucket to bucket.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import staged

# Fixed values of the contract: components are scaled and floored; bounds of a negative's score in hundredths of the positive's.
SCALE, LEAST, MOST = 256, 50, 95
# End of fixed values.
#: An angle more than rounding can hide.
SLACK = 1e-7
#: A bucket is read whole for anchors whose narrowest range still holds this share of it.
DENSE = 0.4


class Bucket:
    """Rows of similar length with one sorted list of values per coordinate."""

    def __init__(self, rows: np.ndarray, values: np.ndarray, lengths: np.ndarray) -> None:
        self.rows, self.longest = rows, lengths.max()
        unit = values / np.maximum(lengths, 1e-300)[:, None]
        self.order = np.argsort(unit, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(unit.T, self.order, axis=1)

    def ranges(self, units: np.ndarray, focus: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place (exclusive) of the feasible values, by anchor and focus coordinate."""
        at = np.arccos(np.clip(np.take_along_axis(units, focus, 1), -1, 1))
        reach = np.arccos(np.clip(cosine, -1, 1))[:, None] + SLACK
        low, high = np.cos(np.minimum(at + reach, np.pi)) - SLACK, np.cos(np.maximum(at - reach, 0)) + SLACK
        first, last = np.empty(focus.shape, dtype=np.int64), np.empty(focus.shape, dtype=np.int64)
        for f in np.unique(focus):
            here = focus == f
            first[here] = np.searchsorted(self.sorted[f], low[here], "left")
            last[here] = np.searchsorted(self.sorted[f], high[here], "right")
        return first, last


class Shard:
    """Vectors of integers in length buckets, longest first."""

    def __init__(self, values: np.ndarray, bucket_rows: int = 1024, focus: int = 4) -> None:
        self.values, self.focus = values, min(focus, values.shape[1])
        self.largest = float(np.abs(values).max(initial=0))
        lengths = np.sqrt((values * values).sum(axis=1)) * (1 + 1e-12)
        order = np.argsort(-lengths, kind="stable")
        self.buckets = [Bucket(r, values[r], lengths[r]) for r in np.split(order, range(bucket_rows, len(order), bucket_rows))]
        self.verified = 0

    def scores(self, anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact inner products of all anchors with the rows: floats while these cannot round, else whole numbers of any size."""
        if self.largest * float(np.abs(anchors).max(initial=0)) * anchors.shape[1] < 2 ** 53:
            return (anchors @ self.values[rows].T).astype(np.int64)
        def whole(a: np.ndarray) -> np.ndarray:
            return np.array([[int(x) for x in r] for r in a], dtype=object).reshape(a.shape)
        return whole(anchors) @ whole(self.values[rows]).T

    def pairs(self, anchors: np.ndarray, threshold):
        """(anchors, rows, scores) bucket by bucket: every pair that may reach ``threshold()`` (one value an anchor, -inf: any)."""
        lengths = np.sqrt((anchors * anchors).sum(axis=1)) * (1 + 1e-12)
        units = anchors / np.maximum(lengths, 1e-300)[:, None]
        focus = np.argsort(-np.abs(units), axis=1, kind="stable")[:, :self.focus]
        for b in self.buckets:
            need = threshold()
            longest = lengths * b.longest
            who = np.flatnonzero((need <= 0) | (longest >= need))
            if not len(who):
                continue
            cosine = np.where(need[who] > 0, need[who] / np.maximum(longest[who], 1e-300), -1.0)
            first, last = b.ranges(units[who], focus[who], cosine)
            dense = ((last - first).min(axis=1) >= DENSE * len(b.rows)) | (cosine <= 0)
            if dense.any():
                self.verified += int(dense.sum()) * len(b.rows)
                found = self.scores(anchors[who[dense]], b.rows)
                a, r = np.nonzero(found >= need[who[dense]][:, None])
                yield who[dense][a], b.rows[r], found[a, r]
            for i in np.flatnonzero(~dense):
                inside = np.zeros(len(b.rows), dtype=np.int32)
                for c, lo, hi in zip(focus[who[i]], first[i], last[i]):
                    inside[b.order[c, lo:hi]] += 1
                rows = b.rows[inside == self.focus]
                if len(rows):
                    self.verified += len(rows)
                    yield np.full(len(rows), who[i]), rows, self.scores(anchors[who[i]][None], rows)[0]


class Best:
    """The ``k`` first (score falling, id rising) of each slot, and the score a row needs to join them."""

    def __init__(self, least: np.ndarray, k: int) -> None:
        self.k, self.need = k, least.copy()
        self.slot, self.score, self.id = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = np.r_[self.slot, slot], np.r_[self.score, score], np.r_[self.id, ids]
        order = np.lexsort((ids, -score, slot)) if score.dtype != object else np.array(sorted(range(len(slot)), key=lambda i: (slot[i], -score[i], ids[i])))
        slot, score, ids = slot[order], score[order], ids[order]
        starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        place = np.arange(len(slot)) - np.repeat(starts, np.diff(np.r_[starts, len(slot)]))
        stay = place < self.k
        self.slot, self.score, self.id = slot[stay], score[stay], ids[stay]
        full = place == self.k - 1
        last = score[full].astype(float)
        if score.dtype == object:
            last = np.nextafter(last, -np.inf)  # whole numbers this large may have been rounded up
        self.need[slot[full]] = np.maximum(self.need[slot[full]], last)


def _split(group: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray] | None:
    asks = group["anchor"].notna().to_numpy()
    anchors, rows = group[asks], group[~asks]
    if not len(anchors) or not len(rows):
        return None
    return anchors, rows, np.floor(SCALE * np.stack(anchors["v"].to_numpy())), np.floor(SCALE * np.stack(rows["v"].to_numpy()))


def _long(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object:
        scores = np.array([max(-2 ** 63, min(2 ** 63 - 1, s)) for s in scores], dtype=object)
    return scores.astype(np.int64)


def positives_of(group: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` first other rows of each anchor of one shard, all of the anchors' label."""
    parts = _split(group)
    if parts is None:
        return pd.DataFrame({c: np.zeros(0, "i8") for c in ("anchor", "positive_id", "positive_score")})
    anchors, rows, asked, held = parts
    own, ids = anchors["vec_id"].to_numpy(np.int64), rows["vec_id"].to_numpy(np.int64)
    best = Best(np.full(len(own), -np.inf), k)
    for a, r, s in Shard(held).pairs(asked, lambda: best.need):
        other = (own[a] != ids[r]) & (s >= best.need[a])
        best.add(a[other], s[other], ids[r[other]])
    return pd.DataFrame({"anchor": anchors["anchor"].to_numpy(np.int64)[best.slot], "positive_id": best.id, "positive_score": _long(best.score)})


def negatives_of(group: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` first rows of another label within the bounds of each anchor's positives, of one shard."""
    parts = _split(group)
    names = ("anchor", "positive_id", "positive_score", "negative_id", "negative_score")
    if parts is None:
        return pd.DataFrame({c: np.zeros(0, "i8") for c in names})
    anchors, rows, asked, held = parts
    counts = anchors["positives"].map(len).to_numpy()
    of = np.repeat(np.arange(len(anchors)), counts)                  # a slot is an anchor and one of its positives
    slots = [p for ps in anchors["positives"] for p in ps]
    positive, score = (np.array([p[c] for p in slots], dtype=np.int64) for c in ("positive_id", "positive_score"))
    low = np.array([-(-LEAST * int(s) // 100) for s in score], dtype=float)
    high = np.array([MOST * int(s) // 100 for s in score], dtype=float)
    label, labels = anchors["label"].to_numpy(np.int64), rows["label"].to_numpy(np.int64)
    ids, best = rows["vec_id"].to_numpy(np.int64), Best(low, k)
    starts = np.r_[0, np.cumsum(counts)[:-1]]

    def need() -> np.ndarray:
        return np.minimum.reduceat(np.where(low <= high, best.need, np.inf), starts)

    for a, r, s in Shard(held).pairs(asked, need):
        other = label[a] != labels[r]
        a, r, s = a[other], r[other], s[other]
        for j in range(int(counts.max())):
            has = counts[a] > j
            slot = starts[a[has]] + j
            fits = (s[has] >= best.need[slot]) & (s[has] <= high[slot])
            best.add(slot[fits], s[has][fits], ids[r[has][fits]])
    return pd.DataFrame({"anchor": anchors["anchor"].to_numpy(np.int64)[of[best.slot]], "positive_id": positive[best.slot],
                         "positive_score": score[best.slot], "negative_id": best.id, "negative_score": _long(best.score)})


def usable_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, label and double-precision vector of the rows that take part, each once."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0").select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), v.alias("v")) \
        .filter(finite).distinct().withColumn("width", F.size("v"))


def _dealt(rows: DataFrame, anchors: DataFrame, keys: list[str], shard_rows: int, block_anchors: int) -> DataFrame:
    """Rows and anchors in one table by (keys, shard, block): a row visits every block, an anchor every shard."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    blocks = anchors.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block_anchors).cast("int").alias("blocks"))
    deal = sizes.join(blocks, keys)
    extra = [c for c in anchors.columns if c not in {"vec_id", "label", "v", "width"}]
    none = [F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in extra]
    shard = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("shards")).cast("int").alias("shard")
    block = F.pmod(F.xxhash64("anchor", F.lit(2)), F.col("blocks")).cast("int").alias("block")
    held = rows.join(deal, keys).select("width", "label", "vec_id", "v", *none, shard, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    sent = anchors.join(deal, keys).select("width", "label", "vec_id", "v", *extra,
                                           F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), block)
    return held.unionByName(sent)


def mine(vectors: DataFrame, every: int = 50, n_positives: int = 5, n_negatives: int = 3, shard_rows: int = 32_768,
         block_anchors: int = 4_096) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``vectors`` (vec_id, label, embedding).

    Components are floor(256 x); scores are exact inner products. Anchors are the rows whose vec_id is divisible by
    ``every``; an anchor's positives are its ``n_positives`` first other rows of the same label, and for each of them the
    ``n_negatives`` first rows of another label are returned whose score lies between 0.50 and 0.95 of the positive's. Higher scores come
    first, ties go to the smaller vec_id. Where there are fewer, all are returned; an anchor without positives or without
    negatives returns no row. Rows without vec_id, label or vector, with an empty vector, or with a null or non-finite component take no
    part; repeated rows count once; a vec_id under several labels or vectors is a row for each, and no row is its own id's positive. Vectors
    of another width are not compared. Inner products beyond 64 bits are ranked exactly within a shard and given as the nearest long.
    """
    rows = staged(usable_rows(vectors), "rows")
    anchors = staged(rows.filter(F.col("vec_id") % every == 0).withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    near = _dealt(rows, anchors, ["width", "label"], shard_rows, block_anchors).groupBy("width", "label", "shard", "block").applyInPandas(
        lambda g: positives_of(g, n_positives), "anchor bigint, positive_id bigint, positive_score bigint")
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(F.col("positive_score").desc(), "positive_id"))
    chosen = near.withColumn("place", rank).filter(F.col("place") <= n_positives).groupBy("anchor").agg(
        F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    asking = staged(anchors.join(chosen, "anchor"), "asking")
    far = _dealt(rows, asking, ["width"], shard_rows, block_anchors).groupBy("width", "shard", "block").applyInPandas(
        lambda g: negatives_of(g, n_negatives),
        "anchor bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    last = F.row_number().over(Window.partitionBy("anchor", "positive_id", "positive_score").orderBy(F.col("negative_score").desc(), "negative_id"))
    return far.withColumn("rank", last).filter(F.col("rank") <= n_negatives).join(
        anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

"""SimHash near-duplicates by the generalised pigeonhole principle.

With bits dealt into groups and a threshold t_g per group, where the sum of (t_g + 1) is the radius plus one, two
fingerprints within the radius agree in some group up to t_g bits. Correlated bits are put into one group, the thresholds
come from a dynamic programme over estimated candidate counts, and every candidate is verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm import jaccard
from riskloom.llm.common import may_be_among, staged, texts
from riskloom.llm.components import connected_components

BITS = 64
BLOCK = 1 << 14
#: Work of one probe row against one candidate pair.
PROBE_COST = 4.0


def fingerprint(text: str, width: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles, as a signed 64-bit integer; no word gives 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, BLOCK):
        hashes = np.fromiter((digest(b" ".join(words[i:i + width]), 42) for i in range(lo, min(lo + BLOCK, n))), dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column, width: int = 3) -> Column:
    @F.pandas_udf("bigint")
    def fp(values: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in values], dtype="int64")

    return fp(F.coalesce(text, F.lit("")))


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how often two bits are set together (all rows; 64 x 64 sums per task)."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, both = 0, np.zeros((BITS, BITS))
        for b in batches:
            bits = np.unpackbits(b["fp"].to_numpy("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n, both = n + len(b), both + (bits.T @ bits)
        i, j = np.triu_indices(BITS)
        yield pd.DataFrame({"i": np.r_[-1, i], "j": np.r_[-1, j], "n": np.r_[n, both[i, j]].astype(np.int64)})

    rows = fps.select("fp").mapInPandas(count, "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both = np.zeros((BITS, BITS))
    for r in rows:
        if r["i"] >= 0:
            both[r["i"], r["j"]] = both[r["j"], r["i"]] = r["n"]
    return next((r["n"] for r in rows if r["i"] < 0), 0), both


def group_bits(n: int, both: np.ndarray, groups: int) -> list[list[int]]:
    """Bits in ``groups`` equal shares; each share gathers the bits that correlate most with what it holds."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tie = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    left, out = list(range(BITS)), []
    for g in range(groups):
        size = -(-len(left) // (groups - g))
        mine = [max(left, key=lambda b: (tie[b, left].sum(), -b))]
        left.remove(mine[0])
        while len(mine) < size:
            mine.append(max(left, key=lambda b: (tie[b, mine].sum(), -b)))
            left.remove(mine[-1])
        out.append(sorted(mine))
    return out


def estimated_pairs(n: int, both: np.ndarray, bits: list[int], radius: int) -> float:
    """Candidate pairs of one group within ``radius``, from how often each pair of neighbouring bits takes each value.

    The chance that two rows agree is carried along the group's bits as a chain of conditional chances, so correlated
    bits count for less than independent ones.
    """
    p = np.diag(both) / n
    state = np.zeros(radius + 1)
    state[0] = 1.0
    for k, b in enumerate(bits):
        agree = p[b] ** 2 + (1 - p[b]) ** 2
        if k:
            a = bits[k - 1]
            joint = np.array([both[a, b], both[a, a] - both[a, b], both[b, b] - both[a, b], n - both[a, a] - both[b, b] + both[a, b]]) / n
            agree = min(1.0, (joint ** 2).sum() / (p[a] ** 2 + (1 - p[a]) ** 2))
        state = state * agree + np.r_[0.0, state[:-1]] * (1 - agree)
    return n * (n - 1) / 2 * float(state.sum())


def allocate(n: int, both: np.ndarray, radius: int, most_groups: int | None = None) -> tuple[list[list[int]], list[int]]:
    """Groups and thresholds of least estimated cost; threshold -1 leaves a group unprobed.

    For each number of groups a dynamic programme hands out radius + 1 units, t + 1 of them to a group with threshold t.
    """
    units, best = radius + 1, None
    for m in range(1, (most_groups or units) + 1):
        groups = group_bits(n, both, m)
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for bits in groups:
            grown: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, ts) in table.items():
                for u in range(units - used + 1):
                    add = 0.0
                    if u:
                        add = estimated_pairs(max(n, 1), both, bits, u - 1) + PROBE_COST * n * len(list(combinations(range(len(bits)), min(u - 1, len(bits)))))
                    if used + u not in grown or cost + add < grown[used + u][0]:
                        grown[used + u] = (cost + add, [*ts, u - 1])
            table = grown
        if units in table and (best is None or table[units][0] < best[0]):
            best = (*table[units], groups)
    return best[2], best[1]


def probe_masks(groups: list[list[int]], thresholds: list[int]) -> list[int]:
    """Masks of the bits compared: a group's bits less every choice of t of them."""
    masks = []
    for bits, t in zip(groups, thresholds):
        if t >= 0:
            for out in combinations(bits, min(t, len(bits))):
                masks.append(sum(1 << b for b in bits if b not in out))
    return masks


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def links(fps: DataFrame, radius: int = 2, pair_limit: int = 64) -> DataFrame:
    """(u, v): links whose components are those of all distinct fingerprints in ``fps`` within ``radius`` bits.

    Probe buckets of up to ``pair_limit`` members are compared pair by pair. Members of larger ones are linked without
    forming their pairs: each emits the points within one bit of itself, and all that share a point are linked to the
    smallest of them (two within two bits share a point, and those that share one are within two). For this ``radius``
    is at most 2.
    """
    if radius > 2:
        raise ValueError("links of large buckets are exact up to a radius of 2")
    n, both = bit_counts(fps)
    masks = probe_masks(*allocate(n, both, radius))
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])
    probes = fps.select("fp", F.posexplode(keys).alias("probe", "part"))
    sizes = probes.groupBy("probe", "part").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    shared = staged(probes.join(sizes, ["probe", "part"]), "probes")
    small = shared.filter(F.col("members") <= pair_limit)
    a, b = small.select("probe", "part", F.col("fp").alias("u")), small.select("probe", "part", F.col("fp").alias("v"))
    distance = F.bit_count(F.col("u").bitwiseXOR(F.col("v")))
    near = a.join(b, ["probe", "part"]).filter((F.col("u") < F.col("v")) & (distance <= radius)).select("u", "v")
    reach = [0, *[_signed(1 << i) for i in range(BITS)]] if radius == 2 else [0]
    large = shared.filter(F.col("members") > pair_limit).select("fp").distinct()
    if radius == 1:  # two within one bit agree after clearing one bit
        points = F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(~(1 << i) & (2 ** 64 - 1)))).alias("p")) for i in range(BITS)])
    else:
        points = F.array(*[F.struct(F.lit(0).alias("i"), F.col("fp").bitwiseXOR(F.lit(m)).alias("p")) for m in reach])
    at = large.select("fp", F.explode(points).alias("at"))
    hub = at.groupBy("at").agg(F.min("fp").alias("u"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    far = at.join(hub, "at").filter("fp != u").select("u", F.col("fp").alias("v"))
    return near.unionByName(far).distinct()


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3, pair_limit: int = 64) -> DataFrame:
    """doc_id, fp (long), component_id for every row of ``docs``.

    The component is named by the smallest doc_id that can be reached. Null and empty texts have fingerprint 0 and are
    linked like any other; rows that repeat a doc_id are kept; rows without doc_id are linked too, and a component of
    such rows only has a null name. Other columns of ``docs`` are dropped.
    """
    prints = staged(texts(docs).select("doc_id", fingerprint_column(F.col("text"), width).alias("fp")), "fingerprints")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    parts = staged(connected_components(links(distinct.select("fp"), radius, pair_limit)), "parts")
    names = parts.join(distinct.withColumnRenamed("fp", "node"), "node").groupBy("root").agg(F.min("first_id").alias("name"))
    named = parts.join(names, "root").select(F.col("node").alias("fp"), "name")
    of_fp = staged(distinct.join(named, "fp", "left").select("fp", F.coalesce("name", "first_id").alias("component_id")), "named")
    return prints.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def distinct_texts(keyed: DataFrame) -> DataFrame:
    """(text_key, text), each text of ``keyed`` (doc_id, text_key, text) once, by its row with the smallest doc_id.

    Keys are counted without texts; a text that is surely single is not shuffled.
    """
    counted = keyed.groupBy("text_key", "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rows")).alias("best")
    copied = staged(counted.groupBy("text_key").agg(F.sum("rows").alias("all"), least).filter("all > 1"), "copied")
    marked = may_be_among(keyed, "text_key", copied)
    first = marked.filter("__among").join(copied, "text_key", "left").filter(F.col("all").isNull() | F.col("doc_id").eqNullSafe(F.col("best.doc_id")))
    repeated = copied.filter("best.rows > 1").select("text_key", "best.doc_id")
    alone = first.filter(F.col("all").isNull() | (F.col("best.rows") == 1)).select("text_key", "text")
    again = may_be_among(keyed, "text_key", repeated).filter("__among").join(
        repeated.withColumnRenamed("doc_id", "best_id"), "text_key").filter(F.col("doc_id").eqNullSafe(F.col("best_id"))).select("text_key", "text").distinct()
    return staged(marked.filter("NOT __among").select("text_key", "text").unionByName(alone).unionByName(again), "texts")


def near_copies(keyed: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """(text_key, root): the component of every distinct text of ``keyed`` (doc_id, text_key, text).

    Texts are linked where their sets of ``width``-word shingles reach the Jaccard ``similarity``. Fingerprints of the sets, linked
    within two bits by the generalised pigeonhole, propose the first pairs (each text with one of its component); the exact
    prefix search finds all others, which are most of them: an edited word among some hundred changes more than two bits as
    often as not.
    """
    texts_once = distinct_texts(keyed)
    sets = jaccard.described(texts_once, similarity, width)
    double = staged(sets.groupBy("node").agg(F.count(F.lit(1)).alias("texts"), F.min("text_key").alias("one")).filter("texts > 1"), "double")
    unique = sets.join(double, "node", "left").filter(F.col("one").isNull() | (F.col("one") == F.col("text_key")))
    nodes = staged(unique.filter("n > 0").drop("one", "texts"), "nodes")
    of_fp = staged(nodes.groupBy("fp").agg(F.min("node").alias("least")), "prints")
    close = staged(connected_components(links(of_fp.select("fp"))), "close")
    top = of_fp.join(close, of_fp["fp"] == close["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))
    hubs = top.join(of_fp.select(F.col("fp").alias("root"), F.col("least").alias("u")), "root").select("fp", "u")
    first = nodes.select("node", "fp").join(hubs, "fp").filter("node <> u").select("u", F.col("node").alias("v"))
    parts = staged(jaccard.similar_sets(nodes, texts_once, first, similarity, width), "parts")
    return sets.select("text_key", "node").join(parts, "node", "left").select("text_key", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """``docs`` with one row for each component of texts whose word shingles reach the Jaccard ``similarity``.

    Of a component's rows one with the smallest doc_id stays; rows without doc_id stay only where no other does. Rows are
    told apart by doc_id and text, so other texts under the same id stay; of rows that repeat both, one stays. Texts
    without a word are alike, null counts as empty. Columns and their order stay.
    """
    key = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("text_key"))
    roots = staged(near_copies(keyed, similarity, width), "roots")
    rows = keyed.select("doc_id", "text_key").groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("rows")).join(roots, "text_key")
    rows = staged(rows, "rows")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("best")
    best = rows.groupBy("root").agg(least, F.count(F.lit(1)).alias("different")).filter("different > 1")
    stays = F.col("best").isNull() | (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key")))
    judged = rows.join(staged(best, "best"), "root", "left").select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__t"), "rows", stays.alias("stays"))
    special = staged(judged.filter("NOT stays OR rows > 1"), "special")
    whole = may_be_among(docs.withColumn("__text_key", key), "__text_key", special.select(F.col("__t").alias("__text_key")))

    def joined(which: DataFrame, how: str) -> DataFrame:
        same = (F.col("__text_key") == F.col("__t")) & F.col("doc_id").eqNullSafe(F.col("__d"))
        return whole.filter("__among").join(which.select("__d", "__t"), same, how)

    again = special.filter("stays")
    kept = whole.filter("NOT __among").unionByName(joined(special, "left_anti"))
    if not again.isEmpty():
        kept = kept.unionByName(joined(again, "left_semi").dropDuplicates(["doc_id", "__text_key"]))
    return kept.select(docs.columns)

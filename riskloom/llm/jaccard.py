"""Texts whose sets of word shingles are similar: exact search by prefixes, with fingerprints for the first links.

Sets are put in one order, rare shingles first. A pair that reaches the similarity shares a shingle of the larger set's prefix
and of the smaller one's shorter index prefix. Only prefixes, sizes and bit sketches are written; whole sets are made again
from the two texts of a candidate pair when it is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm.common import may_be_among, staged
from riskloom.llm.components import connected_components

#: Shingles set at the end of the order at most, of those in over COMMON prefixes; only speed depends on them.
MOST_COMMON, COMMON = 100_000, 32
_TURN, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


class WordHashes(dict):
    """XXH64 (seed 42) of words, remembered within a task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 50_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word, 42)
        return out


def shingle_hashes(text: str, width: int, hashes: WordHashes) -> np.ndarray:
    """A hash of each run of ``width`` words (of all words, if fewer), with A-Z in lower case."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    if not len(h):
        return h
    width = min(width, len(h))
    out = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for j in range(width):
        out = out * _TURN + h[j:len(h) - width + 1 + j]
    out ^= out >> np.uint64(33)
    return (out * _MIX) ^ (out >> np.uint64(29))


def shingle_set(text: str, width: int, hashes: WordHashes) -> np.ndarray:
    """The distinct hashes, rising, as signed integers."""
    return np.unique(shingle_hashes(text, width, hashes).view(np.int64))


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / max(1, len(a) + len(b) - shared)


def majority(shingles: np.ndarray, block: int = 1 << 14) -> int:
    """64 bits, each set if set in over half the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(shingles), block):
        ones += np.unpackbits(shingles[lo:lo + block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<i8")[0])


def spread_bits(shingles: np.ndarray) -> np.ndarray:
    """2,048 bits, or 32,768 for over 1,000 shingles, one set for each: a bit that another set lacks is a shingle it lacks."""
    size = 2048 if len(shingles) <= 1000 else 32768
    bits = np.zeros(size, dtype=np.uint8)
    bits[shingles & (size - 1)] = 1
    return np.packbits(bits, bitorder="little").view("<i8")


def prefix_sizes(n: int, similarity: float) -> tuple[int, int]:
    """How many first shingles of a set of ``n`` are looked up among smaller sets, and how many larger ones look up."""
    if not n:
        return 0, 0
    return n - int(np.ceil(similarity * n - 1e-9)) + 1, n - int(np.ceil(2 * similarity / (1 + similarity) * n - 1e-9)) + 1


def among(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which shingles are in ``common`` (sorted)."""
    if not len(common):
        return np.zeros(len(shingles), dtype=bool)
    return common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles


def ordered_prefix(shingles: np.ndarray, size: int, common: np.ndarray) -> np.ndarray:
    """The first ``size`` shingles by hash, those in ``common`` (sorted) after all others."""
    late = among(shingles, common)
    if late[:size].any():
        shingles = np.r_[shingles[~late][:size], shingles[late][:size]]
    return shingles[:size]


def by_text(make, schema: str, texts: DataFrame, rows: int = 256) -> DataFrame:
    """``make`` (sets of some texts) gives the columns of ``schema`` that follow text_key; texts are read one by one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                part = b.slice(lo, rows)
                columns = make([shingle_set(t.as_py(), width, hashes) for t in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, columns.values())], ["text_key", *columns])
            b = part = columns = None
            pa.default_memory_pool().release_unused()  # what a worker holds counts for later stages too

    width = make.width
    return texts.select("text_key", "text").mapInArrow(run, f"text_key binary, {schema}")


def frequent(tokens: DataFrame) -> np.ndarray:
    """The most frequent of ``tokens``, rising; at most MOST_COMMON come to the driver."""
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > COMMON)
    rows = counts.orderBy(F.desc("m"), "token").limit(MOST_COMMON).collect()
    return np.sort(np.array([r["token"] for r in rows], dtype=np.int64))


def common_shingles(texts: DataFrame, similarity: float, width: int) -> np.ndarray:
    """The most frequent shingles of all prefixes by hash."""
    def make(sets: list[np.ndarray]) -> dict:
        return {"prefix": [s[:prefix_sizes(len(s), similarity)[0]] for s in sets]}

    make.width = width
    return frequent(by_text(make, "prefix array<bigint>", texts).select(F.explode("prefix").alias("token")))


def ordered_sets(texts: DataFrame, common: np.ndarray, similarity: float, width: int) -> DataFrame:
    """``described`` for one order; also how many shingles of the prefix are not in ``common``, and whether the order changed it."""
    sent = texts.sparkSession.sparkContext.broadcast(common)

    def make(sets: list[np.ndarray]) -> dict:
        sizes = [prefix_sizes(len(s), similarity) for s in sets]
        prefixes = [ordered_prefix(s, p, sent.value) for s, (p, _) in zip(sets, sizes)]
        return {"node": np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], dtype="<u8").view("<i8"),
                "n": np.array([len(s) for s in sets], dtype=np.int32), "short": np.array([q for _, q in sizes], dtype=np.int32),
                "fp": np.array([majority(s) for s in sets], dtype=np.int64), "bits": [spread_bits(s) for s in sets], "prefix": prefixes,
                "rare": np.array([len(p) - among(p, sent.value).sum() for p in prefixes], dtype=np.int32),
                "moved": np.array([not np.array_equal(p, s[:len(p)]) for s, p in zip(sets, prefixes)], dtype=bool)}

    make.width = width
    return by_text(make, "node bigint, n int, short int, fp bigint, bits array<bigint>, prefix array<bigint>, rare int, moved boolean", texts)


def described(texts: DataFrame, similarity: float, width: int, rounds: int = 4) -> DataFrame:
    """text_key, node (a hash of the set), n, short (index prefix), fp, bits, prefix for every row of ``texts`` (text_key, text).

    Shingles set at the end make room for others that may be as common, as in a text of many near copies. These are set at the
    end too, in some rounds, and all prefixes that hold one are made again, so there is one order for all.
    """
    common = common_shingles(texts, similarity, width)
    first = staged(ordered_sets(texts, common, similarity, width), "sets")
    out, changed, keys = first, first.filter("moved"), None
    for _ in range(rounds):
        new = frequent(changed.select(F.explode(F.slice("prefix", F.lit(1), F.col("rare"))).alias("token")))
        if not len(new):
            break
        common = np.union1d(common, new)
        late = texts.sparkSession.createDataFrame(pa.table({"token": new}))
        held = out.select("text_key", F.explode("prefix").alias("token")).join(F.broadcast(late), "token").select("text_key")
        keys = staged((held.unionByName(keys) if keys else held).distinct(), "reordered")
        again = may_be_among(texts, "text_key", keys).filter("__among").select("text_key", "text")
        changed = staged(ordered_sets(again, common, similarity, width), "sets-again")
        out = may_be_among(first, "text_key", keys).filter("NOT __among").drop("__among").unionByName(changed)
    return out.drop("rare", "moved")


def alike(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, similarity: float, width: int) -> DataFrame:
    """Those of ``pairs`` (u, v) that reach the similarity: sketches first, then the sets of both texts."""
    small = [nodes.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"b{k}"), F.col("text_key").alias(f"t{k}")) for k in "uv"]
    lacking = F.zip_with("bu", "bv", lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y))))
    alone = F.when(F.size("bu") == F.size("bv"), F.aggregate(lacking, F.lit(0), lambda x, y: x + y)).otherwise(0)
    enough = F.col("nu") - alone >= similarity / (1 + similarity) * (F.col("nu") + F.col("nv")) - 1e-9
    near = staged(pairs.distinct().join(small[0], "u").join(small[1], "v").filter(enough).select("u", "v", "tu", "tv"), "pairs")
    needed = staged(near.select(F.explode(F.array("tu", "tv")).alias("text_key")).distinct(), "needed")
    used = may_be_among(texts, "text_key", needed).filter("__among").drop("__among").join(needed, "text_key")
    a = used.select(F.col("text_key").alias("tu"), F.col("text").alias("x"))
    b = used.select(F.col("text_key").alias("tv"), F.col("text").alias("y"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, held = WordHashes(), None, None
        for batch in batches:
            reach = []
            for x, y in zip(batch.column(2), batch.column(3)):
                text = x.as_py()
                if text != last:
                    last, held = text, shingle_set(text, width, hashes)
                reach.append(similarity_of(held, shingle_set(y.as_py(), width, hashes)) >= similarity - 1e-12)
            yield batch.select(["u", "v"]).filter(pa.array(reach, pa.bool_()))
            batch = None
            pa.default_memory_pool().release_unused()

    return near.join(a, "tu").join(b, "tv").select("u", "v", "x", "y").mapInArrow(verify, "u bigint, v bigint")


def similar_sets(nodes: DataFrame, texts: DataFrame, first: DataFrame, similarity: float, width: int, pair_limit: int = 64) -> DataFrame:
    """(node, root): components of the sets of ``nodes`` that reach the similarity.

    ``first`` holds pairs (u, v) worth a look before all others, such as near fingerprints; what they link need not be compared
    again. Members of prefix buckets of over ``pair_limit`` sets are then compared with one of them, and last every pair of
    a shared prefix shingle that is not in one component yet, about once however many shingles it shares.
    """
    edges = staged(alike(first, nodes, texts, similarity, width), "first-links")
    parts = staged(connected_components(edges), "parts")
    posts = nodes.select("node", "n", "short", F.posexplode("prefix").alias("place", "token")).withColumn("indexed", F.col("place") < F.col("short"))
    sizes = posts.groupBy("token").agg(F.count(F.lit(1)).alias("members"), F.bool_or("indexed").alias("any")).filter("members > 1 AND any")
    known = staged(sizes.select("token", "members"), "sizes")
    met = may_be_among(posts.drop("short"), "token", known).filter("__among").drop("__among")
    shared = staged(met.join(known, "token"), "posts")  # most shingles are in one text only, and stay where they are

    def labelled() -> DataFrame:
        return shared.join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def open_buckets(rows: DataFrame) -> DataFrame:
        several = rows.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
        return rows.join(several.select("token"), "token", "left_semi")

    def first_of_alike(rows: DataFrame) -> DataFrame:
        """Open buckets, and of those with the same members only the one that is first in the order: all their pairs meet there."""
        members = [F.count(F.lit(1)).alias("m"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y"), F.sum("place").alias("at")]
        several = rows.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), *members).filter("lo <> hi")
        return rows.join(several.groupBy("m", "x", "y").agg(F.min_by("token", "at").alias("token")).select("token"), "token", "left_semi")

    def near(n: str, m: str) -> Column:
        return F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9

    def first_shared() -> Column:
        """Whether what follows the shared shingle in both sets could suffice; if not, the pair meets at an earlier one or is unlike."""
        return F.least(F.col("n") - F.col("place"), F.col("m") - F.col("at")) >= similarity / (1 + similarity) * (F.col("n") + F.col("m")) - 1e-9

    def overlap_left() -> Column:
        """Whether the bits that one set alone has leave enough shingles to share."""
        def alone(x: str, y: str) -> Column:
            return sum((F.bit_count(F.get(x, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(y, F.lit(i))))) for i in range(1, 8)),
                       F.bit_count(F.get(x, F.lit(0)).bitwiseAND(F.bitwise_not(F.get(y, F.lit(0))))))

        need = similarity / (1 + similarity) * (F.col("n") + F.col("m")) - 1e-9
        return (F.col("n") - alone("fold", "held") >= need) & (F.col("m") - alone("held", "fold") >= need)

    rows = open_buckets(labelled().filter(F.col("members") > pair_limit))
    hub = F.min_by(F.struct(F.col("node").alias("u"), F.col("n").alias("m"), F.col("root").alias("top")), F.struct("place", F.xxhash64("node")))  # with the fewest rare shingles
    hubs = rows.groupBy("token").agg(hub.alias("hub")).select("token", "hub.*")
    pairs = rows.join(hubs, "token").filter((F.col("root") != F.col("top")) & near("n", "m")).select("u", F.col("node").alias("v"))
    edges = staged(edges.unionByName(alike(pairs, nodes, texts, similarity, width)), "hub-links")
    parts = staged(connected_components(edges), "parts")

    # a pair that is too unlike falls away in the join itself, by 512 bits a set
    folded = nodes.select("node", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.aggregate(
        F.filter("bits", lambda _, k: k % 8 == i), F.lit(0).cast("bigint"), lambda a, w: a.bitwiseOR(w))).alias("fold"))
    # a pair is given at one shared shingle, not at all of them: not where one of the last few before it is shared too
    before = Window.partitionBy("node").orderBy("place").rowsBetween(-4, -1)
    rows = first_of_alike(labelled()).withColumn("before", F.collect_list("token").over(before))
    rows = staged(rows.join(folded, "node"), "open")
    smaller = rows.filter("indexed").select("token", F.col("node").alias("u"), F.col("n").alias("m"), F.col("root").alias("top"), F.col("place").alias("at"),
                                            F.col("fold").alias("held"), F.col("before").alias("earlier"))
    after = (F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("u") < F.col("node")))
    worth = after & (F.col("top") != F.col("root")) & near("n", "m") & first_shared() & ~F.arrays_overlap("before", "earlier") & overlap_left()
    pairs = smaller.join(rows, "token").filter(worth).select("u", F.col("node").alias("v"))
    return connected_components(edges.unionByName(alike(pairs, nodes, texts, similarity, width)))

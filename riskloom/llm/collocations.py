"""Phrases whose words occur together more often than their parts suggest, counted by an FM-index per shard.

A shard is the words of one language held by a task, as numbers, with a separator wherever a phrase may not go on. Its
index keeps the symbols before (and, for the reversed text, after) all positions in the order of their first ``depth`` symbols,
which is all that intervals of patterns up to that length depend on. Patterns grow one word a level, to the left and to the
right in turn, by splitting their intervals by the neighbouring symbols; counts are summed across shards, and only patterns
whose parts are frequent over all shards grow further.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import staged

# Fixed values of the contract: characters no phrase goes across, and those between words.
CUTS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
NO_LANGUAGE = "und"
# End of fixed values.
SEPARATOR = 0
TO_TOKENS = bytes.maketrans(CUTS + BLANKS, b"\n" * len(CUTS) + b" " * len(BLANKS))
#: Bits of the table of frequent phrases that goes to all tasks (16 MB), whatever the size of the input.
FILTER_BITS = 1 << 27


@dataclass
class Intervals:
    """Patterns as rows of word numbers with their places in the order of the text and of the reversed text."""

    words: np.ndarray
    low: np.ndarray
    reverse_low: np.ndarray
    count: np.ndarray

    def take(self, keep: np.ndarray) -> Intervals:
        return Intervals(self.words[keep], self.low[keep], self.reverse_low[keep], self.count[keep])


class OneWay:
    """BWT of one reading direction; ``places`` holds first places and ranks of all symbols in one rising row."""

    def __init__(self, text: np.ndarray, symbols: int, depth: int) -> None:
        self.symbols, n = symbols, len(text)
        bits = max(1, int(symbols - 1).bit_length())
        key = text.astype(np.int64)  # the first ``depth`` symbols, packed
        used, at = bits, 1
        while at < depth:
            if used + bits > 63:
                _, key = np.unique(key, return_inverse=True)
                used = max(1, int(n).bit_length())
            key = key << bits | np.roll(text, -at)
            used, at = used + bits, at + 1
        self.bwt = text[np.argsort(key) - 1]

    @cached_property
    def places(self) -> np.ndarray:
        """symbol * n + place in the BWT, rising."""
        return np.sort(self.bwt.astype(np.int64) * (len(self.bwt) + 1) + np.arange(len(self.bwt)))

    def before(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where ``symbol`` followed by what begins at ``place`` comes first: smaller symbols, and the symbol's rank there."""
        return np.searchsorted(self.places, symbol.astype(np.int64) * (len(self.bwt) + 1) + place)

    def split(self, low: np.ndarray, count: np.ndarray, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(interval, symbol, count, how many symbols of the interval are smaller) for each interval's neighbouring symbols.

        Intervals are taken some at a time, about ``block`` places together, so that the work space stays small.
        """
        ends = np.cumsum(count)
        cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(block, ends[-1] if len(ends) else 0, block)), len(low)])
        parts = [self._split(lo, low[lo:hi], count[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:])]
        if not parts:
            return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _split(self, offset: int, low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        which = np.repeat(np.arange(len(low)), count)
        at = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        key, n = np.unique(which * self.symbols + self.bwt[at], return_counts=True)
        which, symbol = np.divmod(key, self.symbols)
        smaller = np.cumsum(n) - n
        starts = np.flatnonzero(np.r_[True, which[1:] != which[:-1]]) if len(which) else np.zeros(0, dtype=np.int64)
        smaller -= np.repeat(smaller[starts], np.diff(np.r_[starts, len(which)]))
        return which + offset, symbol.astype(np.int32), n, smaller


class Index:
    """Bidirectional FM-index of a text of numbers; number 0 separates."""

    def __init__(self, text: np.ndarray, symbols: int, depth: int = 3) -> None:
        self.symbols, self.text, self.depth = symbols, text, depth

    @cached_property
    def forward(self) -> OneWay:
        return OneWay(self.text, self.symbols, self.depth)

    @cached_property
    def backward(self) -> OneWay:
        return OneWay(self.text[::-1], self.symbols, self.depth)

    def words(self) -> Intervals:
        """All words."""
        n = np.bincount(self.text, minlength=self.symbols)
        first = np.cumsum(n) - n
        w = np.flatnonzero(n)
        w = w[w != SEPARATOR]
        return Intervals(w[:, None], first[w], first[w], n[w])

    def extend_left(self, p: Intervals, again: bool = True) -> Intervals:
        """Patterns with one word more before them; without ``again``, they can grow to the right only."""
        which, symbol, n, smaller = self.forward.split(p.low, p.count)
        real = symbol != SEPARATOR
        which, symbol, n, smaller = which[real], symbol[real], n[real], smaller[real]
        low = self.forward.before(symbol, p.low[which]) if again else np.full(len(n), -1)
        return Intervals(np.c_[symbol, p.words[which]], low, p.reverse_low[which] + smaller, n)

    def extend_right(self, p: Intervals, again: bool = True) -> Intervals:
        """Patterns with one word more after them; without ``again``, they can grow to the left only."""
        which, symbol, n, smaller = self.backward.split(p.reverse_low, p.count)
        real = symbol != SEPARATOR
        which, symbol, n, smaller = which[real], symbol[real], n[real], smaller[real]
        low = self.backward.before(symbol, p.reverse_low[which]) if again else np.full(len(n), -1)
        return Intervals(np.c_[p.words[which], symbol], p.low[which] + smaller, low, n)


def mixed(hashes: list, shift, rotate):
    """One 64-bit hash of a sequence of word hashes: each is turned before the next is added bit by bit."""
    out = hashes[0]
    for h in hashes[1:]:
        out = shift(rotate(out), h)
    return out


def slots(hashes: np.ndarray, words: np.ndarray, bits: int) -> np.ndarray:
    """Places of patterns (rows of word numbers) in the table of frequent ones."""
    h = mixed([hashes[c] for c in words.T], np.bitwise_xor, lambda x: (x << np.uint64(7)) | (x >> np.uint64(57)))
    return (h & np.uint64(bits - 1)).astype(np.int64)


def slot_column(words: Column, length: int, bits: int) -> Column:
    """The same places in Spark."""
    h = mixed([F.xxhash64("lang", words[i]) for i in range(length)], lambda x, y: x.bitwiseXOR(y),
              lambda x: F.shiftleft(x, 7).bitwiseOR(F.shiftrightunsigned(x, 57)))
    return h.bitwiseAND(F.lit(bits - 1))


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    """Spark's xxhash64(lang, word)."""
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 42)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words))


class Numbers(dict):
    """Words numbered from 1 as they come; the separator is 0, and -1 stands for nothing."""

    def __init__(self) -> None:
        super().__init__({b"": -1, b"\n": SEPARATOR})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) - 1
        return n


class Words:
    """The words of one language that a task holds."""

    def __init__(self) -> None:
        self.numbers, self.parts, self.held = Numbers(), [], 0

    def add(self, text: str) -> None:
        """A-Z count as lower case; characters that end a phrase, and the end of the text, separate."""
        spaced = text.encode("utf-8", "surrogatepass").lower().translate(TO_TOKENS).replace(b"\n", b" \n ") + b" \n"
        found = spaced.split(b" ")
        coded = np.fromiter(map(self.numbers.__getitem__, found), dtype=np.int32, count=len(found))
        self.parts.append(coded[coded >= 0])
        self.held += len(self.parts[-1])

    def index(self, depth: int) -> tuple[list[bytes], Index]:
        return list(self.numbers)[2:], Index(np.concatenate(self.parts), len(self.numbers) - 1, depth)


def shards(batches: Iterator[pa.RecordBatch], shard_words: int) -> Iterator[tuple[str, Words]]:
    """A task's texts as shards of one language and about ``shard_words`` words.

    A text is never cut, so one longer than that is a shard of its own size. All languages together hold half as many words
    more at most before the largest shard is closed.
    """
    held: dict[str, Words] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            words = held.setdefault(lang, Words())
            words.add(text.as_py())
            if words.held >= shard_words:
                yield lang, held.pop(lang)
            elif sum(w.held for w in held.values()) >= 1.5 * shard_words:
                most = max(held, key=lambda x: held[x].held)
                yield most, held.pop(most)
    while held:
        yield held.popitem()


def enumerate_level(docs: DataFrame, length: int, depth: int, bits: int, frequent: list[np.ndarray], shard_words: int) -> DataFrame:
    """(lang, phrase, n): counts per shard of all phrases of ``length`` words whose parts may be frequent.

    ``frequent`` holds the tables of frequent phrases of 1, 2, ... words; a table may let others through, never hold one
    back. For one word, an empty phrase gives the number of all words. Shards are made anew from the texts at each level,
    which costs less than keeping them; whether they are the same does not matter to the sums.
    """
    sent = [docs.sparkSession.sparkContext.broadcast(f) for f in frequent]

    def may_be_frequent(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
        at = slots(hashes, words, bits)
        return (sent[words.shape[1] - 1].value[at >> 3] >> (at & 7) & 1).astype(bool)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, held in shards(batches, shard_words):
            words, index = held.index(depth)
            p = index.words()
            if length > 1:
                hashes = np.r_[np.zeros(1, np.uint64), word_hashes(lang, words)]
                p = p.take(may_be_frequent(hashes, p.words))
                for k in range(2, length + 1):
                    grow = index.extend_left if k % 2 == 0 else index.extend_right
                    p = grow(p, again=k + 2 <= length)
                    new = p.words[:, :-1] if k % 2 == 0 else p.words[:, 1:]     # the other part has passed before
                    p = p.take(may_be_frequent(hashes, new))
                    if k < length:
                        p = p.take(may_be_frequent(hashes, p.words))
            yield from out(lang, words, p)

    def out(lang: str, words: list[bytes], p: Intervals, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
        held = pa.array(words, pa.binary()).cast(pa.string())
        for lo in range(0, len(p.count), rows):
            w, n = p.words[lo:lo + rows] - 1, p.count[lo:lo + rows]
            phrase = held.take(pa.array(w[:, 0]))
            for c in range(1, length):
                phrase = pc.binary_join_element_wise(phrase, held.take(pa.array(w[:, c])), " ")
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(n)), phrase, pa.array(n, pa.int64())], ["lang", "phrase", "n"])
        if length == 1:
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([""]), pa.array([int(p.count.sum())], pa.int64())], ["lang", "phrase", "n"])

    rows = docs.filter("text IS NOT NULL").select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), "text")
    return rows.mapInArrow(count, "lang string, phrase string, n bigint")


def frequent_table(phrases: DataFrame, length: int, bits: int) -> np.ndarray:
    """Bits set at the places of ``phrases``; at most ``bits`` / 64 rows come to the driver, however many phrases there are."""
    at = phrases.select(slot_column(F.split("phrase", " "), length, bits).alias("at"))
    rows = at.groupBy(F.shiftright("at", 6).alias("cell")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS int)))").alias("held")).toArrow()
    cells = np.zeros(bits // 64, dtype=np.int64)
    cells[rows["cell"].to_numpy()] = rows["held"].to_numpy()
    return cells.view(np.uint8)


def phrase_counts(docs: DataFrame, depth: int = 3, least: int = 10, shard_words: int = 1_000_000, bits: int = FILTER_BITS) -> list[DataFrame]:
    """(lang, phrase, n) of 1, 2, ... ``depth`` words, all that occur ``least`` times; the first also has each language's
    number of words under the empty phrase."""
    out, tables = [], []
    for length in range(1, depth + 1):
        level = enumerate_level(docs, length, depth, bits, tables, shard_words)
        out.append(staged(level.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("phrase") == "")), "phrases"))
        if length < depth:
            tables.append(frequent_table(out[-1].filter("phrase <> ''"), length, bits))
    return out


def scored(counts: list[DataFrame]) -> DataFrame:
    """(lang, phrase, length, a, l, r, score): each phrase of two words or more at the cut with the lowest score."""
    every = counts[0]
    for c in counts[1:]:
        every = every.unionByName(c)
    longer = counts[1]
    for c in counts[2:]:
        longer = longer.unionByName(c)
    words = F.split("phrase", " ")
    length = F.size("words")
    cuts = longer.select("lang", "phrase", F.col("n").alias("a"), words.alias("words")).select(
        "*", F.explode(F.sequence(F.lit(1), length - 1)).alias("k")).select(
        "lang", "phrase", length.alias("length"), "a", "k", F.array_join(F.slice("words", 1, F.col("k")), " ").alias("left"),
        F.array_join(F.slice("words", F.col("k") + 1, length), " ").alias("right"))
    part = [every.select("lang", F.col("phrase").alias(p), F.col("n").alias(p[0])) for p in ("left", "right")]
    joined = cuts.join(part[0], ["lang", "left"]).join(part[1], ["lang", "right"])
    wide = "decimal(15,0)"
    above = F.col("a").cast(wide) * F.col("a").cast(wide) * F.lit(1_000_000).cast("decimal(7,0)")
    cut = joined.withColumn("above", above).withColumn("below", F.col("l").cast(wide) * F.col("r").cast(wide)).withColumn("score", F.expr("above div below"))
    return cut.groupBy("lang", "phrase", "length", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select(
        "lang", "phrase", "length", "a", "cut.l", "cut.r", "cut.score")


def inside_longer(counts: list[DataFrame], share: int) -> DataFrame:
    """(lang, phrase) of the phrases that lie in a longer one with ``share`` hundredths of their occurrences."""
    found = None
    for length in range(3, len(counts) + 1):
        words = F.split("phrase", " ")
        spans = [(k, s) for k in range(2, length) for s in range(1, length - k + 2)]
        part = counts[length - 1].select("lang", F.col("n").alias("whole"), F.explode(F.array(
            *[F.array_join(F.slice(words, s, k), " ") for k, s in spans])).alias("phrase"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return counts[0].select("lang", "phrase").limit(0)
    longest = found.groupBy("lang", "phrase").agg(F.max("whole").alias("whole"))
    short = counts[1]
    for c in counts[2:-1]:
        short = short.unionByName(c)
    return short.join(longest, ["lang", "phrase"]).filter(F.lit(100) * F.col("whole") >= F.lit(share) * F.col("n")).select("lang", "phrase")


def collocations(docs: DataFrame, top: int = 2_000, depth: int = 3, least: int = 10, share: int = 50, shard_words: int = 1_000_000,
                 bits: int = FILTER_BITS, salts: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``depth`` words.

    ``a`` counts a phrase, ``l`` and ``r`` the two parts of its weakest cut, ``n`` all words of the language. Phrases below
    ``least`` occurrences and those of which ``share`` hundredths lie in one longer phrase are left out. Texts are lower-cased in A-Z, cut at
    punctuation and line ends, and split at spaces and tabs; null and empty texts hold no words, a null language is ``und``, repeated
    rows count each time. Ties go by count, then by the bytes of the phrase. Other columns are dropped.
    """
    counts = phrase_counts(docs, depth, least, shard_words, bits)
    total = counts[0].filter("phrase = ''").select("lang", F.col("n").alias("words"))
    rows = scored([counts[0].filter("phrase <> ''"), *counts[1:]]).join(inside_longer(counts, share), ["lang", "phrase"], "left_anti")
    first = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*first)  # no window over a whole language
    few = rows.withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*first))).filter(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score")

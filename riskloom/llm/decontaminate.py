"""Benchmark decontamination by q-gram lemma filtering.

An item of m characters that occurs in a text with at most e edits shares at least m - q + 1 - q e of its q-grams with
the text, all on at most e + 1 neighbouring diagonals. Shared q-grams are counted in overlapping bands of diagonals;
bands that reach the bound are verified by banded alignment.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import pieces_of, staged, texts

_FAR = 1 << 29
_MIX = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str) -> str:
    """Lower case, with one space for each run of white space."""
    return " ".join(text.lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each window of q codes, built from windows of powers of two."""
    if len(codes) < q:
        return np.zeros(0, dtype=np.uint64)
    part, size, out, held = (codes.astype(np.uint64) + np.uint64(1)) * _MIX, 1, None, 0
    factor = np.uint64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        while True:
            if q & size:
                if out is None:
                    out = part
                else:
                    n = len(codes) - held - size + 1
                    out = out[:n] * np.uint64(0xFF51AFD7ED558CCD) ^ part[held:held + n]
                held += size
            if held == q:
                return out ^ (out >> np.uint64(29))
            part = (part[:-size] * factor) ^ (part[size:] + (part[size:] >> np.uint64(31)))
            factor = factor * factor | np.uint64(1)
            size *= 2


def edit_budget(m: int, q: int, rate: float) -> int:
    """Edits allowed for an item of m characters, such that the bound stays above zero."""
    return max(0, min(int(m * rate), (m - q) // q))


@dataclass
class Block:
    """Q-gram postings of one block of items."""

    ids: np.ndarray
    texts: list[str]
    gram: np.ndarray      # distinct hashes, sorted
    first: np.ndarray     # where the postings of each begin
    item: np.ndarray
    place: np.ndarray
    edits: np.ndarray
    bound: np.ndarray
    seen: np.ndarray      # bit table over the top bits of a hash


def index(ids: list[int], items: list[str], q: int, rate: float) -> Block:
    each = [grams(_codes(t), q) for t in items]
    flat = np.concatenate(each) if each else np.zeros(0, dtype=np.uint64)
    item = np.repeat(np.arange(len(items)), [len(g) for g in each])
    place = np.concatenate([np.arange(len(g)) for g in each]) if each else np.zeros(0, dtype=np.int64)
    order = np.argsort(flat, kind="stable")
    gram, first = np.unique(flat[order], return_index=True)
    seen = np.zeros(1 << 22, dtype=bool)
    seen[(gram >> np.uint64(42)).astype(np.int64)] = True
    m = np.array([len(t) for t in items], dtype=np.int64)
    edits = np.array([edit_budget(int(k), q, rate) for k in m], dtype=np.int64)
    return Block(np.array(ids, dtype=np.int64), items, gram, np.r_[first, len(flat)], item[order].astype(np.int32),
                 place[order].astype(np.int32), edits, m - q + 1 - q * edits, seen)


def banded_alignment(item: np.ndarray, region: np.ndarray, low: int, high: int, most: int) -> tuple[int, int]:
    """Fewest edits that turn ``item`` into a stretch of ``region``, and where it ends, on diagonals ``low`` to ``high``.

    A diagonal is a place in the region less the place in the item; the stretch may begin and end anywhere. Places
    beyond the region match nothing, which costs as much as leaving the item's character out. Above ``most`` edits the
    walk ends and gives ``most + 1``.
    """
    width, m = high - low + 1, len(item)
    slots = np.arange(width)
    first = max(0, -low)
    padded = np.full(first + max(len(region), m + high) + 1, 0x110000, dtype=np.uint32)
    padded[first:first + len(region)] = region
    row, drop = np.zeros(width, dtype=np.int64), np.full(width, _FAR)
    for i in range(m):
        at = i + low + first
        step = row + (padded[at:at + width] != item[i])    # a region place taken with the item's
        drop[:-1] = row[1:] + 1                            # the item's character left out
        np.minimum(step, drop, out=step)
        step -= slots
        row = np.minimum.accumulate(step) + slots          # characters of the region put in
        if not i % 16 and row.min() > most:
            return most + 1, 0
    end = int(row.argmin())
    return int(row[end]), m + low + end


def _verify(block: Block, k: int, text: str, low: int, high: int) -> tuple[int, int, int] | None:
    """Edits and stretch of item k in ``text`` on the given diagonals, if within its budget."""
    item, e = block.texts[k], int(block.edits[k])
    start = max(0, low - e)
    region = text[start:high + len(item) + e + 1]
    exact = region.find(item)
    if exact >= 0:
        return 0, start + exact, start + exact + len(item)
    edits, end = banded_alignment(_codes(item), _codes(region), low - e - start, high + e - start, e)
    return (edits, max(0, start + end - len(item)), start + end) if edits <= e else None


def scan(values: list[str], block: Block, q: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(index of text, index of item, edits, start, end), the best stretch for each pair found."""
    if not len(block.gram):
        return
    hashes = [grams(_codes(t), q) for t in values]
    sizes = np.array([len(h) for h in hashes])
    flat = np.concatenate(hashes)
    if not len(flat):
        return
    near = np.flatnonzero(block.seen[(flat >> np.uint64(42)).astype(np.int64)])
    slot = np.searchsorted(block.gram, flat[near])
    same = (slot < len(block.gram)) & (block.gram[np.minimum(slot, len(block.gram) - 1)] == flat[near])
    near, slot = near[same], slot[same]
    bounds = np.r_[0, np.cumsum(sizes)]
    doc = np.searchsorted(bounds, near, side="right") - 1
    many = block.first[slot + 1] - block.first[slot]
    take = np.repeat(block.first[slot], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    item, place = block.item[take], block.place[take]
    doc, at = np.repeat(doc, many), np.repeat(near - bounds[doc], many)
    diagonal = at - place
    width = block.edits[item] + 1
    band = diagonal // width
    # each diagonal counts in two bands of two widths that lie one width apart
    pair = doc * len(block.texts) + item
    found = np.stack([np.r_[pair, pair], np.r_[band, band - 1]], axis=1)
    if not len(found):
        return
    lowest = int(found[:, 1].min())
    span = int(found[:, 1].max()) - lowest + 1
    code = found[:, 0] * span + (found[:, 1] - lowest)
    code, counts = np.unique(code, return_counts=True)
    k = (code // span) % len(block.texts)
    enough = counts >= block.bound[k]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for c in code[enough][np.argsort(-counts[enough], kind="stable")]:  # exact stretches first
        d, i = int(c // span // len(block.texts)), int(c // span % len(block.texts))
        if best.get((d, i), (1,))[0] == 0:
            continue
        w, b = int(block.edits[i]) + 1, int(c % span) + lowest
        hit = _verify(block, i, values[d], b * w, (b + 2) * w - 1)
        if hit and hit < best.get((d, i), (_FAR,)):
            best[d, i] = hit
    for (d, i), (edits, start, end) in best.items():
        yield d, i, edits, start, end


def blocks_of(benchmark: DataFrame, block_chars: int, q: int, rate: float) -> Iterator[Block]:
    """The items in blocks of at most ``block_chars`` characters (a longer item alone), one block on the driver at a time."""
    items = staged(benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL")
                   .select("item_id", "text", (F.col("item_id") % 997).alias("bin")), "items")
    sums = items.groupBy("bin").agg(F.sum(F.length("text")).alias("n"))
    before = F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    bins = sums.select("bin", F.coalesce(before, F.lit(0)).alias("base"))  # at most 1,993 bins
    inside = F.sum(F.length("text")).over(Window.partitionBy("bin").orderBy("item_id", "text"))
    placed = staged(items.join(bins, "bin").select("item_id", "text", F.floor((F.col("base") + inside) / block_chars).alias("block")), "placed")
    for b in sorted(r["block"] for r in placed.select("block").distinct().collect()):
        rows = placed.filter(F.col("block") == b).select("item_id", "text").collect()
        kept = sorted({(r["item_id"], p) for r in rows if len(p := plain(r["text"])) >= q})
        if kept:
            yield index([i for i, _ in kept], [t for _, t in kept], q, rate)


def matches(docs: DataFrame, benchmark: DataFrame, q: int = 10, rate: float = 0.08, block_chars: int = 1_000_000,
            piece_chars: int = 400_000) -> DataFrame:
    """doc_id, item_id, edits, start, end: every item found in a text within ``rate`` edits per character.

    Texts and items are compared in lower case with runs of white space as one space; start and end count characters of
    that form. Null or empty texts and items, and items of under ``q`` characters, match nothing. Repeated rows of
    ``docs`` give repeated results; an item listed twice gives one. Other columns are dropped. Texts are never shuffled:
    each block of at most ``block_chars`` characters of items (about 24 bytes a character) is sent to all tasks.
    """
    schema = "doc_id bigint, item_id bigint, edits int, start bigint, end bigint"
    out, context = None, docs.sparkSession.sparkContext
    for block in blocks_of(benchmark, block_chars, q, rate):
        sent = context.broadcast(block)

        def look(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            block = sent.value
            for b in batches:
                ids, values, rows = b["doc_id"].to_numpy(), b["text"].to_numpy(), []
                for lo, hi in pieces_of(values, piece_chars):
                    rows += [(ids[lo + d], block.ids[i], edits, s, e) for d, i, edits, s, e in scan([plain(t) for t in values[lo:hi]], block, q)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "edits", "start", "end"]).astype(
                    {"doc_id": "Int64", "item_id": "int64", "edits": "int32", "start": "int64", "end": "int64"})

        found = texts(docs).mapInPandas(look, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``docs`` without the rows whose own text holds a benchmark item; columns and their order stay.

    Rows are told apart by a hash of their text, whatever their doc_id.
    """
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    hit = staged(matches(docs.select(key.alias("doc_id"), "text"), benchmark, **settings)
                 .select(F.col("doc_id").alias("__hit_key")).distinct(), "leaks")
    return docs.withColumn("__text_key", key).join(hit, F.col("__text_key") == F.col("__hit_key"), "left_anti").select(docs.columns)

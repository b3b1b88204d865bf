"""Token ids in binary shards with keyed access through a minimal perfect hash index.

A shard is a file of raw little-endian ids after a short header. The index maps a document key to its shard, place and
lengths: keys are dealt into buckets, and each bucket holds a minimal perfect hash (levels of bit arrays; a key's slot is
the rank of the first bit it alone hit) and, by slot, a fingerprint of the key and where its ids lie. A look-up reads a
fixed number of array cells.
"""

from __future__ import annotations

import os
import pickle
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskloom.llm.chunks import LETTERS, ChunkCache
from riskloom.llm.common import staged, texts
from riskloom.session import scratch_path

MAGIC = b"IDSHARD1"
#: Key of rows without doc_id.
NO_ID = -(1 << 63)
_MARKS = re.escape(",.!?;:|$&%*#")
_CHUNK = re.compile(f"[{LETTERS}]+(?=[{_MARKS} \n]|\\Z)|[^ \n]+?(?:(?<=[{LETTERS}])(?=[{_MARKS}])|(?=[ \n])|\\Z)")


# -- ids -------------------------------------------------------------------------------------------


class Encoder:
    """Ids of a text as the library gives them for the whole text.

    The vocabulary's own splitting separates words at white space and letters from punctuation, and drops the white space,
    so texts are cut there and each chunk is given to the library once per worker while it is remembered. A text that may hold
    a special token goes to the library whole.
    """

    def __init__(self, definition: str, kind: str, cache_size: int = 400_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.kind = Tokenizer.from_str(definition), kind
        self.cache = ChunkCache(self._encode, cache_size)

    def _encode(self, chunks: list[str]) -> list[bytes]:
        code = "H" if self.kind == "<u2" else "I"   # of the machines here, little-endian
        return [array(code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def __call__(self, text: str) -> bytes:
        if "<|" in text:
            return self._encode([text])[0]
        try:
            text.encode("latin-1")
            text = text.lower()   # the vocabulary is lower case; for these characters lower case is the same everywhere
        except UnicodeEncodeError:
            pass
        return self.cache(_CHUNK.findall(text))


@lru_cache(maxsize=1)
def encoder(definition: str, kind: str) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return Encoder(definition, kind)


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def write_shards(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = 1) -> DataFrame:
    """Write the ids of all texts in ascending doc_id order below ``path``; give doc_id, shard, place, n_ids.

    ``place`` counts ids from the shard's begin. Shards follow the order of doc_id, rows of one doc_id that of their text;
    rows without doc_id come first. A task writes its shard under a name of its own attempt and then moves it, so a repeated
    task replaces it by the same bytes. An id takes two bytes where the vocabulary allows it.
    """
    with open(tokenizer_path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        definition = f.read()
    kind = "<u2" if Tokenizer.from_str(definition).get_vocab_size() <= 1 << 16 else "<u4"
    sent = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(sent.value, kind), np.array([end_id], dtype=kind).tobytes()
        task = TaskContext.get()
        shard, place, out = task.partitionId(), 0, None
        store, folder = _store(path)
        name, mine = f"{folder}/{shard:06d}.ids", f"{folder}/.{shard:06d}-{task.taskAttemptId()}"
        for batch in batches:
            if out is None:
                store.create_dir(folder, recursive=True)
                out = store.open_output_stream(mine)
                out.write(MAGIC + np.array([np.dtype(kind).itemsize], dtype="<u8").tobytes())
            parts = [encode(t) + end for t in batch.column("text").to_pylist()]
            out.write(b"".join(parts))
            n = np.array([len(p) for p in parts], dtype=np.int64) // np.dtype(kind).itemsize
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(n), shard, dtype=np.int32)), pa.array(place + np.cumsum(n) - n), pa.array(n)],
                names=["doc_id", "shard", "place", "n_ids"])
            place += int(n.sum())
        if out is not None:
            out.close()
            store.move(mine, name)

    ordered = texts(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, "doc_id bigint, shard int, place bigint, n_ids bigint")


# -- minimal perfect hash ----------------------------------------------------------------------------


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of integer keys."""
    with np.errstate(over="ignore"):
        h = keys.astype(np.int64).view(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


class PerfectHash:
    """Slots 0 to n - 1 for n distinct keys. A level keeps a bit where exactly one of its keys fell; the others go on."""

    def __init__(self, keys: np.ndarray, spread: float = 2.0) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        first = 0
        while len(keys):
            at = self._at(keys, len(self.levels), max(1, int(len(keys) * spread)))
            hits = np.bincount(at, minlength=max(1, int(len(keys) * spread)))
            alone = hits == 1
            rank = first + np.cumsum(alone) - alone
            self.levels.append((alone, rank.astype(np.int32)))
            first += int(alone.sum())
            keys = keys[~alone[at]]

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys, level + 16) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for some of those never stored; a fingerprint tells the others."""
        out, left = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            at = self._at(keys[left], level, len(alone))
            out[left[alone[at]]] = rank[at[alone[at]]]
            left = left[~alone[at]]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 3) >> np.uint64(32)).astype(np.uint32)


def bucket_of(keys: pd.Series, buckets: int) -> pd.Series:
    return pd.Series((mix(keys.to_numpy(dtype=np.int64), 1) % np.uint64(buckets)).astype(np.int64))


def _bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    deal = F.pandas_udf(lambda k: bucket_of(k, buckets), "bigint")
    return df.withColumn("bucket", deal(F.col(key)))


def build_index(rows: DataFrame, bucket_keys: int = 20_000) -> tuple[DataFrame, int]:
    """The index over what ``write_shards`` gave, one row per bucket, and the number of buckets.

    ``start`` is the number of ids before a document. Rows that repeat a doc_id share an entry with all their lengths.
    """
    sums = rows.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    base = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))   # one row per shard
    bases = sums.select("shard", F.coalesce(base, F.lit(0)).alias("base"))
    entries = rows.withColumn("key", F.coalesce("doc_id", F.lit(NO_ID))).groupBy("key", "shard").agg(
        F.min("place").alias("place"), F.transform(F.array_sort(F.collect_list(F.struct("place", "n_ids"))), lambda x: x["n_ids"]).alias("lengths"))
    entries = staged(entries.join(bases, "shard").withColumn("start", F.col("base") + F.col("place")), "entries")
    buckets = max(1, -(-entries.count() // bucket_keys))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        keys = group["key"].to_numpy(dtype=np.int64)
        mph = PerfectHash(keys)
        order = np.argsort(mph.slots(keys))
        stored = {c: group[c].to_numpy()[order] for c in ("shard", "place", "start")} | {
            "lengths": [np.asarray(x, dtype=np.int64) for x in group["lengths"].to_numpy()[order]], "fingerprint": fingerprints(keys[order])}
        return pd.DataFrame({"bucket": [group["bucket"].iloc[0]], "body": [pickle.dumps((mph, stored))]})

    built = _bucketed(entries, "key", buckets).groupBy("bucket").applyInPandas(build, "bucket bigint, body binary")
    return staged(built, "index"), buckets


def look_up(keys: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """key, shard, place, start, lengths for each row of ``keys`` (key bigint) that the index holds."""
    def find(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        names = ["key", "shard", "place", "start", "lengths"]
        if not len(asked) or not len(held):
            return pd.DataFrame({n: pd.Series([], dtype=object) for n in names}).astype({"key": "int64", "shard": "int32", "place": "int64", "start": "int64"})
        mph, stored = pickle.loads(held["body"].iloc[0])
        k = asked["key"].to_numpy(dtype=np.int64)
        slot = mph.slots(k)
        ok = slot >= 0
        ok[ok] = stored["fingerprint"][slot[ok]] == fingerprints(k[ok])
        k, slot = k[ok], slot[ok]
        return pd.DataFrame({"key": k, "shard": stored["shard"][slot], "place": stored["place"][slot], "start": stored["start"][slot],
                             "lengths": pd.Series([stored["lengths"][s] for s in slot], dtype=object)})

    left, right = _bucketed(keys, "key", buckets).groupBy("bucket"), index.groupBy("bucket")
    return left.cogroup(right).applyInPandas(find, "key bigint, shard int, place bigint, start bigint, lengths array<bigint>")


def read_ids(found: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as unsigned 32-bit integers), read from the shard files.

    Look-ups are dealt by shard and stretch of a shard and read in place order.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = _store(path)
        name, file, width = None, None, 0
        for b in batches:
            rows = []
            for key, shard, place, start, lengths in zip(b["key"], b["shard"], b["place"], b["start"], b["lengths"]):
                if name != shard:
                    if file is not None:
                        file.close()
                    file, name = store.open_input_file(f"{folder}/{int(shard):06d}.ids"), shard
                    head = file.read_at(16, 0)
                    if head[:8] != MAGIC:
                        raise ValueError(f"not a shard of ids: {folder}/{int(shard):06d}.ids")
                    width = int(np.frombuffer(head[8:], dtype="<u8")[0])
                for n in map(int, lengths):
                    ids = np.frombuffer(file.read_at(n * width, 16 + place * width), dtype=f"<u{width}")
                    rows.append((None if key == NO_ID else key, start, n, zlib.crc32(ids.astype("<u4").tobytes())))
                    place, start = place + n, start + n
            yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype(
                {"doc_id": "Int64", "start": "int64", "n_tokens": "int64", "ids_crc32": "int64"})
        if file is not None:
            file.close()

    dealt = found.repartition("shard", F.floor(F.col("place") / 4_000_000)).sortWithinPartitions("shard", "place")
    return dealt.mapInPandas(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def encode_and_read(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Write ``docs`` as shards, index them, look every document up by its key and give what the files hold.

    Null and empty texts hold the end id alone. Repeated rows are kept. A doc_id of -2^63 is read as no doc_id. Other
    columns are dropped. ``path`` must be reachable by all tasks through pyarrow; the default is a fresh folder in the
    shared folder.
    """
    path = path or scratch_path(docs.sparkSession, "token-ids")
    rows = staged(write_shards(docs, path, tokenizer_path, end_id), "token-rows")
    index, buckets = build_index(rows)
    keys = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("key")).distinct()
    return read_ids(look_up(keys, index, buckets), path)

"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The compiled transducer maps a space to the word mark and puts one in front of a text (the normaliser), has an arc for each
piece and arcs for the bytes of a character without a piece. A state is the last piece taken. An arc weighs nothing if the
vocabulary's merges leave its piece and the last one apart, and infinity if they would join across the two: the merges
of a string end in the one sequence of pieces whose neighbours all stand so, hence the tropical shortest path, which
is the only finite one, is the encoding that the vocabulary defines. The composed machine of a chunk is walked depth
first, longest piece first, with dead states remembered. Chunks are cut where no piece spans, so texts of any length are
composed in small parts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.chunks import LETTERS, ChunkCache, codes, cutter
from riskloom.llm.common import texts

MARK = "▁"
SCHEMA = "doc_id bigint, ids array<int>, n_ids bigint, round_trip boolean"
#: Pairs of pieces remembered in a task.
MOST_PAIRS = 500_000


class Transducer:
    """Compiled from a model's pieces; holds only dictionaries, so it is cheap to send."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], spelled: list[bytes], most_pairs: int = MOST_PAIRS) -> None:
        self.pieces, self.byte_ids, self.spelled, self.most_pairs = pieces, byte_ids, spelled, most_pairs
        self.longest: dict[str, int] = {}
        for p in pieces:
            self.longest[p[0]] = max(self.longest.get(p[0], 1), len(p))
        inside = {p[i:i + 2] for p in pieces for i in range(len(p) - 1)}
        letter = f"[{LETTERS}]"
        self.marks = "".join(c for c in ",.!?;:" if not any(b[1] == c and re.match(letter, b[0]) for b in inside))
        if any(b[1] == MARK and b[0] != MARK or "\n" in b for b in inside):
            raise ValueError("the vocabulary has pieces that span a line end or end in a word mark")
        self.apart: dict[tuple[str, str], bool] = {}
        self.split: dict[str, list[str] | None] = {}

    @classmethod
    def load(cls, path: str, most_pairs: int = MOST_PAIRS) -> Transducer:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        named = [model.id_to_piece(i) for i in range(n)]
        plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
        pieces = {named[i]: (i, model.get_score(i)) for i in range(n) if plain[i]}
        byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        spelled = [p.replace(MARK, " ").encode() if plain[i] else b"" for i, p in enumerate(named)]
        for b, i in enumerate(byte_ids):
            spelled[i] = bytes([b])
        return cls(pieces, byte_ids, spelled, most_pairs)

    def merged(self, text: str, until: int = 1) -> list[str]:
        """The pieces left when the best neighbouring pair is joined again and again, the leftmost of equals first."""
        parts, pieces = list(text), self.pieces
        while len(parts) > until:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = pieces.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or found[1] > best):
                    best, at = found[1], i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, piece: str) -> list[str] | None:
        """The two pieces that are joined last to give ``piece``; None if merging its characters does not give it."""
        if piece not in self.split:
            parts = self.merged(piece, 2)
            self.split[piece] = parts if len(parts) == 2 and piece in self.pieces else None
        return self.split[piece]

    def stand_apart(self, a: str, b: str) -> bool:
        """Whether the arc from state ``a`` over piece ``b`` has a finite weight.

        The merges that made the two are taken back, latest first. They stand apart if at no moment a join across the
        two would have come before the merge taken back.
        """
        known = self.apart.get((a, b))
        if known is None:
            if len(self.apart) >= self.most_pairs:
                self.apart.clear()
            known = self.apart[a, b] = (len(b) == 1 or self.halves(b) is not None) and (not a or self._never_joined(a, b))
        return known

    def _never_joined(self, a: str, b: str) -> bool:
        pieces, floor, ties = self.pieces, -np.inf, True
        while True:
            join = pieces.get(a + b)
            if join is not None and (join[1] > floor or ties and join[1] == floor):
                return False
            score_a = pieces[a][1] if len(a) > 1 else np.inf
            score_b = pieces[b][1] if len(b) > 1 else np.inf
            if score_a == score_b == np.inf:
                return True
            if score_a < score_b:   # a was joined later; of equals the right one is
                a, floor, ties = self.halves(a)[1], score_a, False
            else:
                b, floor, ties = self.halves(b)[0], score_b, True

    def shortest_path(self, chunk: str) -> list[str]:
        """Pieces of the finite path through the machine composed with ``chunk``."""
        n, pieces, longest, apart = len(chunk), self.pieces, self.longest, self.apart
        path: list[str] = []
        tried, dead, pos = [min(longest.get(chunk[0], 1), n)] if n else [], set(), 0
        while pos < n:
            size, last = tried[-1], path[-1] if path else ""
            while size:
                piece = chunk[pos:pos + size]
                if (size == 1 or piece in pieces) and (pos + size, size) not in dead:
                    finite = apart.get((last, piece))
                    if finite or finite is None and self.stand_apart(last, piece):
                        break
                size -= 1
            if size:
                path.append(piece)
                tried[-1] = size
                pos += size
                if pos < n:
                    tried.append(min(longest.get(chunk[pos], 1), n - pos))
            else:
                if not path:
                    return self.merged(chunk)  # equal merge ranks, as in runs of word marks, can leave no finite path
                tried.pop()
                piece = path.pop()
                dead.add((pos, len(piece)))
                pos -= len(piece)
                tried[-1] = len(piece) - 1
        return path

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        out = []
        for chunk in chunks:
            ids: list[int] = []
            for p in self.shortest_path(chunk):
                found = self.pieces.get(p)
                if found is not None:
                    ids.append(found[0])
                else:
                    ids += [self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass")]
            out.append(np.array(ids, dtype="<i4").tobytes())
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces and bytes put together, without the word mark put in front."""
        raw = b"".join(map(self.spelled.__getitem__, ids))
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


def encoded(batch: pa.RecordBatch, machine: Transducer, cut: Callable[[str], list[str]], cache: ChunkCache) -> pa.RecordBatch:
    """The result rows of a few documents (doc_id, text), read one by one."""
    parts, sizes, same = [], [], []
    for value in batch.column("text"):
        text = value.as_py()
        raw = cache(cut((MARK + text).replace(" ", MARK))) if text else b""
        parts.append(raw)
        ids = codes(raw)
        sizes.append(len(ids))
        same.append(machine.decode(ids.tolist()) == text.replace(MARK, " "))
    flat = codes(b"".join(parts))
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), lists, pa.array(sizes, pa.int64()), pa.array(same, pa.bool_())],
        names=["doc_id", "ids", "n_ids", "round_trip"])


def encode(docs: DataFrame, model_path: str | None = None, cache_size: int = 250_000, rows: int = 256,
           most_pairs: int = MOST_PAIRS) -> DataFrame:
    """doc_id, ids, n_ids and round_trip for every row of ``docs``.

    ``round_trip`` tells that decoding the ids gives the text again, with a word mark in the text read as a space.
    Null and empty texts have no ids. Repeated rows are kept; other columns are dropped. The vocabulary is read on the
    driver and sent to all tasks; its size does not depend on the data. A task holds the ids of ``rows`` texts at a time.
    On ``cache_size`` (chunks) and ``most_pairs`` (pairs of pieces remembered) only speed and memory depend.
    """
    compiled = docs.sparkSession.sparkContext.broadcast(Transducer.load(model_path or public_tokenizers.path("piece_bpe_32k.model"), most_pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled.value
        cut, cache = cutter(MARK, machine.marks).findall, ChunkCache(machine.encode_chunks, cache_size)
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                yield encoded(batch.slice(lo, rows), machine, cut, cache)
            batch = None
            pa.default_memory_pool().release_unused()

    return texts(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCHEMA)

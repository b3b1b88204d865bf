"""Encoding texts by chunks: a text is cut where no token can span, and equal chunks are encoded once per task."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"


class ChunkCache:
    """Encoded chunks of one task in two generations: when the young one is full, it replaces the old one."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], size: int = 250_000) -> None:
        self.encode, self.size = encode, size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, chunks: list[str]) -> bytes:
        """The codes of ``chunks``, joined."""
        young = self.young
        try:
            return b"".join([young[c] for c in chunks])
        except KeyError:
            pass
        old, new = self.old, []
        for c in set(chunks).difference(young):
            held = old.get(c)
            if held is None:
                new.append(c)
            else:
                young[c] = held
        young.update(zip(new, self.encode(new)))
        out = b"".join([young[c] for c in chunks])
        if len(young) > self.size:
            self.old, self.young = young, {}
        return out


def cutter(space: str, marks: str) -> re.Pattern:
    """Cuts after letters before ``marks`` and at ``space`` and line ends; a chunk keeps the spaces before it."""
    m, s = re.escape(marks), re.escape(space)
    return re.compile(f"{s}*(?:[{LETTERS}]+(?=[{m}{s}\n]|\\Z)|[^{s}\n]+?(?:(?<=[{LETTERS}])(?=[{m}])|(?=[{s}\n])|\\Z)|\n|(?<={s})(?=\\Z))")


def codes(raw: bytes, kind: str = "<i4") -> np.ndarray:
    return np.frombuffer(raw, dtype=kind)

"""Byte-level BPE as a tree reduction: encode halves, join neighbours, decode up the tree.

Two encoded neighbours are joined by encoding only a window around their border again. The window
grows until the tokens at its edges fit those outside it. A list of tokens is what the whole string
encodes to exactly when each token and the next encode, together, to themselves; inside a half all
pairs are known to fit, so two checked pairs prove everything outside the window stable.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, pairwise

import numpy as np
from pyspark.sql import DataFrame

from dialoom.llm.base import per_row
from dialoom.llm.patterns import Pattern

LEAF = 32
SHORT = 256
NEVER = 1 << 62
MEMO = 400_000
LONG_TEXT = 1 << 20
STEP = 100_000


class _Memo(dict):
    """Packed ids (little-endian, 32 bits each) per distinct match; emptied when it grows large."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        ids = self.codec.encode_piece(piece.encode())
        if len(self) >= MEMO:
            self.clear()
        self[piece] = packed = struct.pack(f"<{len(ids)}I", *ids)
        return packed


class Codec:
    """Encoder and decoder for one rank file. Ranks are read once per task."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF):
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines)
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.bytes_of = dict((rank, token) for token, rank in self.ranks.items())
        self.pattern = Pattern(pattern)
        self.leaf = leaf
        self.fits = lru_cache(1 << 16)(self._fits)
        self.memo = _Memo(self)

    def merge(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals, until no neighbours merge."""
        return self._merge_scan(piece) if len(piece) <= SHORT else self._merge_queue(piece)

    def _merge_scan(self, piece: bytes) -> list[int]:
        rank_of, n = self.ranks.get, len(piece)
        cuts = list(range(n + 1))
        pairs = [rank_of(piece[i:i + 2], NEVER) for i in range(n - 1)]
        while pairs and (least := min(pairs)) < NEVER:
            i = pairs.index(least)
            del cuts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = rank_of(piece[cuts[i]:cuts[i + 2]], NEVER)
            if i:
                pairs[i - 1] = rank_of(piece[cuts[i - 1]:cuts[i + 1]], NEVER)
        return [self.ranks[piece[a:b]] for a, b in pairwise(cuts)]

    def _merge_queue(self, piece: bytes) -> list[int]:
        ranks, n = self.ranks, len(piece)
        ends = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = [(rank, i) for i in range(n - 1)
                 if (rank := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(queue)
        gone = bytearray(n)
        while queue:
            rank, i = heapq.heappop(queue)
            if gone[i] or ends[i] == n or ranks.get(piece[i:ends[ends[i]]]) != rank:
                continue
            absorbed = ends[i]
            gone[absorbed] = 1
            ends[i] = ends[absorbed]
            if ends[i] < n:
                before[ends[i]] = i
                if (rank := ranks.get(piece[i:ends[ends[i]]])) is not None:
                    heapq.heappush(queue, (rank, i))
            left = before[i]
            if left >= 0 and (rank := ranks.get(piece[left:ends[i]])) is not None:
                heapq.heappush(queue, (rank, left))
        tokens, i = [], 0
        while i < n:
            tokens.append(ranks[piece[i:ends[i]]])
            i = ends[i]
        return tokens

    def _fits(self, left: int, right: int) -> bool:
        return self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of the two strings written one after the other."""
        width = 2
        while True:
            start, end = max(len(left) - width, 0), min(width, len(right))
            window = self.merge(self.decode(left[start:]) + self.decode(right[:end]))
            if (start == 0 or self.fits(left[start - 1], window[0])) and (
                    end == len(right) or self.fits(window[-1], right[end])):
                return left[:start] + window + right[end:]
            width *= 2

    def encode_piece(self, piece: bytes) -> list[int]:
        if (rank := self.ranks.get(piece)) is not None:
            return [rank]
        if len(piece) <= self.leaf:
            return self.merge(piece)
        half = len(piece) // 2
        return self.join(self.encode_piece(piece[:half]), self.encode_piece(piece[half:]))

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids; concatenation is the whole of the reduction here."""
        if len(ids) > STEP:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def matches(self, text: str) -> Iterator[list[str]]:
        """Matches of the pattern, in lists of bounded length."""
        pattern = self.pattern.engine(text)
        if len(text) <= LONG_TEXT:
            yield pattern.findall(text)
            return
        found = (m.group() for m in pattern.finditer(text))
        while some := list(islice(found, STEP)):
            yield some

    def encode(self, text: str | None) -> Iterator[bytes]:
        """Packed ids of the text, part by part."""
        for some in self.matches(text or ""):
            yield b"".join(map(self.memo.__getitem__, some))


def _digest(codec: Codec, doc_id: int | None, text: str | None) -> tuple:
    count, ids_hash, bytes_hash = 0, hashlib.sha256(), hashlib.sha256()
    for part in codec.encode(text):
        ids = np.frombuffer(part, "<u4").tolist()
        count += len(ids)
        ids_hash.update(part)
        bytes_hash.update(codec.decode(ids))
    return doc_id, count, ids_hash.hexdigest(), bytes_hash.hexdigest()


def _ids(codec: Codec, doc_id: int | None, text: str | None) -> tuple:
    return doc_id, np.frombuffer(b"".join(codec.encode(text)), "<u4").tolist()


def _text(codec: Codec, doc_id: int | None, ids: list[int] | None) -> tuple:
    return doc_id, codec.decode(ids or [])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) for every row of docs, row by row: no shuffle.

    Null and empty texts give no ids; repeated rows and doc_ids are encoded each; other columns
    are not read.
    """
    return per_row(docs, ["doc_id", "text"], _ids, "doc_id long, ids array<int>",
                   lambda: Codec(path, pattern))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes) for every row of (doc_id, ids); null ids give no bytes."""
    return per_row(encoded, ["doc_id", "ids"], _text, "doc_id long, bytes binary",
                   lambda: Codec(path, pattern))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, decode again, and report counts and hashes per row of docs."""
    return per_row(docs, ["doc_id", "text"], _digest,
                   "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
                   lambda: Codec(path, pattern))

"""Byte-level BPE with a public vocabulary: a rank queue on a hierarchical bitmap."""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache
from heapq import heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Bytes of encoded pre-tokens kept by a worker (some 100 MB with their ids at most), and of the longest kept.
KEPT, KEPT_BYTES = 4 << 20, 192


class RankQueue:
    """Positions by merge rank; the smallest rank is found by find-first-set on three levels of 64-bit words."""

    def __init__(self, ranks: int):
        words = (ranks >> 6) + 1
        self.low, self.mid, self.top = [0] * words, [0] * ((words >> 6) + 1), 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        word = rank >> 6
        self.low[word] |= 1 << (rank & 63)
        self.mid[word >> 6] |= 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def pop(self) -> tuple[int, int] | None:
        """The smallest rank and the leftmost position in its bucket."""
        if not self.top:
            return None
        m = (self.top & -self.top).bit_length() - 1
        w = (m << 6) + (self.mid[m] & -self.mid[m]).bit_length() - 1
        rank = (w << 6) + (self.low[w] & -self.low[w]).bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            self.low[w] &= self.low[w] - 1
            if not self.low[w]:
                self.mid[m] &= self.mid[m] - 1
                if not self.mid[m]:
                    self.top &= self.top - 1
        return rank, position


class BytePairEncoder:
    """Ids of texts under a vocabulary of byte strings with ranks; ids are the ranks."""

    def __init__(self, vocabulary: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(max(self.ranks.values()))
        self.kept: dict[str, bytes] = {}
        self.kept_bytes = 0

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token: the adjacent pair of smallest rank, leftmost first, is merged until none is left."""
        ranks, n = self.ranks, len(data)
        if data in ranks:
            return [ranks[data]]
        queue = self.queue
        after = list(range(1, n + 2))  # linked list: start of the next symbol
        before = list(range(-1, n))
        pair = [-1] * (n + 1)  # rank of the pair that starts at a symbol, -1 for none or a symbol that is gone
        get = ranks.get
        for i in range(n - 1):
            r = get(data[i : i + 2], -1)
            if r >= 0:
                pair[i] = r
                queue.push(r, i)
        while (entry := queue.pop()) is not None:
            r, i = entry
            if pair[i] != r:  # stale
                continue
            gone = after[i]
            end = after[gone]
            after[i] = end
            pair[gone] = -1
            if end <= n:
                before[end] = i
            if end < n:
                pair[i] = k = get(data[i : after[end]], -1)
                if k >= 0:
                    queue.push(k, i)
            else:
                pair[i] = -1
            p = before[i]
            if p >= 0:
                pair[p] = k = get(data[p:end], -1)
                if k >= 0:
                    queue.push(k, p)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[data[i : after[i]]])
            i = after[i]
        return ids

    def _piece(self, piece: str) -> bytes:
        """Ids of a pre-token that isn't kept yet, four bytes each."""
        data = piece.encode("utf-8", "replace")
        ids = array("i", self.merge(data)).tobytes()
        if len(data) <= KEPT_BYTES:
            self.kept_bytes += len(data)
            if self.kept_bytes > KEPT:
                self.kept.clear()
                self.kept_bytes = len(data)
            self.kept[piece] = ids
        return ids

    def packed(self, text: str | None) -> bytes:
        """Ids without special tokens, four bytes each; none for an empty or null text."""
        get, out = self.kept.get, []
        for piece in self.split(text) if text else ():
            out.append(get(piece) or self._piece(piece))
        return b"".join(out)

    def count(self, text: str | None) -> int:
        """Number of ids, without joining them."""
        get = self.kept.get
        return sum(len(get(piece) or self._piece(piece)) for piece in self.split(text)) // 4 if text else 0

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens as a list."""
        return array("i", self.packed(text)).tolist()


@lru_cache(maxsize=4)
def _encoder(vocabulary: bytes, pattern: str) -> BytePairEncoder:
    return BytePairEncoder(vocabulary, pattern)


def load_vocabulary(path: str | None = None, pattern: str | None = None) -> tuple[bytes, str]:
    """The vocabulary file (by default the public byte_bpe_50k of the installed tokenizers) and the pattern of pre-tokens."""
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    return Path(path).read_bytes(), pattern


def _udf(spark: SparkSession, kind: str, path: str | None, pattern: str | None):
    shared = spark.sparkContext.broadcast(load_vocabulary(path, pattern))  # under 1 MB, read once on the driver

    if kind == "ids":

        @F.arrow_udf("array<int>")
        def ids(text: pa.Array) -> pa.Array:
            each = list(map(_encoder(*shared.value).packed, text.to_pylist()))
            ends = np.cumsum([0, *map(len, each)]) // 4
            flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(each))])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)

        return ids

    @F.arrow_udf("int")
    def count(text: pa.Array) -> pa.Array:
        number = _encoder(*shared.value).count
        return pa.array((number(x) for x in text.to_pylist()), pa.int32(), size=len(text))

    return count


def token_ids(spark: SparkSession, text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """Ids of ``text`` by the public byte-level BPE, without special tokens (their strings are ordinary text).

    Method: pre-tokens are found by the vocabulary's pattern; in each, buckets per merge rank hold positions of a linked
    list of symbols, a hierarchical bitmap gives the smallest rank by find-first-set, stale entries are skipped. The cost
    is near-linear in the length, so very long pre-tokens are no danger. Encoded short pre-tokens are kept by a worker.

    Defined cases: an empty and a null text give an empty list.
    """
    return _udf(spark, "ids", path, pattern)(text)


def token_count(spark: SparkSession, text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """Number of ids of ``text``; 0 for an empty and a null text."""
    return _udf(spark, "count", path, pattern)(text)

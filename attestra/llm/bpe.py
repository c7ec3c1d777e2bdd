"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each match of the pre-token pattern is merged on its own. Adjacent pairs wait in
one bucket per merge rank; a two-level bitmap over the ranks finds the lowest
rank that waits with two find-first-set steps. The parts of a pre-token form a
linked list of byte positions; an entry whose pair has changed since it was
queued is stale and skipped. A pre-token of n bytes takes O(n) bucket steps, so
a megabyte without a space is no special case.

Defined results: a null or empty text has no ids and decodes to no bytes; ids
outside the vocabulary or null fail the decode; text columns may be of any
length; repeated rows are encoded alike; an empty table gives no row; of equal ranks the leftmost
pair merges first; columns named like an added one are replaced.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from attestra.llm.common import add_with_arrow, claim

#: A worker remembers the ids of at most twice so many pre-tokens, none longer than so many characters: bounds its memory.
MEMO_ENTRIES, MEMO_CHARS = 250_000, 48

BIT = [1 << k for k in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    """The merge ranks of a rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class RankQueue:
    """Positions that wait by merge rank: a bucket for each rank, and a bitmap of two levels over the buckets."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values(), default=-1) + 1
        #: None, one position, or a heap of positions
        self.bucket: list[int | list[int] | None] = [None] * size
        #: the lower level, 256 ranks to a word; the upper level lives in merge(), which leaves all of this empty
        self.word = [0] * ((size >> 8) + 1)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the lowest rank first, the leftmost of equal ranks first."""
        ranks, bucket, word = self.ranks, self.bucket, self.word
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n, find, top = len(piece), ranks.get, 0
        after, before = list(range(1, n + 2)), list(range(-1, n))
        pair = [-1] * n  # the rank of the pair that starts here, -1 if there is none
        for i in range(n - 1):
            r = find(piece[i : i + 2])
            if r is not None:
                pair[i] = r
                there = bucket[r]
                if there is None:
                    bucket[r] = i
                    word[w := r >> 8] |= BIT[r & 255]
                    top |= 1 << w
                elif there.__class__ is int:
                    bucket[r] = [there, i]
                else:
                    there.append(i)
        while top:
            w = (top & -top).bit_length() - 1
            bits = word[w]
            r = w << 8 | (bits & -bits).bit_length() - 1
            there = bucket[r]
            if there.__class__ is int or len(there) == 1:
                i = there if there.__class__ is int else there[0]
                bucket[r] = None
                word[w] = bits = bits & (bits - 1)
                if not bits:
                    top &= top - 1
            else:
                i = heappop(there)
            if pair[i] != r:  # stale
                continue
            gone = after[i]
            end = after[i] = after[gone]
            pair[gone] = -1
            for p in (i, before[i]):
                if p < 0:
                    continue
                q = after[p]
                if q >= n or (new := find(piece[p : after[q]])) is None:
                    pair[p] = -1
                    continue
                pair[p] = new
                there = bucket[new]
                if there is None:
                    bucket[new] = p
                    word[v := new >> 8] |= BIT[new & 255]
                    top |= 1 << v
                elif there.__class__ is int:
                    bucket[new] = [there, p] if there < p else [p, there]
                else:
                    heappush(there, p)
            if end < n:
                before[end] = i
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : (i := after[i])]])
        return ids


#: Outside these characters the standard library's classes differ from Unicode properties.
NOT_PLAIN = re.compile("[^\\t-\\r\\x20-\\x7eÀ-ÖØ-öø-ÿ]")


def plain_pattern(pattern: str):
    """The pattern for the standard library's faster matcher, right for texts of plain characters; None if there is none."""
    for a, b in ((r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)"), (r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d")):
        pattern = pattern.replace(a, b)
    return None if r"\p" in pattern else re.compile(pattern).findall


class Encoder(dict):
    """Pre-token -> its ids as packed 32-bit integers. Two generations of remembered pre-tokens: the elder one is
    dropped when the younger is full, and what is still in use moves over."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.queue, self.split, self.elder = RankQueue(ranks), regex.compile(pattern).findall, {}
        self.plain_split = plain_pattern(pattern)

    def __missing__(self, piece: str) -> bytes:
        packed = self.elder.get(piece)
        if packed is None:
            packed = array("i", self.queue.merge(piece.encode("utf-8", "replace"))).tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.elder = dict(self)
                self.clear()
            self[piece] = packed
        return packed

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        split = self.split if self.plain_split is None or NOT_PLAIN.search(text) else self.plain_split
        return b"".join(map(self.__getitem__, split(text)))


@lru_cache(maxsize=2)
def encoder_of(rank_file: str, pattern: str) -> Encoder:
    """One for each Python worker, so that its tasks share what it remembers."""
    return Encoder(load_ranks(rank_file), pattern)


@lru_cache(maxsize=2)
def tokens_of(rank_file: str) -> list[bytes]:
    """The bytes of each id."""
    ranks = load_ranks(rank_file)
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, r in ranks.items():
        tokens[r] = token
    return tokens


def forget() -> None:
    encoder_of.cache_clear()
    tokens_of.cache_clear()


def joined(tokens: list[bytes], column: pa.Array) -> pa.Array:
    """The bytes that each list of ids stands for."""
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return pa.array([b"".join(map(tokens.__getitem__, flat[a:b].tolist())) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add the ids of each whole text as array<int>; with `decoded`, also the bytes that these ids decode to, in the
    same pass. rank_file must exist on every executor."""
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType()))]
    fields += [T.StructField(decoded, T.BinaryType())] if decoded else []

    def make():
        claim("bpe", forget)
        encoder, tokens = encoder_of(rank_file, pattern), tokens_of(rank_file) if decoded else []

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            packed = [encoder(t.as_py()) for t in batch.column(batch.schema.get_field_index(text))]
            offsets = np.zeros(len(packed) + 1, np.int32)
            np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            return [lists, joined(tokens, lists)] if decoded else [lists]

        return step

    return add_with_arrow(df, fields, make, keep)


def decode(df: DataFrame, rank_file: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for. Null ids give no bytes."""

    def make():
        claim("bpe", forget)
        tokens = tokens_of(rank_file)
        return lambda batch: [joined(tokens, batch.column(batch.schema.get_field_index(ids)))]

    return add_with_arrow(df, [T.StructField(out, T.BinaryType())], make)

r"""Byte-level BPE with a rank queue: a hierarchical bitmap over merge ranks.

``RankQueue`` keeps, for every merge rank, a bucket of positions in a linked list of the pre-token's parts.
Three levels of 64-bit words say which buckets hold something, so find-first-set gives the next rank in
three steps, however long the pre-token is.  A merge pushes its two new neighbours' pairs; entries that a
merge has outdated are skipped when they come up.  A pre-token of n bytes costs n log n, not n * n.

Pre-tokens repeat, so each Python worker remembers the ids of those it has met (at most ``CACHE_ENTRIES``
of them; then it starts anew).  Most spaces of a text start a new pre-token whatever stands around them, so
the text is cut there first and whole pieces are remembered; the pattern runs only over new pieces.

Defined results: a null text is empty and has no ids.  Special tokens are ordinary text.  Texts are never
cut.  Repeated rows give repeated results; extra columns are kept by ``tokenize``.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

CACHE_ENTRIES = 1_000_000


class RankQueue:
    """Positions by rank; ``take`` finds the least rank by three find-first-sets."""

    __slots__ = ("leaves", "middle", "top", "buckets")

    def __init__(self, n_ranks: int):
        self.leaves = [0] * ((n_ranks >> 6) + 1)
        self.middle = [0] * ((n_ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def put(self, rank: int, bucket: list[int]) -> None:
        """Queue a whole bucket (a heap of positions) under a rank that has none."""
        self.buckets[rank] = bucket
        leaf = rank >> 6
        word = self.leaves[leaf]
        self.leaves[leaf] = word | 1 << (rank & 63)
        if not word:
            mid = rank >> 12
            self.middle[mid] |= 1 << (leaf & 63)
            self.top |= 1 << mid

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.put(rank, [position])
        else:
            heappush(bucket, position)

    def take(self) -> int:
        """Remove the least rank and return it; its bucket is still in ``buckets``.  -1 if there is none."""
        top = self.top
        if not top:
            return -1
        low = top & -top
        mid = low.bit_length() - 1
        word = self.middle[mid]
        bit = word & -word
        leaf = (mid << 6) + bit.bit_length() - 1
        ranks = self.leaves[leaf]
        last = ranks & -ranks
        ranks ^= last
        self.leaves[leaf] = ranks
        if not ranks:
            word ^= bit
            self.middle[mid] = word
            if not word:
                self.top = top ^ low
        return (leaf << 6) + last.bit_length() - 1


class Encoder:
    """Encodes and decodes by a file of ranks (a base64 token and its rank on each line)."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex

        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.find = regex.compile(pattern).findall
        # a space next to white space or at the end may be part of a longer pre-token
        self.unsafe = regex.compile(r"\s \S| \s| \Z").search
        self.queue = RankQueue(len(self.tokens))
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-token: always the lowest rank, and of equal ranks the leftmost."""
        ranks, queue = self.ranks, self.queue
        whole = ranks.get(word)
        if whole is not None:
            return [whole]
        n = len(word)
        push, rank_of = queue.push, ranks.get
        # the part that starts at i ends at end[i]; before[i] is where the part to its left starts
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # rank of the part at i with the one to its right, None if they can't merge
        pair = [rank_of(word[i : i + 2]) for i in range(n - 1)]
        pair.append(None)
        for i, rank in enumerate(pair):
            if rank is not None:
                push(rank, i)
        buckets = queue.buckets
        while (rank := queue.take()) >= 0:
            bucket = buckets.pop(rank)
            while bucket:
                i = heappop(bucket)
                if pair[i] != rank:
                    continue  # stale
                gone = end[i]
                stop = end[i] = end[gone]
                pair[gone] = None
                lower = False
                if stop < n:
                    before[stop] = i
                    new = pair[i] = rank_of(word[i : end[stop]])
                    if new is not None:
                        push(new, i)
                        lower = new < rank
                else:
                    pair[i] = None
                left = before[i]
                if left >= 0:
                    new = pair[left] = rank_of(word[left:stop])
                    if new is not None:
                        push(new, left)
                        lower = lower or new < rank
                if lower and bucket:
                    queue.put(rank, bucket)
                    break
        ids, i = [], 0
        while i < n:
            ids.append(ranks[word[i : end[i]]])
            i = end[i]
        return ids

    def _piece(self, piece: str) -> bytes:
        words, out = self.words, []
        for word in self.find(piece):
            ids = words.get(word)
            if ids is None:
                ids = np.array(self.merge(word.encode()), "<u4").tobytes()
                if len(word) <= 64:
                    if len(words) >= CACHE_ENTRIES:
                        words.clear()
                    words[word] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.unsafe(text):
            return self._piece(text)
        parts = text.split(" ")
        pieces, get = self.pieces, self.pieces.get
        out = [self._piece(parts[0])] if parts[0] else []
        for part in parts[1:]:
            ids = get(part)
            if ids is None:
                ids = self._piece(" " + part)
                if len(part) <= 64:
                    if len(pieces) >= CACHE_ENTRIES:
                        pieces.clear()
                    pieces[part] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in memoryview(ids).cast("I")])


@lru_cache(maxsize=1)
def encoder(ranks_path: str, pattern: str) -> Encoder:
    """One encoder, with what it remembers, per Python worker."""
    return Encoder(ranks_path, pattern)


def tokenize(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of ``text_col`` as an array of integers in ``out_col``; a null text has none."""
    schema = T.StructType([*(f for f in docs.schema if f.name != out_col), T.StructField(out_col, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks_path, pattern)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            ids = [coder.encode(text or "") for text in texts]
            offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            others = [batch.column(i) for i, f in enumerate(batch.schema) if f.name != out_col]
            yield pa.RecordBatch.from_arrays([*others, column], names=schema.names)

    return docs.mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and decode the ids again: ``id, n_tokens, ids_sha256, decoded_sha256`` per row."""
    chosen = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = T.StructType(
        [
            chosen.schema["id"],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks_path, pattern)
        for batch in batches:
            n, ids_sha, decoded_sha = [], [], []
            for text in batch.column(1):
                ids = coder.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                decoded_sha.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                names=schema.names,
            )

    return chosen.mapInArrow(run, schema)

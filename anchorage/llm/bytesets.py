"""Numpy helpers for Arrow batches of texts: whole batches of UTF-8 bytes at once, never one row at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bases of the rolling polynomials, odd, so that they have an inverse modulo 2**64.
BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASES[0]))
_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64, at least n of them."""
    base %= 2**64
    got = next((p for (b, _), p in _powers.items() if b == base and len(p) >= n), None)
    if got is None:
        size = 1 << max(16, int(n - 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        got = np.cumprod(steps)
        for key in [k for k in _powers if k[0] == base]:
            del _powers[key]
        _powers[base, size] = got
    return got[:n]


class SpanHash:
    """Rabin-Karp hashes of any spans of an array: prefix sums of code * base**position, modulo 2**64."""

    def __init__(self, codes: np.ndarray, base: int):
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * powers(base, len(codes)), out=self.sums[1:])
        self.inverse = powers(pow(base, -1, 2**64), len(codes) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.inverse[starts]


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _BYTE_CODES[data]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text; a longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffers(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


#: Masks that keep the first 0 to 8 bytes of a little-endian word.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of a word that are mixed in steps of eight; what is longer gets a digest.
_STEPWISE = 64


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes: eight bytes a step, each step through ``mix``, so not linear in the text."""
    size = ends - starts
    out = mix(size.astype(np.uint64) + np.uint64(BASES[0]))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    # an unaligned view: entry i is the eight bytes from byte i on
    eight = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    at = np.flatnonzero((size > 0) & (size <= _STEPWISE))
    for step in range(0, _STEPWISE, 8):
        if not len(at):
            break
        chunk = eight[starts[at] + step] & _KEEP[np.minimum(size[at] - step, 8)]
        out[at] = mix((out[at] ^ chunk) * np.uint64(BASES[1]) + np.uint64(step + 1))
        at = at[size[at] > step + 8]
    for i in np.flatnonzero(size > _STEPWISE):
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        out[i] = np.frombuffer(digest, "<u8")[0]
    return out


def hash_runs(hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray | int, most: int) -> np.ndarray:
    """Hashes of runs of up to ``most`` hashes, one after the other through ``mix``; ``counts`` are their lengths."""
    counts = np.broadcast_to(np.asarray(counts), starts.shape)
    out = mix(counts.astype(np.uint64) + np.uint64(BASES[1]))
    for step in range(most):
        if counts.size and counts.min() > step:
            out = mix((out ^ hashes[starts + step]) * np.uint64(BASES[0]) + np.uint64(step + 1))
        else:
            at = np.flatnonzero(counts > step)
            out[at] = mix((out[at] ^ hashes[starts[at] + step]) * np.uint64(BASES[0]) + np.uint64(step + 1))
    return out


class Words:
    r"""The words of a batch, by default ``[^\x20\x09-\x0D]+``: ``starts``, ``ends`` in bytes and ``doc``, the row of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR):
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = ~separator[data]
        first = np.zeros(n + 1, bool)  # a text begins here, so that words never cross texts
        first[offsets] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        self.starts = np.flatnonzero(inside & (~before | first[:n]))
        self.ends = np.flatnonzero(inside & (~after | first[1:])) + 1
        #: words of row i are bounds[i]:bounds[i + 1]
        self.bounds = np.searchsorted(self.starts, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, data: np.ndarray | None = None) -> np.ndarray:
        return hash_spans(self.data if data is None else data, self.starts, self.ends)

    def windows(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the n words from each word on, whether they are in one text)."""
        if len(self) < n:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        at = np.arange(len(self) - n + 1)
        return hash_runs(hashes, at, n, n), self.doc[: len(at)] == self.doc[n - 1 :]


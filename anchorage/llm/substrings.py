r"""Substring dedup: Rabin-Karp hashes of every window of n words, counted in Spark.

Each task hashes all windows of its texts and deals them by hash to ``partitions`` buckets, packed: of a
window there is what the bucket leaves open of its hash, and its place among the task's words as a difference.  A bucket sees every occurrence of its windows, so it knows the smallest document of each;
occurrences in other documents go back to the chunk of texts that sent them, packed.  There a document's
windows merge into maximal removal intervals.

A window with a third of all occurrences is not a hot key: a task sends a window once per occurrence, in
arrays, and a bucket handles arrays.  Buckets are as many as the session's shuffle partitions, so what one
task holds (some 30 bytes a window) is set by that, as for any sort.

Words are ``[^\x20\x09-\x0D]+``.  Windows are compared by all 64 bits of a hash: the bucket is the remainder by
``partitions``, and the quotient is what is packed, in 8 bytes, or 7 from 256 partitions on.

Defined results: null and empty texts have no words.  Documents with fewer words than a window lose
nothing.  Rows with the same id count as one document: they don't take words from each other.  Rows with a
null id take nothing and lose nothing.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import Words, slices, text_buffers

#: Windows that a task packs at a time.
_FLUSH = 2_000_000


def _split(hashes: np.ndarray, partitions: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, rest) of each hash; both together are the hash."""
    return hashes % np.uint64(partitions), hashes // np.uint64(partitions)


def _rest_bytes(partitions: int) -> int:
    return -(-((2**64 - 1) // partitions).bit_length() // 8)


def _pack(width: int, rests: np.ndarray, places: np.ndarray, ids: np.ndarray, words: np.ndarray) -> bytes:
    """One bucket's part of a task: ``width`` bytes of each hash's rest, gaps between places, and the documents (ids, word counts) that occur."""
    of = np.searchsorted(np.cumsum(words), places, "right")
    used, counts = np.unique(of, return_counts=True)
    begins = (np.cumsum(words) - words)[used]
    within = places - np.repeat(begins, counts)
    gaps = np.diff(within, prepend=0)
    firsts = np.cumsum(counts) - counts
    gaps[firsts] = within[firsts]
    small = np.minimum(gaps, 65535).astype("<u2")
    large = gaps[gaps >= 65535].astype("<u4")
    head = np.array([len(rests), len(used), len(large), width], "<u4")
    return b"".join(
        x.tobytes()
        for x in (
            head,
            ids[used].astype("<i8"),
            counts.astype("<u4"),
            rests.astype("<u8").view("u1").reshape(-1, 8)[:, :width],
            small,
            large,
        )
    )


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rest of the hash, document id, first word) of each window."""
    n, used, n_large, width = np.frombuffer(packed, "<u4", 4).tolist()
    at = 16

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(packed, kind, count, at)
        at += got.nbytes
        return got

    ids, counts = take("<i8", used), take("<u4", used).astype(np.int64)
    rests = np.zeros((n, 8), "u1")
    rests[:, :width] = take("u1", n * width).reshape(n, width)
    gaps = take("<u2", n).astype(np.int64)
    gaps[gaps == 65535] = take("<u4", n_large)
    firsts = np.cumsum(counts) - counts
    sums = np.cumsum(gaps)
    return rests.view("<u8").ravel(), np.repeat(ids, counts), sums - np.repeat(sums[firsts] - gaps[firsts], counts)


def _windows(n: int, partitions: int):
    def deal(parts: list, chunk: int) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        hashes, places, ids, words = [], [], [], []
        base = 0
        for h, at, i, w in parts:
            hashes.append(h)
            places.append(at + base)
            ids.append(i)
            words.append(w)
            base += int(w.sum())
        hashes, places = np.concatenate(hashes), np.concatenate(places)
        ids, words = np.concatenate(ids), np.concatenate(words)
        bucket, rests = _split(hashes, partitions)
        order = np.argsort(bucket.astype(np.int32), kind="stable")
        ends = np.cumsum(np.bincount(bucket.astype(np.int64), minlength=partitions))
        for b in range(partitions):
            chosen = order[ends[b - 1] if b else 0 : ends[b]]
            if len(chosen):
                packed = _pack(_rest_bytes(partitions), rests[chosen], places[chosen], ids, words)
                row = [pa.array([b], pa.int32()), pa.array([chunk], pa.int64()), pa.array([packed], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, names=["bucket", "chunk", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, chunk = [], 0, TaskContext.get().partitionId() << 24
        for batch in slices(batches, "text"):
            words = Words(*text_buffers(batch.column(1)))
            hashes, whole = words.windows(words.hashes(), n)
            at = np.flatnonzero(whole)
            if not len(at):
                continue
            parts.append((hashes[at], at, batch.column(0).to_numpy(zero_copy_only=False), np.diff(words.bounds)))
            held += len(at)
            if held >= _FLUSH:
                yield from deal(parts, chunk)
                parts, held, chunk = [], 0, chunk + 1
        yield from deal(parts, chunk)

    return run


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new key begins in sorted ``keys``."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _repeats(rows: pd.DataFrame) -> pd.DataFrame:
    """The windows of one bucket that also start in a smaller document: for each chunk, packed ids and first words."""
    hashes, ids, words = zip(*map(_unpack, rows["packed"]))
    chunks = np.repeat(rows["chunk"].to_numpy(), [len(h) for h in hashes])
    hashes, ids, words = np.concatenate(hashes), np.concatenate(ids), np.concatenate(words)
    order = np.argsort(hashes, kind="stable")
    sorted_ids = ids[order]
    firsts = _runs(hashes[order])
    smallest = np.minimum.reduceat(sorted_ids, firsts)
    later = np.empty(len(ids), bool)
    later[order] = sorted_ids > np.repeat(smallest, np.diff(np.append(firsts, len(ids))))
    chunks, ids, words = chunks[later], ids[later], words[later].astype("<u4")
    order = np.argsort(chunks, kind="stable")
    chunks, ids, words = chunks[order], ids[order], words[order]
    cuts = _runs(chunks)
    ends = np.append(cuts, len(chunks))[1:]
    packed = [ids[a:b].astype("<i8").tobytes() + words[a:b].tobytes() for a, b in zip(cuts, ends)]
    return pd.DataFrame({"chunk": chunks[cuts], "packed": packed})


def _intervals(n: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """For each document of one chunk, the maximal intervals that its repeated windows cover (first words and ends)."""
        counts = [len(p) // 12 for p in rows["packed"]]
        ids = np.concatenate([np.frombuffer(p, "<i8", k) for p, k in zip(rows["packed"], counts)])
        words = np.concatenate([np.frombuffer(p, "<u4", k, 8 * k) for p, k in zip(rows["packed"], counts)]).astype(np.int64)
        order = np.lexsort((words, ids))
        ids, words = ids[order], words[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (words[1:] > words[:-1] + n)
        firsts = np.flatnonzero(new)
        lasts = np.append(firsts, len(ids))[1:] - 1
        pairs = np.stack([words[firsts], words[lasts] + n], axis=1).astype("<u4")
        cuts = _runs(ids[firsts])
        ends = np.append(cuts, len(firsts))[1:]
        return pd.DataFrame({"id": ids[firsts][cuts], "intervals": [pairs[a:b].tobytes() for a, b in zip(cuts, ends)]})

    return run


def repeated_windows(docs: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """``id, intervals``: the word intervals (packed firsts and ends, from 0) covered by windows that also start in a smaller document."""
    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chosen = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text")).filter(F.col("id").isNotNull())
    dealt = chosen.mapInArrow(_windows(n, partitions), "bucket int, chunk bigint, packed binary")
    found = dealt.groupBy("bucket").applyInPandas(_repeats, "chunk bigint, packed binary")
    merged = found.groupBy("chunk").applyInPandas(_intervals(n), "id bigint, intervals binary")
    return merged.groupBy("id").agg(F.collect_list("intervals").alias("intervals"))


def _covered(intervals: list, total: int) -> np.ndarray:
    """Which words of a batch some interval covers: firsts add one, ends take one away."""
    steps = np.zeros(total + 1, np.int32)
    for packed, begin in intervals:
        pairs = np.frombuffer(packed, "<u4").astype(np.int64).reshape(-1, 2) + begin
        steps[pairs[:, 0]] += 1  # the intervals of one array are apart
        steps[pairs[:, 1]] -= 1
    return np.cumsum(steps)[:total] > 0


def _removal():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = text_buffers(batch.column(1))
            words = Words(data, offsets)
            lists = batch.column(2).to_pylist()
            found = [(x, words.bounds[row]) for row, packed in enumerate(lists) if packed for x in packed]
            gone = _covered(found, len(words))
            before = np.concatenate([[0], np.cumsum(gone)])
            left = np.flatnonzero(~gone)
            # maximal intervals of removed words, as first word and end
            edges = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
            begins, ends = np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)
            row = words.doc[begins] if len(begins) else np.zeros(0, int)
            steps = np.zeros(len(data) + 1, np.int32)
            steps[words.starts[left]] += 1
            steps[words.ends[left]] -= 1
            keep = np.cumsum(steps)[: len(data)] > 0
            text = data.copy()
            # one space after each kept word but the last of its text
            joined = left[:-1][words.doc[left[:-1]] == words.doc[left[1:]]] if len(left) else left
            text[words.ends[joined]] = 0x20
            keep[words.ends[joined]] = True
            kept = np.concatenate([[0], np.cumsum(keep)])[offsets]
            body = text[keep]
            intervals = [[] for _ in range(batch.num_rows)]
            for r, a, b in zip(row.tolist(), begins.tolist(), ends.tolist()):
                # an interval that runs on into the next text is cut there
                while b > words.bounds[r + 1]:
                    end = int(words.bounds[r + 1])
                    intervals[r].append({"first": a - int(words.bounds[r]), "end": end - int(words.bounds[r])})
                    a, r = end, int(words.doc[end])
                intervals[r].append({"first": a - int(words.bounds[r]), "end": b - int(words.bounds[r])})
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(words.bounds), pa.int64()),
                    pa.array(np.diff(before[words.bounds]), pa.int64()),
                    pa.array(intervals, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))),
                    pa.array([body[a:b].tobytes().decode() for a, b in zip(kept, kept[1:])], pa.string()),
                ],
                names=["id", "n_words", "n_removed", "intervals", "kept_text"],
            )

    return run


def drop_repeated_substrings(docs: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, n_removed, intervals, kept_text``: removal intervals as words ``first`` to before ``end``."""
    found = repeated_windows(docs, n, id_col, text_col).withColumnRenamed("id", "_of")
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return (
        texts.join(found.hint("shuffle_hash"), F.col("id") == F.col("_of"), "left")
        .select("id", "text", "intervals")
        .mapInArrow(
            _removal(),
            f"id {docs.schema[id_col].dataType.simpleString()}, n_words bigint, n_removed bigint, "
            "intervals array<struct<first:int,end:int>>, kept_text string",
        )
    )


r"""Suffix-array dedup of byte strings by external induced sorting.

Bytes covered by a string of ``length`` bytes that also starts somewhere else are removed.

1. Candidates, exactly.  Every window of ``length`` bytes has a minimizer, its ``GRAM``-byte string of least
   hash; equal windows have it at the same place.  Windows with the same minimizer are one region, some 585
   bytes of text.  Regions are grouped by the minimizer's hash, and equal regions are counted once, by a
   128-bit hash.  A region alone under its minimizer has no repeat; equal regions repeat entirely; only where
   different regions meet has the text to be sorted.
   Those regions are parted by how far a window starts before the minimizer, in steps of ``CLASS`` bytes, and
   grouped again by their core, all that the windows of a part have in common; so edges of a passage that very
   many texts share don't meet in one group.
2. What is left goes to shards by group, and each shard is suffix-sorted by ``induced.repeats`` with
   common-prefix values.  As every window of a part holds its core, cores (some 370 bytes) are replaced by a name
   in characters of their own, a 128-bit hash; so windows are equal as before.  A shard is sorted in memory; only
   long queues go to disk.
3. What is repeated goes back to all occurrences, and per document the windows merge into maximal runs.

Defined results: a null text is empty.  Texts shorter than ``length`` lose nothing.  Rows with the same id
share what they lose, where it lies within their text; rows with a null id lose nothing and make nothing
repeat.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import spread_join
from ..operators.staging import new_folder
from .bytesets import BASES, SpanHash, byte_codes, mix, slices, text_buffers
from .induced import repeats
from .runs import BucketedTable, default_buckets, stage

GRAM = 32
CLASS = 32
#: Least length of the name of a core.
NAME = 16
SHARD_BYTES = 1 << 18
_PLACE_BITS = 34


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row: minima from the left and from the right within blocks."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def regions_of(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, minimizer hash, region hashes, first window, last window, place of the minimizer), windows from the text's start."""
    ends = offsets[1:]
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return (empty,) * 7
    codes = byte_codes(data)
    first, second = SpanHash(codes, BASES[0]), SpanHash(codes, BASES[1])
    at = np.arange(len(data) - GRAM + 1)
    grams = mix(first.of(at, at + GRAM))
    least = sliding_minimum(grams >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS) | at.astype(np.uint64), length - GRAM + 1)
    row = np.repeat(np.arange(len(ends)), np.diff(offsets))[: len(least)]
    windows = np.flatnonzero(np.arange(len(least)) + length <= ends[row])
    if not len(windows):
        return (empty,) * 7
    place = (least[windows] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    new = np.ones(len(windows), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[windows[1:]] != row[windows[:-1]])
    lo = windows[new]
    hi = windows[np.append(np.flatnonzero(new)[1:], len(windows)) - 1]
    place, row = place[new], row[lo]
    inside = mix((place - lo).astype(np.uint64) + np.uint64(1))
    begin = offsets[row]
    return (
        row,
        grams[place].view(np.int64),
        mix(first.of(lo, hi + length) + inside).view(np.int64),
        mix(second.of(lo, hi + length) ^ inside).view(np.int64),
        lo - begin,
        hi - begin,
        place - begin,
    )


def _regions(length: int):
    names = ["gram", "r1", "r2", "id", "lo", "hi", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            row, gram, r1, r2, lo, hi, place = regions_of(*text_buffers(batch.column(1)), length)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[row]
            columns = [gram, r1, r2, ids, lo.astype(np.int32), hi.astype(np.int32), place.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return run


def _longs(*parts: bytes) -> tuple[int, int]:
    digest = hashlib.blake2b(digest_size=16)
    for part in parts:
        digest.update(part)
    raw = digest.digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _parts(length: int):
    """Regions of a batch of documents, parted by how far a window's start lies before the minimizer."""
    names = ["key", "c1", "c2", "r1", "r2", "id", "begin", "first", "last", "n", "left", "core"]
    farthest = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for id_, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                raw = (text or "").encode()
                for w in wanted:
                    lo, hi, place = w["lo"], w["hi"], w["place"]
                    for near in range((place - hi) // CLASS * CLASS, place - lo + 1, CLASS):
                        far = min(near + CLASS - 1, farthest)
                        begin, last = max(lo, place - far), min(hi, place - near)
                        # what every window of this class has around the minimizer
                        key = _longs(b"%d:" % near, raw[place - near : place + length - far])[0]
                        content = _longs(b"%d:" % (place - begin), raw[begin : last + length])
                        core = place - near - begin, length - far + near
                        out.append((key, *content, w["r1"], w["r2"], id_, begin, begin - lo, last - lo, w["n"], *core))
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    return run


def _bodies(length: int):
    """Parts with a name for their core, as long as makes all windows ``CLASS - 1 + NAME`` long."""
    names = ["key", "c1", "c2", "n", "left", "named", "body"]
    kinds = [pa.int64()] * 6 + [pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                raw = (text or "").encode()
                for w in wanted:
                    begin = w["begin"] + w["left"]
                    end = begin + w["core"]
                    name = hashlib.blake2b(raw[begin:end], digest_size=NAME).digest() + bytes(CLASS - 1 - length + w["core"])
                    body = raw[w["begin"] : begin] + name + raw[end : w["begin"] + w["windows"] + length - 1]
                    out.append((w["key"], w["c1"], w["c2"], w["n"], w["left"], len(name), body))
                if len(out) >= 5_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return run


def _sort_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """The repeated windows of the parts of one shard that have no equal, as intervals of window starts."""
    out = []
    left, named = rows["left"].to_numpy(), rows["named"].to_numpy()
    for i, starts in repeats(rows["body"].tolist(), CLASS - 1 + NAME, named=(left, left + named)).items():
        if rows["n"].iat[i] == 1:
            cuts = np.flatnonzero(np.diff(starts) > 1) + 1
            begins, ends = starts[np.append(0, cuts)], starts[np.append(cuts, len(starts)) - 1]
            out.append((rows["key"].iat[i], rows["c1"].iat[i], rows["c2"].iat[i], begins.tolist(), ends.tolist()))
    return pd.DataFrame(out, columns=["key", "c1", "c2", "a", "b"])


def _by_document(rows: DataFrame, id_col: str, fields: list) -> DataFrame:
    return rows.groupBy(F.col(id_col).alias("_of")).agg(F.collect_list(F.struct(*fields)).alias("wanted"))


def repeated_bytes(docs: DataFrame, length: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(texts by id, ``id, runs``): runs are intervals of bytes that repeated windows cover, in any order."""
    spark = docs.sparkSession
    texts = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text"))
    # read by id three times below: one shuffle serves all
    table = BucketedTable(spark, new_folder(spark, "texts"), "id BIGINT, text STRING", ["id"], default_buckets(spark))
    table.append(texts)
    schema = "gram bigint, r1 bigint, r2 bigint, id bigint, lo int, hi int, place int"
    regions = stage(texts.filter(F.col("id").isNotNull()).mapInArrow(_regions(length), schema), "regions")

    kinds = regions.groupBy("gram", "r1", "r2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "lo", "hi", "place")).alias("one"))
    per_gram = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("total")).filter(F.col("total") > 1)
    kinds = stage(kinds.join(per_gram, "gram").select("r1", "r2", "n", "kinds", "one"), "kinds")

    wanted = _by_document(kinds.filter(F.col("kinds") > 1), "one.id", ["one.lo", "one.hi", "one.place", "r1", "r2", "n"])
    wide = "key bigint, c1 bigint, c2 bigint, r1 bigint, r2 bigint, id bigint, begin bigint, first bigint, last bigint, n bigint, left bigint, core bigint"
    parts = table.read().join(wanted.hint("shuffle_hash"), F.col("id") == F.col("_of")).select("id", "text", "wanted")
    parts = stage(parts.mapInArrow(_parts(length), wide), "parts")
    part = ["key", "c1", "c2"]
    windows = (F.col("last") - F.col("first") + 1).alias("windows")
    contents = parts.groupBy(*part).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.min(F.struct("id", "begin", windows, "left", "core")).alias("one"))
    open_keys = contents.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
    open_keys = open_keys.filter((F.col("kinds") > 1) & (F.col("least") == 1)).select("key", F.lit(True).alias("open"))
    contents = stage(contents.join(open_keys, "key", "left").filter(F.col("open") | (F.col("n") > 1)), "contents")

    wanted = _by_document(contents.filter("open"), "one.id", [*part, "n", "one.begin", "one.windows", "one.left", "one.core"])
    bodies = table.read().join(wanted.hint("shuffle_hash"), F.col("id") == F.col("_of")).select("text", "wanted")
    bodies = stage(bodies.mapInArrow(_bodies(length), "key bigint, c1 bigint, c2 bigint, n bigint, left bigint, named bigint, body binary"), "bodies")
    shards = max(1, (bodies.agg(F.sum(F.octet_length("body"))).first()[0] or 0) // SHARD_BYTES)
    intervals = "a array<bigint>, b array<bigint>"
    # the sort takes far longer than its bytes tell, so its tasks are not to be put together
    found = bodies.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).repartition(default_buckets(spark), "shard")
    found = found.groupBy("shard").applyInPandas(_sort_shard, f"key bigint, c1 bigint, c2 bigint, {intervals}")
    found = found.withColumn("rows", F.lit(1).cast("bigint")).unionByName(
        contents.filter(F.col("n") > 1).select(*part, F.array(F.lit(0).cast("bigint")).alias("a"), F.array(F.col("one.windows") - 1).alias("b"), "rows")
    )
    found = stage(found, "found")
    met = spread_join(parts.filter(F.col("n") == 1).select(*part, "r1", "r2", "first"), found.drop("rows"), part, found, "rows", ["r1", "r2"])
    moved = [F.transform(c, lambda x: x + F.col("first")).alias(c) for c in ("a", "b")]
    partly = met.filter(F.col("a").isNotNull()).select("r1", "r2", *moved).groupBy("r1", "r2")
    partly = partly.agg(F.flatten(F.collect_list("a")).alias("a"), F.flatten(F.collect_list("b")).alias("b"), F.lit(1).cast("bigint").alias("n"))
    whole = kinds.filter(F.col("n") > 1).select(
        "r1", "r2", F.array(F.lit(0).cast("bigint")).alias("a"), F.array((F.col("one.hi") - F.col("one.lo")).cast("bigint")).alias("b"), "n"
    )
    repeated = stage(whole.unionByName(partly), "repeated")
    met = spread_join(regions.select("r1", "r2", "id", "lo"), repeated.drop("n"), ["r1", "r2"], repeated, "n", ["id", "lo"])
    run = F.struct((F.col("lo") + F.col("w.a")).alias("begin"), (F.col("lo") + F.col("w.b") + length).alias("end"))
    runs = met.filter(F.col("a").isNotNull()).select("id", F.explode(F.arrays_zip("a", "b")).alias("w"), "lo")
    runs = runs.groupBy(F.col("id").alias("_of")).agg(F.collect_list(run).alias("runs"))
    return table.read(), runs


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "n_bytes", "n_removed", "runs", "kept"]
    for batch in slices(batches, "text"):
        data, offsets = text_buffers(batch.column(1))
        lists = batch.column(2)
        row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        flat = pc.list_flatten(lists)
        begin, end = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) + offsets[row] for i in (0, 1))
        inside = end <= offsets[1:][row]  # not so for rows that share an id and differ in text
        steps = np.bincount(begin[inside], minlength=len(data) + 1) - np.bincount(end[inside], minlength=len(data) + 1)
        gone = np.cumsum(steps)[: len(data)] > 0
        # maximal runs of removed bytes, cut where texts meet
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        opens = gone.copy()
        opens[1:] &= ~gone[:-1] | first[1:-1]
        closes = gone.copy()
        closes[:-1] &= ~gone[1:] | first[1:-1]
        begins, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        of = np.searchsorted(offsets, begins, "right") - 1
        per_row = np.bincount(of, minlength=batch.num_rows)
        spans = pa.StructArray.from_arrays(
            [pa.array((x - offsets[of]).astype(np.int32)) for x in (begins, ends)], names=["begin", "end"]
        )
        kept = np.concatenate([[0], np.cumsum(~gone)])[offsets]
        body = data[~gone].tobytes()
        size = np.diff(offsets)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(size, pa.int64()),
                pa.array(size - np.diff(kept), pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)), spans),
                pa.array([body[a:b] for a, b in zip(kept, kept[1:])], pa.binary()),
            ],
            names=names,
        )


def drop_repeated_bytes(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_removed, runs, kept``: ``runs`` are the removed byte intervals, ``kept`` the remaining bytes."""
    texts, runs = repeated_bytes(docs, length, id_col, text_col)
    joined = texts.join(runs.hint("shuffle_hash"), F.col("id") == F.col("_of"), "left").select("id", "text", "runs")
    return joined.mapInArrow(_remove, "id bigint, n_bytes bigint, n_removed bigint, runs array<struct<begin:int,end:int>>, kept binary")

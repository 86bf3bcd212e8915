"""Sharding by a Feistel permutation of global row numbers.

Rows get global numbers in the order of id and text, from a range-partitioned sort and the row counts of
its partitions.  A keyed Feistel network permutes the numbers: its domain is the next power of four, and a
number that falls outside ``0 .. n - 1`` is encrypted again until it falls inside (cycle walking), which
keeps it a permutation of exactly the ``n`` rows.  Place ``p`` of the shuffle is slot ``p // shards`` of
shard ``p % shards``, so shards differ by one row at most, slots have no gaps, and both directions are
computed without a table: ``Shuffle.place(row)`` and ``Shuffle.row(shard, slot)``.

Defined results: the same rows give the same shards however they are partitioned, and another ``seed``
another shuffle.  A null or empty text has no bytes (size 16, checksum 0).  Rows that repeat id and text
have places of their own and are interchangeable; null ids come first.  An empty table gives no rows.
Very long texts only pass through a checksum.  Extra columns are ignored by ``assign_shards`` and kept by
``write_shards``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytesets import mix
from .columns import free_name
from .runs import stage

HEADER_BYTES = 16
ROUNDS = 8
_GOLDEN = 0x9E3779B97F4A7C15


class Shuffle:
    """A reproducible permutation of ``0 .. rows - 1``, dealt to ``shards``."""

    def __init__(self, rows: int, shards: int, seed: int = 0, rounds: int = ROUNDS):
        if shards < 1:
            raise ValueError("shards must be at least 1")
        self.rows, self.shards, self.rounds = rows, shards, rounds
        self.half = max(1, ((max(rows, 2) - 1).bit_length() + 1) // 2)
        self.keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(_GOLDEN) ^ mix(np.array([seed % 2**64], np.uint64)))

    def _network(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        bits, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> bits, x & mask
        for key in keys:
            left, right = right, left ^ (mix(right ^ key) & mask)
        # the halves change places, so that the reversed keys undo the rounds
        return right << bits | left

    def _walk(self, numbers: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = self._network(np.asarray(numbers).astype(np.uint64), keys)
        outside = np.flatnonzero(out >= self.rows)
        while len(outside):
            out[outside] = self._network(out[outside], keys)
            outside = outside[out[outside] >= self.rows]
        return out.astype(np.int64)

    def place(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shard, slot) of row numbers."""
        at = self._walk(rows, self.keys)
        return at % self.shards, at // self.shards

    def row(self, shard: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """The row numbers at given shards and slots."""
        return self._walk(np.asarray(slot) * self.shards + np.asarray(shard), self.keys[::-1])


def number_rows(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their global numbers from 0 in the order of the columns ``order``, as column ``name``.

    Ties are numbered in any order.  They go to more than one task, since the place in the input is the
    last key; which of them gets which number can differ if the input is partitioned differently.
    """
    part, at, tie = (free_name(rows, n) for n in ("part", "at", "tie"))
    keyed = rows.withColumn(tie, F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in [*order, tie]]
    # the id of a sorted partition's row: the partition above bit 33, the place in it below
    placed = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(tie).withColumn(at, F.monotonically_increasing_id())
    placed = stage(placed.withColumn(part, F.shiftright(at, 33)).withColumn(at, F.col(at).bitwiseAND((1 << 33) - 1)), "numbered")
    # one row a partition of the sort, whatever the number of rows
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(part, before.alias(name))
    return placed.join(F.broadcast(offsets), part).withColumn(name, F.col(name) + F.col(at)).drop(part, at)


def _places(shuffle: Shuffle):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, slot = shuffle.place(batch.column(batch.schema.get_field_index("row")).to_numpy(zero_copy_only=False))
            columns = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(shard.astype(np.int32)), pa.array(slot)], names=[*batch.schema.names, "shard", "slot"]
            )

    return run


def assign_shards(
    docs: DataFrame, shards: int = 40, seed: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, size, crc, row, shard, slot``, one row per row of ``docs``.

    ``size`` is the text's UTF-8 bytes and a header, ``crc`` the CRC-32 of these bytes, ``row`` the global
    row number in the order of id, checksum and hash of the text.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    slim = docs.select(
        docs[id_col].alias("id"),
        (F.octet_length(text) + HEADER_BYTES).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("hash"),
    )
    numbered = number_rows(slim, ["id", "crc", "size", "hash"], "row").select("id", "size", "crc", "row")
    shuffle = Shuffle(numbered.count(), shards, seed)
    id_type = numbered.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, size bigint, crc bigint, row bigint, shard int, slot bigint"
    return numbered.mapInArrow(_places(shuffle), schema)


def write_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` as Parquet folders ``shard=0 ..``, each row with its ``slot``; a file holds a range of slots in order.

    Ids have to be unique here, as they carry the place to the row; for a repeated id this raises.
    """
    for taken in ("shard", "slot"):
        if taken in docs.columns:
            raise ValueError(f"column {taken} is added here")
    placed = assign_shards(docs, shards, seed, id_col, text_col)
    if not placed.groupBy("id").count().filter("count > 1").isEmpty():
        raise ValueError(f"{id_col} has to be unique")
    key = free_name(docs, "id")
    places = placed.select(F.col("id").alias(key), "shard", "slot")
    joined = docs.join(places, docs[id_col].eqNullSafe(places[key])).drop(key)
    # ranges of slots, so that a shard is as many files as its size asks for
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

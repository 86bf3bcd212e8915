import zlib
from collections import Counter

import numpy as np
import pytest

from anchorage.llm.queries import op13_sharding
from anchorage.llm.sharding import Shuffle, assign_shards, number_rows, write_shards

M = 2**64


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % M
    x = (x ^ x >> 27) * 0x94D049BB133111EB % M
    return x ^ x >> 31


def place(row, rows, shards, seed=0):
    """The walk of one row number in plain integers."""
    half = max(1, ((max(rows, 2) - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    keys = [mixed(i * 0x9E3779B97F4A7C15 % M ^ mixed(seed)) for i in range(1, 9)]
    while True:
        left, right = row >> half, row & mask
        for key in keys:
            left, right = right, left ^ mixed(right ^ key) & mask
        row = right << half | left
        if row < rows:
            return row % shards, row // shards


@pytest.mark.parametrize("rows", [1, 2, 3, 16, 17, 1000, 4097])
def test_permutation_both_ways(rows):
    shuffle = Shuffle(rows, 7, seed=5)
    shard, slot = shuffle.place(np.arange(rows))
    assert [(int(a), int(b)) for a, b in zip(shard, slot)] == [place(r, rows, 7, 5) for r in range(rows)]
    assert sorted(slot * 7 + shard) == list(range(rows))
    assert (shuffle.row(shard, slot) == np.arange(rows)).all()


def test_seeds_differ_and_order_is_lost():
    at = [np.stack(Shuffle(10_000, 40, seed).place(np.arange(10_000))) for seed in (0, 0, 1)]
    assert (at[0] == at[1]).all() and (at[0] != at[2]).mean() > 0.9
    place_of = at[0][1] * 40 + at[0][0]
    assert abs(np.corrcoef(place_of, np.arange(10_000))[0, 1]) < 0.05


def check(rows, shards, total):
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) <= set(range(shards)) and sum(sizes.values()) == total
    full = [sizes[s] for s in range(shards)]
    assert max(full) - min(full) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(full[s]))


def test_query_over_the_whole_table(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    rows = op13_sharding(spark, sf).collect()
    check(rows, 40, len(docs))
    ranks = {d: i for i, d in enumerate(sorted(docs))}
    for r in rows:
        body = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(body) + 16, zlib.crc32(body), "rows", None)
        assert (r["shard"], r["slot"]) == place(ranks[r["doc_id"]], len(docs), 40)


def test_reproducible_however_partitioned(spark, frame):
    docs = frame([(i * 7 % 1000, f"text {i}") for i in range(1000)])
    once = {tuple(r) for r in assign_shards(docs.repartition(3), 9).collect()}
    assert once == {tuple(r) for r in assign_shards(docs.repartition(11), 9).collect()}


def test_repeated_rows_nulls_and_hot_ids(spark, frame):
    rows = [(5, "same")] * 2000 + [(None, None)] * 5 + [(i, "" if i % 2 else "x") for i in range(100)]
    found = assign_shards(frame(rows), 6).collect()
    check(found, 6, len(rows))
    assert Counter((r["id"], r["size"]) for r in found) == Counter((i, len(t or "") + 16) for i, t in rows)


def test_numbers_are_gapless_and_ties_are_split(spark, frame):
    numbered = number_rows(frame([(1, "t")] * 50_000).repartition(8), ["doc_id", "text"], "row")
    assert sorted(r["row"] for r in numbered.select("row").collect()) == list(range(50_000))
    assert numbered.columns[-1] == "row"


def test_empty_table(frame):
    assert assign_shards(frame([])).count() == 0


def test_written_shards_are_in_slot_order(spark, frame, tmp_path):
    docs = frame([(i, f"t{i}") for i in range(300)]).drop("id")
    write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {"doc_id", "text", "lang", "shard", "slot"} <= set(back.columns) and back.count() == 300
    check(back.collect(), 4, 300)
    with pytest.raises(ValueError):
        write_shards(frame([(1, "a"), (1, "b")]), str(tmp_path / "again"), 4)

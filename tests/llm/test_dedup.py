"""Exact, line, substring and suffix dedup against plain versions of the same rules."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from anchorage.llm import induced, suffixes
from anchorage.llm.bytesets import SpanHash
from anchorage.llm.exact import DigestIndex, exact_duplicates, keep_distinct
from anchorage.llm.induced import repeats, suffix_array
from anchorage.llm.lines import LineRuns, drop_repeated_lines
from anchorage.llm.queries import op8_suffix_dedup
from anchorage.llm.substrings import _pack, _rest_bytes, _split, _unpack, drop_repeated_substrings
from anchorage.llm.suffixes import drop_repeated_bytes
from llm_samples import prose

BLANKS = " \t\n\x0b\f\r"
SHARED = prose(77, 80)
ROWS = [
    (5, prose(1, 120) + "\n" + SHARED),
    (3, SHARED + " " + prose(2, 60)),
    (9, prose(1, 120) + "\n" + SHARED),
    (2, None),
    (4, ""),
    (7, " \t\r\n \x0b"),
    (8, "  A SHORT line, long enough \nx\nx\n"),
    (11, "a short LINE, long enough\nÉTÉ à la plage, été\n" + SHARED),
    (12, "éTÉ à la plage, été\nété à la plage, été"),
    (13, "🙂" * 300 + SHARED + "🙂" * 300),
    (14, "🙂" * 299 + "x"),
    (15, prose(3, 20000)),
    (16, "q" * 3000),
    (None, SHARED),
    (None, SHARED),
]


@pytest.fixture(scope="module")
def docs(frame):
    return frame(ROWS)


def sha(raw):
    return hashlib.sha256(raw if isinstance(raw, bytes) else raw.encode()).hexdigest()


def test_exact(docs):
    got = sorted((r.id is None, r.id or 0, r.keep_id, r.group_size, r.kept) for r in exact_duplicates(docs, rows_per_task=1).collect())
    texts = [(i, t or "") for i, t in ROWS]
    size = Counter(t for _, t in texts)
    newest = {t: max((i for i, u in texts if u == t and i is not None), default=None) for _, t in texts}
    assert got == sorted((i is None, i or 0, newest[t], size[t], i == newest[t]) for i, t in texts)
    kept = keep_distinct(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 3, 4, 7, 8, 9, 11, 12, 13, 14, 15, 16]


def test_exact_index_over_batches(spark, frame, tmp_path):
    path = str(tmp_path / "index")
    first = DigestIndex(spark, path, 3).add(frame([(1, "a"), (2, "b"), (3, "a")]), "monday")
    assert {(r.id, r.keep_id, r.kept) for r in first.collect()} == {(1, 3, False), (2, 2, True), (3, 3, True)}
    again = DigestIndex(spark, path, 7)  # opened anew: an index keeps its own number of buckets
    assert again.table.buckets == 3
    with pytest.raises(ValueError):
        DigestIndex(spark, path, id_type="string")
    later = frame([(9, "a"), (8, "c")])
    for _ in range(2):  # a batch that is repeated after a failure
        assert {(r.id, r.keep_id, r.kept) for r in again.add(later, "tuesday").collect()} == {(9, 3, False), (8, 8, True)}
    assert again.table.read().count() == 3


def test_lines(docs):
    texts = [(i, (t or "").split("\n")) for i, t in ROWS]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(BLANKS).translate(low)
    owner = {}
    for i, lines in texts:
        for line in lines if i is not None else []:
            owner[key(line)] = min(owner.get(key(line), i), i)
    expected = []
    for i, lines in texts:
        kept = [x for x in lines if i is None or len(key(x)) < 10 or owner[key(x)] == i]
        expected.append((i or -1, len(lines), len(lines) - len(kept), "\n".join(kept)))
    for batches, fanout in ((1, 2), (4, 2)):
        got = drop_repeated_lines(docs, batches=batches, fanout=fanout)
        assert sorted((r.id or -1, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()) == sorted(expected)


def test_line_runs_are_compacted(spark, tmp_path):
    runs = LineRuns(spark, str(tmp_path / "runs"), 2, fanout=2)
    for n in range(5):
        runs.add(spark.createDataFrame([(n, n, 10 + n)], "h1 bigint, h2 bigint, owner bigint"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    keys = spark.createDataFrame([(0, 0), (4, 4), (3, 4)], "h1 bigint, h2 bigint")
    assert {(r.h1, r.owner) for r in runs.owners(keys).collect()} == {(0, 10), (4, 14), (3, None)}


def test_substrings(docs):
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in ROWS]
    owner = {}
    for i, w in texts:
        for k in range(len(w) - 12 if i is not None else 0):
            owner[tuple(w[k : k + 13])] = min(owner.get(tuple(w[k : k + 13]), i), i)
    expected = []
    for i, w in texts:
        gone = {x for k in range(len(w) - 12) if i is not None and owner[tuple(w[k : k + 13])] < i for x in range(k, k + 13)}
        expected.append((i or -1, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = drop_repeated_substrings(docs).collect()
    assert sorted((r.id or -1, r.n_words, r.n_removed, r.kept_text) for r in got) == sorted(expected)
    for r in got:
        assert sum(x.end - x.first for x in r.intervals) == r.n_removed
        assert all(a.end < b.first for a, b in zip(r.intervals, r.intervals[1:]))


@pytest.mark.parametrize("partitions", [1, 12, 48, 64, 200, 256, 3000, 1 << 17])
def test_window_hashes_are_compared_whole(partitions):
    """Hashes that differ in their first byte only, and others, stay apart by what a bucket and its rows hold."""
    hashes = np.random.default_rng(1).integers(0, 2**64, 50, np.uint64)
    hashes = np.concatenate([hashes ^ np.uint64(k << 56) for k in range(256)])
    bucket, rests = _split(hashes, partitions)
    back, ids, words = _unpack(_pack(_rest_bytes(partitions), rests, np.arange(len(rests)), np.array([7, 8]), np.array([100, len(rests)])))
    assert (back.astype(object) * partitions + bucket == hashes).all() and len(set(zip(bucket.tolist(), back.tolist()))) == len(hashes)
    assert ids.tolist() == [7] * 100 + [8] * (len(rests) - 100) and words[:3].tolist() == [0, 1, 2] and words[100] == 0


def test_bytes(docs):
    texts = [(i, (t or "").encode()) for i, t in ROWS]
    seen = Counter(raw[k : k + 400] for i, raw in texts if i is not None for k in range(len(raw) - 399))
    expected = []
    for i, raw in texts:
        gone, end = bytearray(len(raw)), 0
        for k in range(len(raw) - 399 if i is not None else 0):
            if seen[raw[k : k + 400]] > 1:
                gone[max(k, end) : k + 400] = b"\x01" * (k + 400 - max(k, end))
                end = k + 400
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        expected.append((i or -1, len(raw), sum(gone), spans, sha(kept)))
    got = drop_repeated_bytes(docs).collect()
    assert sorted((r.id or -1, r.n_bytes, r.n_removed, len(r.runs), sha(bytes(r.kept))) for r in got) == sorted(expected)


def test_passages_of_over_50_words_go_from_400_bytes_on(frame, tmp_path):
    """The contract counts bytes, not words: 57 shared words go with 400 bytes, and stay with 399."""
    passage = lambda c: " " + " ".join(f"{c}{k:05}" for k in range(57)) + " "
    whole, short = passage("w"), passage("s")[:-1]
    assert (len(whole), len(short)) == (400, 399)
    rows = [(1, "a" + whole + "a"), (2, "b" + whole + "b"), (3, "c" + short + "c"), (4, "d" + short + "d")]
    frame(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = op8_suffix_dedup(frame(rows).sparkSession, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in got) == [(1, 402, 400, 1), (2, 402, 400, 1), (3, 401, 0, 0), (4, 401, 0, 0)]


def test_suffix_arrays():
    import random

    import numpy as np

    rnd = random.Random(11)
    for _ in range(300):
        s = [rnd.randint(1, rnd.choice([1, 2, 5])) for _ in range(rnd.randint(0, 30))] * rnd.randint(1, 3) + [0]
        order, shared = suffix_array(np.array(s), cap := rnd.choice([3, 50]), held=rnd.choice([2, 1000]))
        expected = sorted(range(len(s)), key=lambda i: s[i:])
        assert order.tolist() == expected
        for a, b, k in zip(expected, expected[1:], shared.tolist()[1:]):
            common = next((n for n, (x, y) in enumerate(zip(s[a:], s[b:])) if x != y), len(s))
            assert k == min(cap, common)
    assert {i: x.tolist() for i, x in repeats([b"abcab", b"", b"xxbca"], 2).items()} == {0: [0, 1, 2, 3], 2: [2, 3]}


def test_named_bytes_are_characters_of_their_own():
    bodies = [b"abNNcd", b"xbNNcd", b"ab\0NNc", b"NNbNNc"]
    named = (np.array([2, 2, 3, 3]), np.array([4, 4, 5, 5]))
    assert {i: x.tolist() for i, x in repeats(bodies, 4, named=named).items()} == {0: [1, 2], 1: [1, 2], 3: [2]}


def test_parts_hold_a_name_instead_of_their_core():
    """What is sorted of a part are its edges, 31 bytes at each end, and a name of 16 to 47 bytes."""
    text = "".join(f"{k:x}," for k in range(300))
    wanted = [{"key": 1, "c1": 2, "c2": 3, "n": 1, "begin": 20, "windows": 32, "left": 31, "core": core} for core in (369, 380)]
    batch = pa.RecordBatch.from_arrays([pa.array([text]), pa.array([wanted])], names=["text", "wanted"])
    first, second = pa.Table.from_batches(suffixes._bodies(400)(iter([batch])))["body"].to_pylist()
    assert (len(first), len(second)) == (31 + 16 + 31, 31 + 27 + 20) and first[:31] == second[:31] == text[20:51].encode()
    assert first[47:] == text[420:451].encode() and second[58:] == text[431:451].encode()


def test_a_text_is_hashed_once(monkeypatch):
    made = []
    monkeypatch.setattr(induced, "SpanHash", lambda *a: made.append(a) or SpanHash(*a))
    suffix_array(np.array([*np.random.default_rng(3).integers(1, 200, 5000), 0]), 50)
    assert len(made) == 1


@pytest.mark.parametrize(
    "operator", [exact_duplicates, drop_repeated_lines, drop_repeated_substrings, drop_repeated_bytes], ids=lambda f: f.__name__
)
def test_empty_table(frame, operator):
    assert operator(frame([])).collect() == []

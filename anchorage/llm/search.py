r"""Ranked lexical search over posting lists that are cut into geometric blocks.

*Index.*  Documents are dealt to segments.  In a segment they are clustered by similarity (cosine to a few
of the segment's own documents as centres), and every term's posting list is put into that order and cut
into blocks, so that a block holds documents that are alike.  Each block of a list stores the coordinatewise
maximum of its documents' impacts over all terms that queries use, rounded up to 8 bits.  Lists of a few
documents need no summary.  One row of the index is one segment.

*Search.*  For a query, the terms of a segment that together cannot reach the query's threshold need no
list.  In the lists of the others a block is skipped only if the query's score of its summary, which bounds
the score of every document in it, is below the threshold; the documents of all other blocks are scored
exactly.  A first round scores the most promising blocks of every segment, and the ``k``-th best score of
each query over all segments is the threshold of the second.  So results are exact, ties included.

Queries are taken in blocks of at most ``terms_per_round`` terms (a longer query is a block of its own), so
what tasks receive, and the width of the summaries, is bounded however many queries there are.  Texts are
read once a block of queries.

Terms are the maximal matches of ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+`` with A-Z in lower case.  The
score is integer: a term's weight is ``floor(1000 * ln((2N + 2) / (2 df + 1)))`` and its impact in a
document ``(10**9 * tf) div (1000 * tf + 12 * m)`` with ``m = 75 + (25 * n * N) div L``.

Defined results: null texts, and texts without a term, are no documents (they do not count in ``N``).  A
query without terms, or whose terms no document holds, has no results.  Terms are compared as bytes, not by
hash.  Rows with a null document id count in the statistics and are never returned; rows that repeat an id
are documents of their own, and queries that repeat an id, or have a null one, are queries of their own.
Of equal scores the smaller id comes first.  Very long texts are one document of one segment.  An empty
table on either side gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytesets import LOWER, Words, hash_spans, slices, text_buffers
from .runs import stage

# The bytes that no term holds.
TERM_BREAKS = np.zeros(256, bool)
TERM_BREAKS[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True

TERMS_PER_ROUND = 20_000
#: Documents of a segment, and cells (documents x terms) that it may have.
SEGMENT_DOCS = 4096
SEGMENT_CELLS = 4 << 20
#: Postings of a block; lists of at most so many have no summary.
BLOCK = 64
SHORT_LIST = 16

_FORWARD = "doc_id bigint, n bigint, terms binary, tfs binary"
_SEGMENT = "docs binary, firsts binary, terms binary, impacts binary, lists binary, posted binary, blocks binary, step bigint, summaries binary"


_CODEC = pa.Codec("zstd", compression_level=1)
#: Rows of some megabytes, packed already: Parquet writes each as it comes, instead of a hundred at a time.
_LARGE_ROWS = {
    "compression": "uncompressed",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size.row.check.min": "1",
    "parquet.block.size.row.check.min": "1",
    "parquet.enable.dictionary": "false",
}


def _packed(array: np.ndarray) -> bytes:
    """An array's size in bytes, and its bytes compressed: summaries are mostly zeros and small numbers."""
    return array.nbytes.to_bytes(8, "little") + _CODEC.compress(np.ascontiguousarray(array), asbytes=True)


def _unpacked(packed: bytes, kind: str) -> np.ndarray:
    data = _CODEC.decompress(memoryview(packed)[8:], int.from_bytes(packed[:8], "little"))
    return np.frombuffer(data, kind)


class Vocabulary:
    """The distinct terms of some queries, found in texts by hash and compared by bytes."""

    def __init__(self, terms: list[bytes]):
        data = np.frombuffer(b"".join(terms), np.uint8)
        ends = np.cumsum([len(t) for t in terms]).astype(np.int64)
        starts = ends - np.array([len(t) for t in terms], np.int64)
        hashes = hash_spans(data, starts, ends)
        order = np.argsort(hashes, kind="stable")
        self.data, self.starts, self.ends = data, starts[order], ends[order]
        self.hashes, self.size = hashes[order], len(terms)
        self.terms = [terms[i] for i in order]
        if len(np.unique(self.hashes)) < self.size:
            raise ValueError("two query terms have the same 64-bit hash")

    def look_up(self, words: Words, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which words are terms of the vocabulary, their numbers)."""
        hashes = hash_spans(data, words.starts, words.ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), self.size - 1)
        found = np.flatnonzero((self.hashes[at] == hashes) & (self.ends[at] - self.starts[at] == words.ends - words.starts))
        number = at[found]
        size = self.ends[number] - self.starts[number]
        # byte by byte: equal hashes alone are no proof
        same = np.ones(len(found), bool)
        step, live = 0, np.arange(len(found))
        while len(live := live[size[live] > step]):
            same[live] &= data[words.starts[found[live]] + step] == self.data[self.starts[number[live]] + step]
            step += 1
        return found[same], number[same]


@dataclass
class Queries:
    """A block of queries: ``ids`` and, for each, the numbers of its terms and how often it holds them."""

    ids: list
    terms: list[np.ndarray]
    times: list[np.ndarray]


def _terms_of(text: Words, data: np.ndarray, row: int) -> list[bytes]:
    lo, hi = text.bounds[row], text.bounds[row + 1]
    return [data[a:b].tobytes() for a, b in zip(text.starts[lo:hi], text.ends[lo:hi])]


def _list_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, terms, times``: the distinct terms of each text."""
    for batch in slices(batches, "text"):
        data, offsets = text_buffers(batch.column(1))
        data = LOWER[data]
        words = Words(data, offsets, TERM_BREAKS)
        terms, times = [], []
        for row in range(batch.num_rows):
            counted = pd.Series(_terms_of(words, data, row), dtype=object).value_counts().sort_index()
            terms.append(list(counted.index))
            times.append(counted.to_numpy().astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(terms, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))], names=["id", "terms", "times"]
        )


def query_blocks(queries: DataFrame, id_col: str, text_col: str, terms_per_round: int) -> Iterator[tuple[Queries, Vocabulary]]:
    """The queries in blocks of at most ``terms_per_round`` terms (or one query), and the terms of each block."""
    id_type = queries.schema[id_col].dataType.simpleString()
    chosen = queries.select(queries[id_col].alias("id"), queries[text_col].alias("text"))
    rows = chosen.mapInArrow(_list_terms, f"id {id_type}, terms array<binary>, times array<bigint>")
    rows = stage(rows.filter(F.size("terms") > 0), "queries")
    held, size = [], 0

    def block() -> tuple[Queries, Vocabulary]:
        vocabulary = Vocabulary(sorted({bytes(t) for row in held for t in row["terms"]}))
        number = {t: i for i, t in enumerate(vocabulary.terms)}
        terms = [np.array([number[bytes(t)] for t in row["terms"]], np.int64) for row in held]
        return Queries([row["id"] for row in held], terms, [np.array(row["times"], np.int64) for row in held]), vocabulary

    # one partition at a time reaches the driver, and a block is given away before the next one begins
    for row in rows.toLocalIterator():
        if held and size + len(row["terms"]) > terms_per_round:
            yield block()
            held, size = [], 0
        held.append(row)
        size += len(row["terms"])
    if held:
        yield block()


def _count_terms(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            data, offsets = text_buffers(batch.column(1))
            data = LOWER[data]
            words = Words(data, offsets, TERM_BREAKS)
            found, number = vocabulary.look_up(words, data)
            cells, tfs = np.unique(words.doc[found] * vocabulary.size + number, return_counts=True)
            doc = cells // vocabulary.size
            bounds = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            terms, tfs = (cells % vocabulary.size).astype("<i4"), tfs.astype("<i8")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(words.bounds).astype(np.int64)),
                    pa.array([terms[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()),
                    pa.array([tfs[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()),
                ],
                names=["doc_id", "n", "terms", "tfs"],
            )

    return run


def _document_frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            data, _ = text_buffers(batch.column(0))
            total += np.bincount(np.frombuffer(data.tobytes(), "<i4"), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["term", "df"])

    return run


@dataclass
class Statistics:
    """``N``, ``L`` and the weights of the terms of a vocabulary."""

    documents: int
    terms: int
    weights: np.ndarray


def statistics(forward: DataFrame, vocabulary: Vocabulary) -> Statistics:
    """Counts over all documents of ``forward``; the driver gets one number a term of the vocabulary."""
    total = forward.filter(F.col("n") > 0).agg(F.count(F.lit(1)).alias("d"), F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()
    counted = forward.select("terms").mapInArrow(_document_frequencies(vocabulary.size), "term int, df bigint")
    df = np.zeros(vocabulary.size, np.int64)
    for row in counted.groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[row["term"]] = row["df"]
    weights = [math.floor(1000 * math.log((2 * total["d"] + 2) / (2 * x + 1))) for x in df.tolist()]
    return Statistics(total["d"], total["t"], np.array(weights, np.int64))


def impact(tf: np.ndarray, n: np.ndarray, stats: Statistics) -> np.ndarray:
    """The integer impact of a term that a document of ``n`` terms holds ``tf`` times."""
    m = 75 + (25 * n * stats.documents) // stats.terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _clustered(cells: np.ndarray) -> np.ndarray:
    """The rows of a matrix in an order that puts those of the same nearest centre next to each other."""
    unit = cells.astype(np.float32, copy=False)
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
    centres = unit[:: max(1, len(unit) // max(1, math.isqrt(len(unit))))]
    near = unit @ centres.T
    nearest = near.argmax(axis=1)
    return np.lexsort((-near[np.arange(len(near)), nearest], nearest))


def _segment(held: list[pa.RecordBatch], size: int, stats: Statistics) -> pa.RecordBatch:
    table = pa.Table.from_batches(held)
    docs, n = (table.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "n"))
    data, offsets = text_buffers(table.column("terms"))
    terms = np.frombuffer(data.tobytes(), "<i4").astype(np.int64)
    counts = np.diff(offsets) // 4
    tfs = np.frombuffer(text_buffers(table.column("tfs"))[0].tobytes(), "<i8")
    row = np.repeat(np.arange(len(docs)), counts)
    impacts = impact(tfs, n[row], stats)
    # 8 bits a cell, rounded up, so that bounds stay bounds
    step = max(1, -(-int(impacts.max(initial=1)) // 255))
    cells = np.zeros((len(docs), size), np.uint8)
    cells[row, terms] = -(-impacts // step)
    order = _clustered(cells * np.sqrt(np.maximum(stats.weights, 1)).astype(np.float32))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    docs, cells = docs[order], cells[order]
    by_doc = np.lexsort((terms, place[row]))
    row, terms, impacts = place[row][by_doc], terms[by_doc], impacts[by_doc]
    firsts = np.searchsorted(row, np.arange(len(docs) + 1))
    by_term = np.lexsort((row, terms))
    posted = row[by_term]
    lists = np.searchsorted(terms[by_term], np.arange(size + 1))
    # the blocks of lists with summaries, list after list
    blocks = np.where(np.diff(lists) > SHORT_LIST, -(-np.diff(lists) // BLOCK), 0)
    summaries = np.zeros((int(blocks.sum()), size), np.uint8)
    at = 0
    for term in np.flatnonzero(blocks):
        mine = posted[lists[term] : lists[term + 1]]
        padded = np.concatenate([mine, np.repeat(mine[-1:], blocks[term] * BLOCK - len(mine))])
        summaries[at : at + blocks[term]] = cells[padded].reshape(blocks[term], BLOCK, size).max(axis=1)
        at += blocks[term]
    columns = [docs, firsts, terms.astype("<i4"), impacts.astype("<i4"), lists, posted.astype("<i4"), np.concatenate([[0], np.cumsum(blocks)])]
    binary = [pa.array([_packed(c)], pa.binary()) for c in columns]
    names = [part.split()[0] for part in _SEGMENT.split(", ")]
    return pa.RecordBatch.from_arrays(
        [*binary, pa.array([step], pa.int64()), pa.array([_packed(summaries)], pa.binary())], names=names
    )


def _segments(size: int, stats: Statistics):
    most = max(1, min(SEGMENT_DOCS, SEGMENT_CELLS // size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, most - rows)
                batch = batch.slice(part.num_rows)
                held.append(part)
                rows += part.num_rows
                if rows == most:
                    yield _segment(held, size, stats)
                    held, rows = [], 0
        if rows:
            yield _segment(held, size, stats)

    return run


class Segment:
    """One row of the index."""

    def __init__(self, row: dict, size: int):
        self.docs, self.firsts, self.lists, self.blocks = (_unpacked(row[c], "<i8") for c in ("docs", "firsts", "lists", "blocks"))
        self.terms, self.impacts, self.posted = (_unpacked(row[c], "<i4") for c in ("terms", "impacts", "posted"))
        self.step = row["step"]
        self.summaries = _unpacked(row["summaries"], "u1").reshape(-1, size)
        # the largest impact of each list, for the choice of lists
        self.largest = np.zeros(size, np.int64)
        np.maximum.at(self.largest, self.terms, self.impacts)

    def candidates(self, terms: np.ndarray, weights: np.ndarray, threshold: int, probe: bool) -> np.ndarray:
        """Documents that may score ``threshold`` or more; with ``probe`` those of the most promising block of each list."""
        bound = weights * self.largest[terms]
        order = np.argsort(bound, kind="stable")
        needed = order[np.cumsum(bound[order]) >= max(threshold, 1)]
        out = [np.zeros(0, np.int64)]
        for term in terms[needed]:
            mine = self.posted[self.lists[term] : self.lists[term + 1]]
            lo, hi = self.blocks[term], self.blocks[term + 1]
            if lo == hi:
                out.append(mine)
                continue
            bounds = (self.summaries[lo:hi, terms].astype(np.int64) * self.step) @ weights
            kept = bounds == bounds.max() if probe else bounds >= threshold
            out.append(mine[np.repeat(kept, BLOCK)[: len(mine)]])
        return np.unique(np.concatenate(out))

    def scores(self, docs: np.ndarray, weight_of: np.ndarray) -> np.ndarray:
        """Exact scores of documents, by their own terms; ``weight_of`` is 0 but for the terms of the query."""
        if not len(docs):
            return np.zeros(0, np.int64)
        counts = self.firsts[docs + 1] - self.firsts[docs]
        ends = np.cumsum(counts)
        at = np.arange(int(ends[-1])) + np.repeat(self.firsts[docs] - (ends - counts), counts)
        sums = np.concatenate([[0], np.cumsum(weight_of[self.terms[at]] * self.impacts[at])])
        return sums[ends] - sums[ends - counts]


class Best:
    """The ``k`` best (score, document) pairs of each query so far, and the score that is needed to be one."""

    def __init__(self, thresholds: np.ndarray, k: int):
        self.k, self.floor = k, thresholds.copy()
        self.scores = [np.zeros(0, np.int64) for _ in thresholds]
        self.docs = [np.zeros(0, np.int64) for _ in thresholds]

    def add(self, query: int, scores: np.ndarray, docs: np.ndarray) -> None:
        good = (scores >= self.floor[query]) & (scores > 0)
        scores, docs = np.concatenate([self.scores[query], scores[good]]), np.concatenate([self.docs[query], docs[good]])
        order = np.lexsort((docs, -scores))[: self.k]
        self.scores[query], self.docs[query] = scores[order], docs[order]
        if len(order) == self.k:
            self.floor[query] = max(self.floor[query], self.scores[query][-1])


def _search(queries: Queries, weights: np.ndarray, thresholds: np.ndarray, k: int, probe: bool):
    size = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(thresholds, k)
        for batch in batches:
            for i in range(batch.num_rows):
                segment = Segment({c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names)}, size)
                for q, (terms, times) in enumerate(zip(queries.terms, queries.times)):
                    here = segment.largest[terms] > 0
                    mine, weighted = terms[here], weights[terms[here]] * times[here]
                    # equal scores still count, as a smaller id goes first
                    docs = segment.candidates(mine, weighted, int(best.floor[q]), probe)
                    weight_of = np.zeros(size, np.int64)
                    weight_of[mine] = weighted
                    best.add(q, segment.scores(docs, weight_of), segment.docs[docs])
        counts = [len(s) for s in best.scores]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(len(counts)), counts).astype(np.int32)),
                pa.array(np.concatenate([np.zeros(0, np.int64), *best.docs])),
                pa.array(np.concatenate([np.zeros(0, np.int64), *best.scores])),
            ],
            names=["query", "doc_id", "score"],
        )

    return run


def build_index(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Statistics]:
    """(segments with the blocked lists of the terms of ``vocabulary``, statistics over all documents), staged."""
    texts = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    forward = stage(texts.mapInArrow(_count_terms(vocabulary), _FORWARD), "forward")
    stats = statistics(forward, vocabulary)
    held = forward.filter(F.col("doc_id").isNotNull() & (F.octet_length("terms") > 0))
    return stage(held.mapInArrow(_segments(vocabulary.size, stats), _SEGMENT), "segments", **_LARGE_ROWS), stats


def _best_of_all(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_index(segments: DataFrame, stats: Statistics, queries: Queries, k: int) -> DataFrame:
    """``query, rank, doc_id, score``: the ``k`` best documents with a score above 0 for each query of a block."""
    found = "query int, doc_id bigint, score bigint"
    none = np.zeros(len(queries.ids), np.int64)
    probed = segments.mapInArrow(_search(queries, stats.weights, none, k, True), found)
    # the k-th best exact score over all segments, so far; one number a query of the block
    lowest = _best_of_all(probed, k).filter(F.col("rank") == k).select("query", "score").collect()
    thresholds = none.copy()
    for row in lowest:
        thresholds[row["query"]] = row["score"]
    return _best_of_all(segments.mapInArrow(_search(queries, stats.weights, thresholds, k, False), found), k)


def rank_documents(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_id_col: str = "item_id",
    query_text_col: str = "text",
    terms_per_round: int = TERMS_PER_ROUND,
) -> DataFrame:
    """``query_id, rank, doc_id, score``: for each query its ``k`` best documents with a score above 0."""
    spark: SparkSession = docs.sparkSession
    id_type = queries.schema[query_id_col].dataType
    out = None
    for block, vocabulary in query_blocks(queries, query_id_col, query_text_col, terms_per_round):
        segments, stats = build_index(docs, vocabulary, id_col, text_col)
        if stats.documents == 0:
            continue
        ranked = search_index(segments, stats, block, k)
        names = spark.createDataFrame(pd.DataFrame({"query": range(len(block.ids)), "query_id": pd.Series(block.ids, dtype=object)}), f"query int, query_id {id_type.simpleString()}")
        part = stage(ranked.join(F.broadcast(names), "query").select("query_id", "rank", "doc_id", "score"), "ranked")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], f"query_id {id_type.simpleString()}, rank int, doc_id bigint, score bigint")
    return out

import math
import re
from collections import Counter

import numpy as np
import pytest
from llm_samples import prose

import anchorage.llm.search as search
from anchorage.llm.search import Segment, Vocabulary, build_index, query_blocks, rank_documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id bigint, text string, query string, score string"


def terms(text):
    return TERM.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))


def brute(docs, items, k):
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            n, score = sum(c.values()), 0
            m = 75 + (25 * n * n_docs) // n_terms
            for t in terms(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0 and d is not None:
                scores.append((-score, d))
        out += [(item, rank, d, -s) for rank, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


def ranked(spark, docs, items, k=5, **options):
    queries = spark.createDataFrame([(i, t, "clash", "clash") for i, t in items], ITEMS)
    return Counter(map(tuple, rank_documents(docs, queries, k, **options).collect()))


def corpus():
    rows = [(i, prose(i, 30 + i % 50, 60)) for i in range(400)]
    rows += [(1000 + i, prose(7, 40, 60)) for i in range(60)]  # a large group of equal texts: ties
    rows += [(None, prose(3, 40, 60)), (2000, None), (2001, ""), (2002, " \t..."), (5, prose(9, 20, 60)), (2003, "ÀB Àb àb É" * 3)]
    return rows + [(3000, " ".join(prose(i, 200, 60) for i in range(100)))]


def questions():
    items = [(i, prose(i * 3, 25, 60)) for i in range(12)]
    return items + [(50, None), (51, ""), (52, "nowhere"), (None, prose(7, 10, 60)), (53, "Àb " * 4 + "!"), (53, prose(2, 9, 60)), (54, prose(7, 40, 60))]


@pytest.mark.parametrize("segment", [4096, 200, 16])
def test_against_brute_force(spark, frame, monkeypatch, segment):
    rows, items = corpus(), questions()
    monkeypatch.setattr(search, "SEGMENT_DOCS", segment)
    assert ranked(spark, frame(rows).repartition(3), items) == brute(rows, items, 5)


def test_blocks_of_queries_give_the_same(spark, frame):
    rows, items = corpus(), questions()
    assert ranked(spark, frame(rows), items, terms_per_round=30) == brute(rows, items, 5)


def test_query_blocks_are_bounded(spark):
    queries = spark.createDataFrame([(i, prose(i, 25, 60), "", "") for i in range(10)] + [(99, prose(1, 300, 900), "", "")], ITEMS)
    blocks = list(query_blocks(queries, "item_id", "text", 40))
    assert sum(len(b.ids) for b, _ in blocks) == 11
    assert all(len(b.ids) == 1 or sum(map(len, b.terms)) <= 40 for b, _ in blocks)


def test_summaries_bound_every_document_and_blocks_are_skipped(spark, frame):
    rows = [(i, prose(i % 7, 60, 50) + " " + prose(i, 30, 50)) for i in range(1500)]
    queries = spark.createDataFrame([(1, prose(3, 40, 50), "", "")], ITEMS)
    (block, vocabulary), = query_blocks(queries, "item_id", "text", 10_000)
    segments, stats = build_index(frame(rows).repartition(1), vocabulary)
    looked_at = total = 0
    for row in segments.collect():
        segment = Segment({c: row[c] if c == "step" else bytes(row[c]) for c in segments.columns}, vocabulary.size)
        terms_, weights = block.terms[0], stats.weights[block.terms[0]] * block.times[0]
        weight_of = np.zeros(vocabulary.size, np.int64)
        weight_of[terms_] = weights
        every = segment.scores(np.arange(len(segment.docs)), weight_of)
        best = int(np.sort(every)[-20])
        kept = segment.candidates(terms_, weights, best, False)
        assert set(np.flatnonzero(every >= best)) <= set(kept.tolist())
        looked_at, total = looked_at + len(kept), total + len(every)
        for term in range(vocabulary.size):
            mine = segment.posted[segment.lists[term] : segment.lists[term + 1]]
            for b in range(segment.blocks[term], segment.blocks[term + 1]):
                part = mine[(b - segment.blocks[term]) * search.BLOCK :][: search.BLOCK]
                bound = (segment.summaries[b].astype(np.int64) * segment.step) @ weight_of
                assert bound >= every[part].max()
    assert looked_at < total / 2


def test_terms_are_compared_by_bytes():
    vocabulary = Vocabulary([b"abc", b"abd", b"a" * 100])
    vocabulary.data = np.frombuffer(b"abc" + b"abX" + b"a" * 100, np.uint8)  # as if another word had the hash of abd
    data = np.frombuffer(b"abc abd " + b"a" * 100, np.uint8)
    words = search.Words(data, np.array([0, len(data)]), search.TERM_BREAKS)
    found, number = vocabulary.look_up(words, data)
    assert [vocabulary.terms[i] for i in number] == [b"abc", b"a" * 100]


def test_one_text_is_a_third_of_all_rows(spark, frame):
    rows = [(i, "the same words for ever " + ("more" if i % 3 else "")) for i in range(3000)]
    rows += [(5000 + i, prose(i, 12, 30)) for i in range(300)]
    items = [(1, "the same words"), (2, prose(4, 9, 30))]
    assert ranked(spark, frame(rows).repartition(7), items, 20) == brute(rows, items, 20)


def test_empty_tables(spark, frame):
    assert not ranked(spark, frame([]), questions()) and not ranked(spark, frame(corpus()), [])
    assert not ranked(spark, frame([(1, None), (2, "...")]), questions())

import numpy as np
import pyarrow as pa

from anchorage.llm.bytesets import Words, hash_spans, text_buffers
from anchorage.llm.jaccard import similar_sets
from anchorage.llm.substrings import drop_repeated_substrings


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


S, T = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")


def test_equal_words_have_equal_hashes_wherever_they_stand():
    texts = pa.array(["one two three", "x" * 7 + " two " + "y" * 64 + " " + "z" * 65, "two " + "z" * 65 + " " + "y" * 64])
    words = Words(*text_buffers(texts))
    of = {}
    for a, b, h in zip(words.starts, words.ends, words.hashes()):
        assert of.setdefault(words.data[a:b].tobytes(), h) == h
    assert len(set(of.values())) == len(of) == 6


def test_words_of_a_common_beginning_differ():
    data = np.frombuffer(b"".join(b"a" * n for n in range(1, 100)), np.uint8)
    ends = np.cumsum(np.arange(1, 100))
    assert len(set(hash_spans(data, ends - np.arange(1, 100), ends).tolist())) == 99


def test_texts_on_which_power_of_two_polynomials_collide(frame):
    head = " ".join(f"w{i}" for i in range(12))
    found = drop_repeated_substrings(frame([(1, f"{head} {S}"), (2, f"{head} {T}"), (3, f"{head} {S}")]))
    assert {r["id"]: r["n_removed"] for r in found.collect()} == {1: 0, 2: 0, 3: 13}
    linked = similar_sets(frame([(1, f"x y {S}"), (2, f"x y {T}"), (3, f"x y {S}")]))
    assert {r["id"]: r["component"] for r in linked.collect()} == {1: 1, 2: 2, 3: 1}

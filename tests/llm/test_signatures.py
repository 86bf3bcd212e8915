"""Signatures bound how far sets are apart, however large the sets are."""

import numpy as np

from anchorage.llm.jaccard import bits_apart, signatures_of


def _pairs(sizes, shared):
    random = np.random.default_rng(5)
    sets = []
    for (n_a, n_b), part in zip(sizes, shared):
        pool = random.integers(0, 2**64, n_a + n_b, np.uint64)
        k = int(part * min(n_a, n_b))
        sets.append((pool[:n_a], np.concatenate([pool[:k], pool[n_a : n_a + n_b - k]])))
    sides = []
    for i in (0, 1):
        size = np.array([len(s[i]) for s in sets])
        sides.append(signatures_of(np.repeat(np.arange(len(sets)), size), np.concatenate([s[i] for s in sets]), size))
    differ = np.array([len(set(a.tolist()) ^ set(b.tolist())) for a, b in sets])
    return differ, bits_apart(*sides)


def test_signatures_never_exceed_the_difference():
    sizes = [(1, 1), (3, 4), (63, 65), (64, 64), (1000, 1030), (1020, 1100), (5000, 5500), (9000, 8200), (40000, 41000)]
    for part in (0.0, 0.5, 0.9, 0.98, 1.0):
        differ, apart = _pairs(sizes, [part] * len(sizes))
        assert (apart <= differ).all()


def test_signatures_tell_large_sets_apart():
    sizes = [(n, n) for n in (2000, 4000, 9000, 30000)]
    for part in (0.0, 0.5, 0.8):
        _, apart = _pairs(sizes, [part] * len(sizes))
        both = np.array([a + b for a, b in sizes])
        assert ((90 + 100) * apart > (100 - 90) * both).all()

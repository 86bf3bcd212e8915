"""Suffix sorting by recursive induction with common-prefix values, in memory but for long queues.

A suffix is of type S if it is less than the one to its right, else L; an S suffix right of an L one is a
seed.  Substrings between seeds are named in order; unless all names differ, the string of names is sorted by
recursion.  Then sorted seeds induce the L suffixes in rising order and these the S suffixes in falling
order: the suffix left of each that is met is queued under its first character.

On the text itself the queue is one first-in-first-out run per character (what arrives under a character
arrives in order), worked through in whole runs, and each entry carries its common prefix with the entry
before it: one more than the least value between the two that induced them.  Strings of names have large
alphabets; there the queue is a heap.  Both queues move to disk beyond a given number of entries.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from heapq import heappop, heappush, merge

import numpy as np

from .bytesets import BASES, SpanHash, mix

#: Entries that a queue keeps in memory.
HELD = 4_000_000


class HeapQueue:
    """A priority queue of (key, order, place) triples; what exceeds ``held`` goes to disk as sorted runs."""

    def __init__(self, held: int = HELD):
        self.held, self.heap, self.runs = held, [], None

    def push(self, entry: tuple[int, int, int]) -> None:
        heappush(self.heap, entry)
        if len(self.heap) > self.held:
            self._spill()

    def _spill(self) -> None:
        file = tempfile.TemporaryFile()
        np.array(sorted(self.heap), np.int64).tofile(file)
        file.seek(0)
        self.heap.clear()
        older = [self.runs] if self.runs is not None else []
        self.runs = _Peekable(merge(*older, self._read(file)))

    @staticmethod
    def _read(file) -> Iterator[tuple[int, int, int]]:
        with file:
            while len(rows := np.fromfile(file, np.int64, 3 * 10_000)):
                yield from map(tuple, rows.reshape(-1, 3).tolist())

    def least(self) -> tuple[int, int, int] | None:
        on_disk = self.runs.head if self.runs is not None else None
        if self.heap and (on_disk is None or self.heap[0] < on_disk):
            return self.heap[0]
        return on_disk

    def pop(self) -> tuple[int, int, int]:
        if self.runs is not None and self.runs.head is not None and not (self.heap and self.heap[0] < self.runs.head):
            return next(self.runs)
        return heappop(self.heap)


class _Peekable:
    def __init__(self, entries: Iterator):
        self.entries = entries
        self.head = next(entries, None)

    def __iter__(self):
        return self

    def __next__(self):
        if self.head is None:
            raise StopIteration
        got, self.head = self.head, next(self.entries, None)
        return got


class RunQueue:
    """First-in-first-out runs of (place, common prefix) by character; whole runs go to disk beyond ``held`` entries."""

    def __init__(self, alphabet: int, held: int = HELD):
        self.runs: list[list] = [[] for _ in range(alphabet)]
        self.held, self.size = held, 0

    def add(self, char: int, places: np.ndarray, prefixes: np.ndarray) -> None:
        run = np.stack([places, prefixes])
        self.size += len(places)
        if self.size > self.held:
            file = tempfile.TemporaryFile()
            np.save(file, run)
            self.size -= len(places)
            run = file
        self.runs[char].append(run)

    def take(self, char: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All that waits under ``char``, removed."""
        waiting, self.runs[char] = self.runs[char], []
        if not waiting:
            return None
        out = []
        for run in waiting:
            if isinstance(run, np.ndarray):
                self.size -= run.shape[1]
            else:
                with run as file:
                    file.seek(0)
                    run = np.load(file)
            out.append(run)
        both = out[0] if len(out) == 1 else np.concatenate(out, axis=1)
        return both[0], both[1]


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is less than the one to its right.  The last character has to be the least and unique."""
    n = len(text)
    rises = np.zeros(n, np.int8)
    rises[:-1] = np.sign(text[1:] - text[:-1])
    # an equal pair takes the type of the next unequal one
    decided = np.where(rises != 0, np.arange(n), n - 1)
    decided = np.minimum.accumulate(decided[::-1])[::-1]
    types = rises[decided] > 0
    types[-1] = True
    return types


def _seeds(types: np.ndarray) -> np.ndarray:
    return np.flatnonzero(types[1:] & ~types[:-1]) + 1


def _names(text: np.ndarray, types: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, int]:
    """Order-preserving names of the substrings from each seed to the next, both included."""
    raw = (2 * text + types).astype(">u4").tobytes()  # with types no substring is a prefix of another
    ends = (np.append(seeds[1:], seeds[-1]) + 1) * 4
    parts = [raw[a:b] for a, b in zip((seeds * 4).tolist(), ends.tolist())]
    rank = {part: i for i, part in enumerate(sorted(set(parts)))}
    return np.array([rank[p] for p in parts], np.int64), len(rank)


def sorted_seeds(text: np.ndarray, types: np.ndarray, held: int) -> np.ndarray:
    """The seeds in the order of their suffixes."""
    seeds = _seeds(types)
    names, distinct = _names(text, types, seeds)
    order = np.argsort(names, kind="stable") if distinct == len(names) else _suffix_order(names, held)
    return seeds[order]


def _suffix_order(text: np.ndarray, held: int) -> np.ndarray:
    """The suffix array of a string of names whose last name is the least and unique."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    types = suffix_types(text)
    seeds = sorted_seeds(text, types, held).tolist()
    chars, is_s = text.tolist(), types.tolist()
    queue, rising, number, at = HeapQueue(held), [], 0, 0
    while True:
        head = queue.least()
        if head is not None and (at == len(seeds) or head[0] <= chars[seeds[at]]):
            place = queue.pop()[2]
            rising.append(place)
        elif at < len(seeds):
            place = seeds[at]
            at += 1
        else:
            break
        if place and not is_s[place - 1]:
            queue.push((chars[place - 1], number, place - 1))
            number += 1
    queue, falling, number, at = HeapQueue(held), [], 0, len(rising) - 1
    while True:
        head = queue.least()
        if head is not None and (at < 0 or -head[0] >= chars[rising[at]]):
            place = queue.pop()[2]
            falling.append(place)
        elif at >= 0:
            place = rising[at]
            at -= 1
        else:
            break
        if place and is_s[place - 1]:
            queue.push((-chars[place - 1], number, place - 1))
            number += 1
    falling.append(n - 1)
    order = np.array(rising + falling[::-1], np.int64)
    return order[np.argsort(2 * text[order] + types[order], kind="stable")]


class _Least:
    """Minima of ranges of an array, by powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        step = 1
        while 2 * step <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least value of first..last, both included."""
        power = np.frexp(last - first + 1)[1] - 1
        out = np.empty(len(first), self.levels[0].dtype)
        for p in np.unique(power):
            here = power == p
            out[here] = np.minimum(self.levels[p][first[here]], self.levels[p][last[here] - (1 << int(p)) + 1])
        return out


class _Inducer:
    """One direction of induction over the text: suffixes are met in order, those to their left are queued."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, alphabet: int, cap: int, held: int):
        self.text, self.wanted, self.cap = text, wanted, cap
        self.queue = RunQueue(alphabet, held)
        #: Least common prefix met since the last entry that was queued under each character; -1 before the first.
        self.since = np.full(alphabet, -1, np.int64)

    def meet(self, places: np.ndarray, prefixes: np.ndarray) -> None:
        """``prefixes[k]`` is the common prefix of ``places[k]`` with what was met before it."""
        self_least = int(prefixes.min())
        left = places - 1
        chosen = np.flatnonzero((left >= 0) & self.wanted[left])
        queued = self.since >= 0
        if not len(chosen):
            self.since[queued] = np.minimum(self.since[queued], self_least)
            return
        chars = self.text[left[chosen]]
        order = np.argsort(chars, kind="stable")
        chosen, chars = chosen[order], chars[order]
        new = np.ones(len(chosen), bool)
        new[1:] = chars[1:] != chars[:-1]
        heads = np.flatnonzero(new)
        least = _Least(prefixes)
        begin = np.where(new, 0, np.append(0, chosen[:-1] + 1))
        between = least.of(begin, chosen)
        before = self.since[chars[heads]]
        # the first entry of a character has nothing to share with
        between[heads] = np.where(before < 0, -1, np.minimum(np.where(before < 0, self.cap, before), between[heads]))
        shared = np.minimum(between + 1, self.cap)
        tails = np.append(heads[1:], len(chosen)) - 1
        self.since[queued] = np.minimum(self.since[queued], self_least)
        rest = np.full(len(tails), self.cap, np.int64)
        more = chosen[tails] + 1 < len(prefixes)
        rest[more] = least.of(chosen[tails][more] + 1, np.full(more.sum(), len(prefixes) - 1))
        self.since[chars[heads]] = rest
        for a, b in zip(heads.tolist(), (tails + 1).tolist()):
            self.queue.add(int(chars[a]), left[chosen[a:b]], shared[a:b])


def _shared(hashes: SpanHash, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes, ``cap`` at most, of pairs of suffixes, by halving on the text's hashes."""
    low, high = np.zeros(len(a), np.int64), np.minimum(cap, len(hashes.sums) - 1 - np.maximum(a, b))
    while (open_ := low < high).any():
        middle = (low + high + 1) // 2
        same = hashes.of(a, a + middle) == hashes.of(b, b + middle)
        low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)
    return low


def suffix_array(text: np.ndarray, cap: int, held: int = HELD) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, common prefix of each with the one before it, ``cap`` at most).

    ``text`` are small integers, the last of which is 0 and occurs once.
    """
    if len(text) == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    alphabet = int(text.max()) + 1
    types = suffix_types(text)
    seeds = sorted_seeds(text, types, held)
    hashes = SpanHash(mix(text.astype(np.uint64) + np.uint64(1)), BASES[0])
    seed_prefix = np.append(0, _shared(hashes, seeds[:-1], seeds[1:], cap))
    bounds = np.searchsorted(text[seeds], np.arange(alphabet + 1))

    # the last of what was met and the first of what follows share nothing but their character
    up = _Inducer(text, ~types, alphabet, cap, held)
    large: list[list] = [[] for _ in range(alphabet)]
    for c in range(alphabet):
        met = False
        while (run := up.queue.take(c)) is not None:
            places, prefixes = run
            large[c].append(run)
            prefixes = prefixes.copy()
            if not met:
                prefixes[0] = 0
            met = True
            up.meet(places, prefixes)
        own = slice(bounds[c], bounds[c + 1])
        if own.start < own.stop:
            prefixes = seed_prefix[own].copy()
            # an L and an S suffix of one character share the run of that character only
            prefixes[0] = _shared(hashes, np.array([large[c][-1][0][-1]]), seeds[own][:1], cap)[0] if met else 0
            up.meet(seeds[own], prefixes)
    down = _Inducer(text, types, alphabet, cap, held)
    order, shared = [], []
    for c in range(alphabet - 1, -1, -1):
        falling: list[tuple[np.ndarray, np.ndarray]] = []
        if c == 0:
            falling.append((np.array([len(text) - 1]), np.zeros(1, np.int64)))
        while (run := down.queue.take(c)) is not None:
            places, prefixes = run
            prefixes = prefixes.copy()
            if not falling:
                prefixes[0] = 0
            falling.append((places, prefixes))
            down.meet(places, prefixes)
        rising = [np.concatenate(x) for x in zip(*large[c])] if large[c] else None
        value = 0
        if rising is not None:
            places, prefixes = rising[0][::-1], np.append(0, rising[1][1:][::-1])
            if falling:
                value = _shared(hashes, falling[-1][0][-1:], places[:1], cap)[0]
                prefixes[0] = value
            down.meet(places, prefixes)
        small = [np.concatenate(x) for x in zip(*falling)] if falling else None
        if small is not None:
            order.append(small[0])
            shared.append(np.append(small[1][1:], value))
        if rising is not None:
            order.append(rising[0][::-1])
            shared.append(np.append(rising[1][1:][::-1], 0))
    return np.concatenate(order)[::-1], np.concatenate(shared)[::-1]


def repeats(
    bodies: list[bytes], length: int, held: int = HELD, named: tuple[np.ndarray, np.ndarray] | None = None
) -> dict[int, np.ndarray]:
    """For each body, the sorted starts of its strings of ``length`` bytes that also start elsewhere in ``bodies``.

    Bytes from the first to before the second of ``named`` are characters of their own, unlike all others.
    """
    sizes = np.array([len(b) for b in bodies], np.int64)
    # bytes from 2 on; 1 ends a body, 0 the whole
    text = np.zeros(int(sizes.sum()) + len(bodies) + 1, np.int64)
    ends = np.cumsum(sizes + 1) - 1
    inside = np.ones(len(text) - 1, bool)
    inside[ends] = False
    text[:-1][inside] = np.frombuffer(b"".join(bodies), np.uint8).astype(np.int64) + 2
    text[ends] = 1
    if named is not None:
        begins = ends - sizes
        steps = np.zeros(len(text) + 1, np.int64)
        np.add.at(steps, begins + named[0], 256)
        np.add.at(steps, begins + named[1], -256)
        text += np.cumsum(steps)[: len(text)]
    order, shared = suffix_array(text, length, held)
    body = np.minimum(np.searchsorted(ends, order), len(bodies) - 1)
    start = order - (ends - sizes)[body]
    whole = (order < len(text) - 1) & (start + length <= sizes[body])
    same = shared >= length
    repeated = whole & (same | np.append(same[1:], False))
    body, start = body[repeated], start[repeated]
    at = np.lexsort((start, body))
    body, start = body[at], start[at]
    which, first = np.unique(body, return_index=True)
    return dict(zip(which.tolist(), np.split(start, first[1:]))) if len(which) else {}

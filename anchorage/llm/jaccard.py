r"""N-gram Jaccard join with set-relation skipping.

A text's set are the hashes of its distinct n-word shingles.  Equal sets are one class, with one
representative.  A prefix of each set, rare shingles first, goes into index lists by shingle: sets that
are similar enough share one of them.

* Skipping in the lists: a list is sorted by set size and cut into blocks that know their smallest
  position; a block is skipped if its sizes or positions can't give the overlap that is needed.  Signatures of
  1024 bits bound how far a pair is apart, so few pairs need their texts.
* Skipping by answers: sets that are highly similar, found by equal bottom-k keys, are compared with one
  leader only.  What is connected already is not compared again: lists yield pairs of different components
  only, first near ones, and after these have joined components, all that are left.
* Skipping by differences: sets that share many lists with one pivot are a family, and each is compared with
  the pivot.  Where both of two sets link with it they are connected; else they have to share more than half
  of what sets one of them apart from the pivot.  So pairs of a family come from lists of differences, which
  are short, and not from the lists of what the whole family shares.

Rareness comes from a sketch of counts of fixed size, so it may be broadcast at any scale; it only orders
shingles, so its errors cost time and no links.  Every pair that could link is compared exactly, or its two
ends are connected by other links; so components are exact, while not every link is listed.

Words are ``[^\x20\x09-\x0D]+`` with A-Z in lower case.  A text with fewer words than ``n`` is one shingle;
null, empty and blank texts have no set and link with nothing.  Rows with the same id are one document to
the links.  Rows with a null id link with nothing.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import spread_join
from ..operators.staging import new_folder
from .bytesets import BASES, LOWER, Words, hash_runs, mix, slices, text_buffers
from .columns import without_ids
from .components import components
from .runs import BucketedTable, default_buckets, stage

SKETCH_BITS = 18
_BLOCK = 32
#: Bottom-k keys, each by a hash of its own: k and seed.
LEAD_KEYS = ((8, 1), (3, 2))
_NEAR = 4
#: A set is of its pivot's family from this similarity on.
_FAMILY = (1, 2)
#: A difference is common if more than one in so many of a family have it.
_COMMON = 8
#: Least and most bits of a signature, powers of two.
_SIGNATURE = (1 << 6, 1 << 24)


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, sorted."""
    data, offsets = text_buffers(column)
    words = Words(data, offsets)
    hashes = words.hashes(LOWER[data])
    size = np.diff(words.bounds)
    starts = np.flatnonzero(np.arange(len(words)) + n <= words.bounds[1:][words.doc]) if len(words) else np.zeros(0, np.int64)
    short = np.flatnonzero((size > 0) & (size < n))
    begins = np.concatenate([starts, words.bounds[short]])
    lengths = np.concatenate([np.full(len(starts), n), size[short]])
    rows = np.concatenate([words.doc[starts], short])
    shingles = hash_runs(hashes, begins, lengths, n)
    order = np.lexsort((shingles, rows))
    rows, shingles = rows[order], shingles[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (shingles[1:] != shingles[:-1])
    return rows[new], shingles[new]


def _counts(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in slices(batches, "text"):
            _, shingles = shingle_sets(batch.column(1), n)
            sketch += np.bincount((shingles & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64), minlength=len(sketch))
        parts = np.split(sketch.astype("<i8"), 64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(64), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "counts"]
        )

    return run


def _add_up(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(c, "<i8") for c in rows["counts"]], axis=0)
    return pd.DataFrame({"part": rows["part"][:1], "counts": [total.astype("<i8").tobytes()]})


def rareness(texts: DataFrame, n: int) -> np.ndarray:
    """A level per cell of the sketch: 0 for shingles within the noise, more for commoner ones.  256 KB, whatever the input."""
    summed = texts.mapInArrow(_counts(n), "part int, counts binary").groupBy("part").applyInPandas(_add_up, "part int, counts binary")
    sketch = np.zeros((64, (1 << SKETCH_BITS) // 64))
    for row in summed.collect():
        sketch[row["part"]] = np.frombuffer(row["counts"], "<i8")
    sketch = sketch.ravel()
    mean = sketch.mean()
    return np.clip(np.ceil(np.log2(np.maximum((sketch - mean) / (6 * np.sqrt(mean) + 16), 1))), 0, 31).astype(np.uint8)


def signatures_of(rows: np.ndarray, shingles: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of the signatures of sets: bits that say whether the elements of a cell are odd in number.

    Elements that two sets share cancel out, so bits in which two signatures differ are as many elements that only
    one set has, at least.  A signature grows with its set, and its halves added up are the one of half its width.
    """
    width = np.clip(1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64), *_SIGNATURE)
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(width)])
    cell = (shingles >> np.uint64(40)).astype(np.int64) & (width[rows] - 1)
    odd = (np.bincount(offsets[rows] + cell, minlength=offsets[-1]) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little"), offsets // 8


def bits_apart(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """In how many bits the signatures of pairs differ; wider ones are brought down to the other's width."""
    (data_a, offsets_a), (data_b, offsets_b) = a, b
    widths = np.stack([np.diff(offsets_a), np.diff(offsets_b)], axis=1)
    apart = np.zeros(len(widths), np.int64)
    for wide in np.unique(widths, axis=0):
        rows = np.flatnonzero((widths == wide).all(axis=1))
        sides = [data[offsets[rows][:, None] + np.arange(w)] for data, offsets, w in ((data_a, offsets_a, wide[0]), (data_b, offsets_b, wide[1]))]
        for i in (0, 1):
            while sides[i].shape[1] > sides[1 - i].shape[1]:
                sides[i] = np.bitwise_xor(*np.split(sides[i], 2, axis=1))
        apart[rows] = np.bitwise_count(sides[0] ^ sides[1]).sum(axis=1, dtype=np.int64)
    return apart


def _describe(n: int, threshold: tuple[int, int], levels: np.ndarray):
    num, den = threshold
    names = ["id", "n", "s1", "s2", "prefix", "keys", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows, shingles = shingle_sets(batch.column(1), n)
            bounds = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            size = np.diff(bounds)

            def sums(x: np.ndarray) -> np.ndarray:
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
                return np.diff(total[bounds])

            level = levels[(shingles & np.uint64(len(levels) - 1)).astype(np.int64)].astype(np.uint64)
            token = level << np.uint64(59) | shingles >> np.uint64(5)
            ordered = token[np.lexsort((token, rows))]
            # sets that are similar enough share one of the first size - ceil(t * size) + 1
            length = size + (-(num * size) // den) + 1
            bits, at = signatures_of(rows, shingles, size)
            bits = bits.tobytes()
            keys = []
            for k, seed in LEAD_KEYS:
                other = mix(shingles ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1)))
                other = other[np.lexsort((other, rows))]
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(other + np.uint64(seed)), dtype=np.uint64)])
                keys.append(total[bounds[:-1] + np.minimum(size, k)] - total[bounds[:-1]])
            prefixes = [ordered[a : a + m].astype("<u8").tobytes() if m > 0 else None for a, m in zip(bounds, np.where(size > 0, length, 0))]
            keys = pa.FixedSizeListArray.from_arrays(pa.array(np.stack(keys, axis=1).ravel().view(np.int64)), len(LEAD_KEYS))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(size, pa.int64()),
                    pa.array(sums(mix(shingles + np.uint64(1))).view(np.int64)),
                    pa.array(sums(mix(shingles ^ np.uint64(BASES[1]))).view(np.int64)),
                    pa.array(prefixes, pa.binary()),
                    keys.cast(pa.list_(pa.int64())),
                    pa.array([bits[a:b] for a, b in zip(at, at[1:])], pa.binary()),
                ],
                names=names,
            )

    return run


def _unroll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per shingle of a prefix: its token, and its position."""
    for batch in batches:
        for part in slices(iter([batch]), "prefix", 1 << 20):
            data, offsets = text_buffers(part.column(2))
            counts = np.diff(offsets) // 8
            token = np.frombuffer(data.tobytes(), "<i8")
            firsts = np.cumsum(counts) - counts
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(token),
                    pa.array(np.repeat(part.column(0).to_numpy(zero_copy_only=False), counts)),
                    pa.array(np.repeat(part.column(1).to_numpy(zero_copy_only=False), counts).astype(np.int32)),
                    pa.array((np.arange(len(token)) - np.repeat(firsts, counts)).astype(np.int32)),
                ],
                names=["token", "id", "n", "pos"],
            )


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries whose list has another one; a partition holds whole lists."""
    held = [batch for batch in batches if batch.num_rows]
    if held:
        table = pa.Table.from_batches(held)
        _, of, counts = np.unique(table.column("token").to_numpy(), return_inverse=True, return_counts=True)
        yield from table.filter(pa.array(counts[of] > 1)).to_batches(100_000)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, 0..count-1) for every unit of ``counts``."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def list_pairs(
    token: np.ndarray,
    ids: np.ndarray,
    n: np.ndarray,
    pos: np.ndarray,
    comp: np.ndarray,
    threshold: tuple[int, int],
    near: int | None,
    family: np.ndarray | None = None,
) -> np.ndarray:
    """Pairs of different components in the same list that may be similar enough, as two columns of ids.

    With ``near``, an entry meets only so many that follow it in its list; with None all, but for those of its
    own ``family``.
    """
    num, den = threshold
    order = np.lexsort((ids, pos, n, token))
    family = ids[order] if family is None else family[order]
    token, ids, n, pos, comp = token[order], ids[order], n[order].astype(np.int64), pos[order].astype(np.int64), comp[order]
    new = np.ones(len(token), bool)
    new[1:] = token[1:] != token[:-1]
    run = np.cumsum(new) - 1
    ends = np.append(np.flatnonzero(new)[1:], len(token))[run]
    at = np.arange(len(token))

    def fits(i: np.ndarray, j: np.ndarray, n_j: np.ndarray, pos_j: np.ndarray) -> np.ndarray:
        # overlap needed: t / (1 + t) * (n_i + n_j); possible: what stands from the shared token on
        possible = np.minimum(n[i] - pos[i], n_j - pos_j)
        return (num * n_j <= den * n[i]) & ((num + den) * possible >= num * (n[i] + n_j))

    out = []
    if near is not None:
        for step in range(1, near + 1):
            i = at[at + step < ends]
            j = i + step
            ok = (comp[i] != comp[j]) & fits(i, j, n[j], pos[j])
            out.append(np.stack([ids[i[ok]], ids[j[ok]]], axis=1))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
    # blocks of entries, never across lists, with their smallest size and position
    in_run = at - np.flatnonzero(new)[run]
    block_new = new | (in_run % _BLOCK == 0)
    block = np.cumsum(block_new) - 1
    block_at = np.flatnonzero(block_new)
    block_end = np.append(block_at[1:], len(token))
    low_pos = np.minimum.reduceat(pos, block_at) if len(block_at) else pos
    mixed = np.minimum.reduceat(comp, block_at) != np.maximum.reduceat(comp, block_at) if len(block_at) else comp
    kin = np.minimum.reduceat(family, block_at) == np.maximum.reduceat(family, block_at) if len(block_at) else family
    last_block = block[np.maximum(ends - 1, 0)] if len(token) else block
    for lo in range(0, len(token), 1 << 16):
        i = at[lo : lo + (1 << 16)]
        which, k = _spread(last_block[i] - block[i] + 1)
        i, b = i[which], block[i[which]] + k
        # sizes rise within a list, so a block's first size is its smallest; possible overlap is largest at its largest size
        top = n[block_end[b] - 1]
        possible = np.minimum(n[i] - pos[i], top - low_pos[b])
        live = (num * n[block_at[b]] <= den * n[i]) & ((num + den) * possible >= num * (n[i] + n[block_at[b]]))
        live &= mixed[b] | (comp[block_at[b]] != comp[i])
        live &= ~kin[b] | (family[block_at[b]] != family[i])
        i, b = i[live], b[live]
        for part in range(0, len(i), 1 << 17):
            pi, pb = i[part : part + (1 << 17)], b[part : part + (1 << 17)]
            which, k = _spread(block_end[pb] - block_at[pb])
            x, y = pi[which], block_at[pb[which]] + k
            ok = (y > x) & (comp[x] != comp[y]) & (family[x] != family[y])
            x, y = x[ok], y[ok]
            ok = fits(x, y, n[y], pos[y])
            out.append(np.unique(np.stack([ids[x[ok]], ids[y[ok]]], axis=1), axis=0))
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)


def _pairs_of(threshold: tuple[int, int], near: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        columns = (table.column(c).to_numpy() for c in ("token", "id", "n", "pos", "component"))
        yield from _rows(list_pairs(*columns, threshold, near, table.column("family").to_numpy()))

    return run


def _rows(pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
    low, high = pairs.min(axis=1, initial=2**63 - 1), pairs.max(axis=1, initial=-(2**63))
    for at in range(0, len(pairs), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(low[at : at + 100_000]), pa.array(high[at : at + 100_000])], names=["a", "b"])


def family_pairs(
    family: np.ndarray, token: np.ndarray, ids: np.ndarray, n: np.ndarray, apart: np.ndarray, pos: np.ndarray,
    linked: np.ndarray, short: np.ndarray, comp: np.ndarray, threshold: tuple[int, int],
) -> np.ndarray:
    """Pairs of a family and of different components that share a difference and may be similar enough.

    One of the two does not link with the pivot.  It meets linked sets by its whole prefix, and others by its
    ``short`` one.
    """
    num, den = threshold
    kind = np.where(linked, 0, np.where(short, 1, 2))
    order = np.lexsort((ids, kind, token, family))
    family, token, ids, kind, comp = (x[order] for x in (family, token, ids, kind, comp))
    n, apart, pos = (x[order].astype(np.int64) for x in (n, apart, pos))
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (family[1:] != family[:-1])
    run = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    of_linked = np.bincount(run[kind == 0], minlength=len(first))
    at = np.arange(len(token))
    partners = np.where(kind == 1, at - first[run], np.where(kind == 2, of_linked[run], 0))
    out = [np.zeros((0, 2), np.int64)]
    bounds = np.searchsorted(np.cumsum(partners), np.arange(1 << 20, partners.sum() + (1 << 20), 1 << 20), "right")
    for lo, hi in zip(np.append(0, bounds), np.append(bounds, len(token))):
        which, k = _spread(partners[lo:hi])
        y = which + lo
        x = first[run[y]] + k
        ok = (comp[x] != comp[y]) & (num * np.maximum(n[x], n[y]) <= den * np.minimum(n[x], n[y]))
        # what both have apart from the pivot: needed, and what stands from the shared difference on
        possible = np.minimum(apart[x] - pos[x], apart[y] - pos[y])
        ok &= 2 * (num + den) * possible >= (num + den) * (apart[x] + apart[y]) - (den - num) * (n[x] + n[y])
        out.append(np.unique(np.stack([ids[x[ok]], ids[y[ok]]], axis=1), axis=0))
    return np.unique(np.concatenate(out), axis=0)


def _family_pairs(threshold: tuple[int, int]):
    names = ("family", "token", "id", "n", "apart", "pos", "linked", "short", "component")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            yield from _rows(family_pairs(*(table.column(c).to_numpy() for c in names), threshold))

    return run


def _could_link(threshold: tuple[int, int]):
    """Pairs whose signatures differ in no more bits than sets that link have elements apart."""
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch]), "bits_a"):
                both = part.column(2).to_numpy(zero_copy_only=False) + part.column(3).to_numpy(zero_copy_only=False)
                apart = bits_apart(text_buffers(part.column(4)), text_buffers(part.column(5)))
                yield part.select([0, 1]).filter(pa.array((num + den) * apart <= (den - num) * both))

    return run


def _pruned(pairs: DataFrame, signatures: BucketedTable, threshold: tuple[int, int]) -> DataFrame:
    by_id = signatures.read().hint("merge")
    of_a = by_id.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    of_b = by_id.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    joined = pairs.join(of_b, "b").join(of_a, "a").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    return joined.mapInArrow(_could_link(threshold), "a bigint, b bigint")


def _compare(n: int, threshold: tuple[int, int]):
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch]), "text_a", 1 << 20):
                rows_a, set_a = shingle_sets(part.column(2), n)
                rows_b, set_b = shingle_sets(part.column(3), n)
                rows, both = np.concatenate([rows_a, rows_b]), np.concatenate([set_a, set_b])
                order = np.lexsort((both, rows))
                rows, both = rows[order], both[order]
                same = np.flatnonzero((rows[1:] == rows[:-1]) & (both[1:] == both[:-1]))
                common = np.bincount(rows[same], minlength=part.num_rows)
                union = np.bincount(rows, minlength=part.num_rows) - common
                yield part.select([0, 1]).filter(pa.array((common > 0) & (den * common >= num * union)))

    return run


def _differences(n: int, threshold: tuple[int, int]):
    """What sets the texts ``b`` apart from their pivots ``a``: what only ``b`` has first, as few others have it.

    Of two sets x, y of which y does not link with the pivot r, |x - y| <= c (n_x + n_y), c = (den - num) / (den + num),
    needs over (d_x + c (n_r - n_x)) / 2 common differences, since d_y > c (n_y + n_r).  If x does link, y needs
    d_y - c (n_x + n_y) at least, as x has no more.  So they share one of their first ones.
    """
    num, den = threshold
    names = ["family", "id", "linked", "n", "apart", "few", "most", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch]), "text_a", 1 << 20):
                rows_a, set_a = shingle_sets(part.column(2), n)
                rows_b, set_b = shingle_sets(part.column(3), n)
                n_a, n_b = (np.bincount(rows, minlength=part.num_rows) for rows in (rows_a, rows_b))
                rows, both = np.concatenate([rows_a, rows_b]), np.concatenate([set_a, set_b])
                of_a = np.arange(len(rows)) < len(rows_a)
                order = np.lexsort((both, rows))
                rows, both, of_a = rows[order], both[order], of_a[order]
                same = np.flatnonzero((rows[1:] == rows[:-1]) & (both[1:] == both[:-1]))
                alone = np.ones(len(rows), bool)
                alone[same] = alone[same + 1] = False
                rows, both, of_a = rows[alone], both[alone], of_a[alone]
                order = np.lexsort((both, of_a, rows))
                both = both[order].astype("<u8")
                apart = np.bincount(rows, minlength=part.num_rows)
                common = (n_a + n_b - apart) // 2
                union = n_a + n_b - common
                linked = (common > 0) & (den * common >= num * union)
                few = apart - np.maximum(((num + den) * apart + (den - num) * (n_a - n_b)) // (2 * (num + den)) + 1, 1) + 1
                most = np.where(linked, few, np.maximum(few, apart - np.maximum(apart - (den - num) * n_b // num, 1) + 1))
                ends = np.cumsum(apart)
                tokens = [both[a:b].tobytes() for a, b in zip(ends - apart, ends)]
                columns = [part.column(0), part.column(1), linked, n_b, apart, few, np.maximum(most, 0), pa.array(tokens, pa.binary())]
                out = pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=names)
                yield out.filter(pa.array(_FAMILY[1] * common >= _FAMILY[0] * union))

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per difference of a set."""
    for batch in batches:
        for part in slices(iter([batch]), "tokens", 1 << 20):
            data, offsets = text_buffers(part.column(1))
            family = np.repeat(part.column(0).to_numpy(zero_copy_only=False), np.diff(offsets) // 8)
            yield pa.RecordBatch.from_arrays([pa.array(family), pa.array(np.frombuffer(data.tobytes(), "<i8"))], names=["family", "token"])


def _unroll_differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per difference of a prefix, those common in the family last: its position, and if it is in the short prefix."""
    names = ["family", "id", "linked", "n", "apart", "short", "token", "pos"]
    for batch in batches:
        for part in slices(iter([batch]), "tokens", 1 << 20):
            prefixes = []
            for raw, most, common in zip(part.column(7).to_pylist(), part.column(6).to_pylist(), part.column(8)):
                tokens = np.frombuffer(raw, "<i8")
                if common.is_valid:
                    late = np.isin(tokens, common.values.to_numpy())
                    tokens = np.concatenate([tokens[~late], tokens[late]])
                prefixes.append(tokens[:most])
            which, pos = _spread(np.array([len(p) for p in prefixes]))
            columns = [c.to_numpy(zero_copy_only=False)[which] for c in part.columns[:6]]
            columns[5] = pos < columns[5]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*columns, np.concatenate(prefixes), pos)], names=names)


def _differing(kin: DataFrame) -> DataFrame:
    """The prefixes of differences, one row each.  What many of a family have goes last, such as what only its pivot lacks."""
    sizes = kin.groupBy("family").agg(F.count(F.lit(1)).alias("size"))
    counts = kin.select("family", "tokens").mapInArrow(_tokens, "family bigint, token bigint").groupBy("family", "token")
    counts = counts.agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") >= _COMMON).join(sizes, "family")
    common = counts.filter(F.col("count") * _COMMON > F.col("size")).groupBy("family").agg(F.collect_list("token").alias("common"))
    joined = spread_join(kin, common, ["family"], sizes, "size", ["id"], 10_000)
    schema = "family bigint, id bigint, linked boolean, n bigint, apart bigint, short boolean, token bigint, pos bigint"
    return joined.select(*kin.columns, "common").mapInArrow(_unroll_differences, schema)


def _pivots(entries: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """``a, b``: for sets ``b`` in lists, the set ``a`` that leads most of their lists.

    A list is led by the set whose prefix has the longest lists on the average: the one least edited.
    """
    num, den = threshold
    lengths = entries.groupBy("token").agg(F.count(F.lit(1)).alias("length"))
    known = entries.join(lengths, "token")
    score = F.sum("length") / (F.first("n") - F.ceil(F.first("n") * num / den) + 1)
    scores = known.groupBy("id").agg(score.alias("score"))
    best = entries.join(scores, "id").groupBy("token").agg(F.max(F.struct("score", (-F.col("id")).alias("low"))).alias("best"))
    votes = entries.join(best.select("token", "best.score", (-F.col("best.low")).alias("pivot")), "token").filter("pivot <> id")
    votes = votes.groupBy("id", "pivot").agg(F.count(F.lit(1)).alias("votes"), F.first("score").alias("score"))
    chosen = F.max_by("pivot", F.struct("votes", "score", -F.col("pivot")))
    return votes.groupBy(F.col("id").alias("b")).agg(chosen.alias("a")).select("a", "b")


def _links(pairs: DataFrame, texts: BucketedTable, n: int, threshold: tuple[int, int]) -> DataFrame:
    """The pairs ``a, b`` whose texts are similar enough, compared exactly."""
    return _with_texts(pairs, texts).mapInArrow(_compare(n, threshold), "a bigint, b bigint")


def _with_texts(pairs: DataFrame, texts: BucketedTable) -> DataFrame:
    """``a, b, text_a, text_b``.

    Texts stay in their buckets, and pairs come to them; only texts that a pair wants move.
    """
    by_id = texts.read().hint("merge")
    of_b = by_id.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    of_a = by_id.join(pairs.select(F.col("a").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("count"))
    # many sets share a leader, so its side is split; the other side has few rows an id
    joined = spread_join(pairs.join(of_b, "b"), of_a, ["a"], counts, "count", ["b"], 10_000)
    return joined.select("a", "b", "text_a", "text_b")


def similar_sets(
    docs: DataFrame, n: int = 3, threshold: tuple[int, int] = (90, 100), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, n_shingles, component``: links are pairs with den * intersection >= num * union for ``threshold`` (num, den)."""
    texts = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text"))
    levels = rareness(texts, n)
    schema = "id bigint, n bigint, s1 bigint, s2 bigint, prefix binary, keys array<bigint>, bits binary"
    spark, buckets = docs.sparkSession, default_buckets(docs.sparkSession)
    described = stage(texts.mapInArrow(_describe(n, threshold, levels), schema), "sets")
    usable = described.filter((F.col("n") > 0) & F.col("id").isNotNull())
    classes = usable.groupBy("s1", "s2", "n").agg(
        F.min(F.struct("id", "prefix", "keys", "bits")).alias("first"), F.count(F.lit(1)).alias("count")
    )
    classes = stage(classes.select("s1", "s2", "n", "count", "first.*"), "classes")

    # lists of two and more, and who leads
    listed = "token bigint, id bigint, n int, pos int"
    entries = classes.select("id", "n", "prefix").mapInArrow(_unroll, listed)
    entries = stage(entries.repartition("token").mapInArrow(_met, listed), "lists")
    keyed = classes.select("id", F.posexplode("keys").alias("key_no", "key"))
    lead = keyed.groupBy("key_no", "key").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("count")).filter(F.col("count") > 1)
    lead = stage(lead, "leaders")
    led = spread_join(keyed, lead.drop("count"), ["key_no", "key"], lead, "count", ["id"])
    # one leader a set, so that a set's text moves once
    led = led.filter(F.col("leader") < F.col("id")).groupBy(F.col("id").alias("b")).agg(F.min("leader").alias("a")).select("a", "b")
    led = stage(led, "led")

    ids = entries.select("id").union(led.select("a")).union(led.select("b")).distinct()
    compared = BucketedTable(spark, new_folder(spark, "texts"), "id BIGINT, text STRING", ["id"], buckets)
    compared.append(texts.join(ids, "id", "left_semi").dropDuplicates(["id"]))
    signatures = BucketedTable(spark, new_folder(spark, "signatures"), "id BIGINT, n BIGINT, bits BINARY", ["id"], buckets)
    signatures.append(classes.join(entries.select("id").distinct(), "id", "left_semi"))
    links = stage(_links(led, compared, n, threshold), "links")
    kin = stage(_pruned(stage(_pivots(entries, threshold), "pivots"), signatures, _FAMILY), "pruned")
    apart = "family bigint, id bigint, linked boolean, n bigint, apart bigint, few bigint, most bigint, tokens binary"
    kin = stage(_with_texts(kin, compared).mapInArrow(_differences(n, threshold), apart), "apart")
    links = links.unionByName(kin.filter("linked").select(F.col("family").alias("a"), F.col("id").alias("b")))
    differ = _differing(kin)
    entries = entries.join(kin.select("id", "family"), "id", "left").withColumn("family", F.coalesce("family", "id"))
    for near in (_NEAR, None):
        labels = components(links)
        component = F.coalesce("component", "id").alias("component")
        known = entries.join(labels, "id", "left").select(*entries.columns, component)
        pairs = known.repartition("token").mapInArrow(_pairs_of(threshold, near), "a bigint, b bigint")
        if near is None:
            known = differ.join(labels, "id", "left").select(*differ.columns, component)
            pairs = pairs.union(known.repartition("family", "token").mapInArrow(_family_pairs(threshold), "a bigint, b bigint"))
        pairs = stage(_pruned(stage(pairs.distinct(), "pairs"), signatures, threshold), "pruned")
        links = stage(links.unionByName(_links(pairs, compared, n, threshold)), "links")
    for table in (compared, signatures):
        table.drop()
    labels = components(links)

    owners = classes.join(labels, "id", "left").select("s1", "s2", "n", F.coalesce("component", "id").alias("component"))
    joined = spread_join(described.select("id", "n", "s1", "s2"), owners, ["s1", "s2", "n"], classes, "count", ["id"])
    return joined.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("component")).otherwise(F.col("id")).alias("component"))


def keep_one_of_each(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id."""
    dropped = similar_sets(docs, n, threshold, id_col, text_col).filter(F.col("id") != F.col("component"))
    return without_ids(docs, id_col, dropped.select("id"))

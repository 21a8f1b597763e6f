"""Hamming neighbours among 64-bit codes: bounded units of work in Spark, and kernels that run inside them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from weft.llm.common import breathe
from weft.operators.components import connected_components
from weft.plans.runtime import cut

#: Codes of a unit up to which its pairs are compared one by one.
FEW = 256
#: Codes in a unit, above which the unit is split by further blocks.
UNIT_LIMIT = 4096
#: Pairs given out at once.
PAIRS = 1_000_000
#: Bits of the blocks that must agree, level by level. After the last level 44 bits agree, so a unit
#: holds at most 2**20 different codes whatever the data.
BLOCKS = ((16, 16, 16, 16), (12, 12, 12, 12), (9, 9, 9, 9), (7, 7, 7, 6))


def _split(items: DataFrame, level: int) -> DataFrame:
    """Each item once per block of its remaining bits: the unit takes the block, ``rest`` loses it."""
    parts, low = [], 0
    for width in BLOCKS[level]:
        value = F.shiftrightunsigned("rest", low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        above = F.when(F.lit(low + width < 64), F.shiftrightunsigned("rest", min(low + width, 63))).otherwise(F.lit(0).cast("long"))
        below = F.col("rest").bitwiseAND(F.lit((1 << low) - 1).cast("long"))
        rest = F.shiftleft(above, low).bitwiseOR(below)
        unit = F.lit(len(parts) << 16).cast("long") + value if level == 0 else F.xxhash64("unit", F.lit(len(parts)), value)
        parts.append(F.struct(unit.alias("unit"), rest.alias("rest")))
        low += width
    names = [c for c in items.columns if c not in ("unit", "rest")]
    return items.select(*names, F.explode(F.array(*parts)).alias("part")).select(*names, "part.unit", "part.rest")


def hamming_units(items: DataFrame, limit: int = UNIT_LIMIT) -> DataFrame:
    """``items`` (with a long ``code``) in units, so that any two codes with at most 3 differing bits meet.

    Pigeonhole: of four blocks, one must be equal. Units of over ``limit`` items are split again by
    four blocks of the bits that are left, and so on, until they are small or 44 bits agree; nothing
    is dropped. Units of one item are left out. The first level has at most 2**18 units, so their
    counts are broadcast; deeper counts are joined by shuffle.
    """
    names = [c for c in items.columns if c not in ("unit", "rest")]
    now = _split(items.select(*names, F.col("code").alias("rest")), 0)
    done = None
    for level in range(len(BLOCKS)):
        counts = now.groupBy("unit").agg(F.count("*").alias("unit_n"))
        counts = cut(counts)
        some = counts.filter("unit_n > 1")
        hot = level + 1 < len(BLOCKS) and not counts.filter(F.col("unit_n") > limit).isEmpty()
        counted = now.join(F.broadcast(some) if level == 0 else some, "unit")
        small = (counted.filter(F.col("unit_n") <= limit) if hot else counted).select("unit", *names)
        done = small if done is None else done.unionByName(small)
        if not hot:
            break
        now = _split(counted.filter(F.col("unit_n") > limit).drop("unit_n"), level + 1)
    return done


def by_unit(units: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame | Iterator[pd.DataFrame]], schema: str, rows: int = 200_000) -> DataFrame:
    """``work`` on frames of whole units, in order of the unit, of about ``rows`` rows; it returns a frame, or yields some."""

    def frames(out) -> Iterator[pd.DataFrame]:
        return out if isinstance(out, Iterator) else iter((out,))

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            n += len(batch)
            if n < rows:
                continue
            whole = pd.concat(held, ignore_index=True)
            last = whole["unit"].iloc[-1]
            edge = int(np.argmax((whole["unit"] == last).to_numpy()))
            held, n = [whole.iloc[edge:]], len(whole) - edge
            if edge:
                yield from frames(work(whole.iloc[:edge].reset_index(drop=True)))
            del whole
        if held:
            yield from frames(work(pd.concat(held, ignore_index=True)))
        held.clear()
        breathe()

    return units.repartition("unit").sortWithinPartitions("unit").mapInPandas(stream, schema)


def _across(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The pairs of codes in a unit that are in different components, the smaller code first."""
    frame = frame.sort_values(["unit", "component"], kind="stable")
    unit, part, codes = (frame[c].to_numpy() for c in ("unit", "component", "code"))
    n = len(codes)
    ends = np.flatnonzero(np.r_[unit[1:] != unit[:-1], True]) + 1
    unit_end = np.repeat(ends, np.diff(np.r_[0, ends]))
    runs = np.flatnonzero(np.r_[(unit[1:] != unit[:-1]) | (part[1:] != part[:-1]), True]) + 1
    run_end = np.repeat(runs, np.diff(np.r_[0, runs]))
    at, sums = 0, np.cumsum(unit_end - run_end)
    while at < n:
        to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + PAIRS, side="right")))
        p = (unit_end - run_end)[at:to]
        i = np.repeat(np.arange(at, to), p)
        j = np.repeat(run_end[at:to], p) + np.arange(len(i)) - np.repeat(np.cumsum(p) - p, p)
        if len(i):
            yield pd.DataFrame({"a": np.minimum(codes[i], codes[j]), "b": np.maximum(codes[i], codes[j])})
        at = to


def _near_across(budget: int) -> Callable[[pd.DataFrame], Iterator[pd.DataFrame]]:
    """As ``_across``, of codes whose fingerprints (``sim``) differ in at most ``budget`` bits: a trie of each component is joined with the unit's others."""

    def work(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        sims = frame["sim"].to_numpy().view(np.uint64)
        order = np.lexsort((sims, frame["component"].to_numpy(), frame["unit"].to_numpy()))
        unit, part, codes, sims = frame["unit"].to_numpy()[order], frame["component"].to_numpy()[order], frame["code"].to_numpy()[order], sims[order]
        for i, j in trie_pairs(unit, sims, budget, PAIRS, part):
            yield pd.DataFrame({"a": np.minimum(codes[i], codes[j]), "b": np.maximum(codes[i], codes[j])})

    return work


def linked_in_units(met: DataFrame, alike: Callable[[DataFrame], DataFrame], budget: int) -> DataFrame:
    """(a, b) links that connect what all links inside units would; ``alike`` keeps the pairs (a, b) that are links.

    ``met`` has unit, code, sim (the code's fingerprint) and lead, the unit's smallest code. Codes are
    compared with their lead first; then, within each unit, tries of the fingerprints give the codes
    that are within ``budget`` bits and not connected by then. So a group of near copies costs its size
    and not its square, and no such pair is left out unless it is connected already.
    """
    stars = cut(met.filter("code <> lead").select(F.col("lead").alias("a"), F.col("code").alias("b")).distinct())
    links = alike(stars)
    groups = connected_components(links, "a", "b").withColumnRenamed("node", "code")
    named = cut(met.join(groups, "code", "left").select("unit", "code", "sim", F.coalesce("component", "code").alias("component")))
    mixed = named.groupBy("unit").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    rest = by_unit(named.join(mixed.select("unit"), "unit", "left_semi"), _near_across(budget), "a long, b long").distinct()
    return links.unionByName(alike(rest.join(stars, ["a", "b"], "left_anti")))


class Groups:
    """Union of index pairs, in bulk; ``root`` gives each index the smallest of its group."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def root(self) -> np.ndarray:
        while True:
            up = self.label[self.label]
            if np.array_equal(up, self.label):
                return self.label
            self.label = up

    def find(self, i: int) -> int:
        """The root of one index, as the labels are now."""
        while self.label[i] != i:
            self.label[i] = self.label[self.label[i]]
            i = int(self.label[i])
        return i

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            label = self.root()
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))


def _run_pairs(unit: np.ndarray, part: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(begin, end, begin, end) of two runs of one part in the same unit, for each two, in bulks."""
    ends = np.flatnonzero(np.r_[(unit[1:] != unit[:-1]) | (part[1:] != part[:-1]), True]) + 1
    begins = np.r_[0, ends[:-1]]
    n = len(ends)
    last = np.flatnonzero(np.r_[unit[begins[1:]] != unit[begins[:-1]], True]) + 1
    partners = np.repeat(last, np.diff(np.r_[0, last])) - np.arange(n) - 1
    at, sums = 0, np.cumsum(partners)
    while at < n:
        to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + most, side="right")))
        p = partners[at:to]
        i = np.repeat(np.arange(at, to), p)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(p) - p, p)
        yield begins[i], ends[i], begins[j], ends[j]
        at = to


def trie_pairs(unit: np.ndarray, codes: np.ndarray, budget: int = 3, most: int = 2_000_000, part: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of codes in the same unit with at most ``budget`` differing bits, in bulks.

    With ``part``, by which codes are sorted within units, each part has a trie of its own, which is
    joined with those of the unit's other parts, and not with itself.

    A binary trie over codes that are sorted in each unit, as ranges: a node of depth d is a range
    whose first d bits agree, and its children are the range's zeros and ones. Pairs of nodes go down
    together from each unit's root with itself; a pair whose branches differ has one more error, and
    is dropped beyond the budget. Two leaves are compared outright. The work list is cut into pieces
    of ``most`` pairs, deepest first, so that memory stays bounded.
    """
    if not len(codes):
        return
    edges = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1], True])
    start, end = edges[:-1], edges[1:]
    wide = end - start > 1
    start, end = start[wide], end[wide]
    ones: dict[int, np.ndarray] = {}
    roots = iter([(start, end, start, end)]) if part is None else _run_pairs(unit, part, most)
    stack = []
    while True:
        if not stack:
            root = next(roots, None)
            if root is None:
                return
            stack.append((0, *root, np.zeros(len(root[0]), np.int8)))
        depth, a0, a1, b0, b1, err = stack.pop()
        if len(a0) > most:
            half = len(a0) // 2
            stack.append((depth, *(x[half:] for x in (a0, a1, b0, b1, err))))
            stack.append((depth, *(x[:half] for x in (a0, a1, b0, b1, err))))
            continue
        leaves = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaves.any():
            i, j = a0[leaves], b0[leaves]
            near = (i != j) & (np.bitwise_count(codes[i] ^ codes[j]) <= budget)
            if near.any():
                yield i[near], j[near]
            a0, a1, b0, b1, err = (x[~leaves] for x in (a0, a1, b0, b1, err))
        if not len(a0) or depth == 64:
            if len(a0):  # equal codes, should a unit have them
                for s, e, t, f in zip(a0, a1, b0, b1, strict=True):
                    i, j = (x.ravel() for x in np.meshgrid(np.arange(s, e), np.arange(t, f), indexing="ij"))
                    yield i[i < j], j[i < j]
            continue
        if depth not in ones:
            bit = (codes >> np.uint64(63 - depth)) & np.uint64(1)
            ones[depth] = np.r_[0, np.cumsum(bit.astype(np.int64))]
        c = ones[depth]
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        own = (a0 == b0) & (a1 == b1)
        parts = []
        for s, e, t, f, more, keep in (
            (a0, am, b0, bm, 0, None), (am, a1, bm, b1, 0, None), (a0, am, bm, b1, 1, None), (am, a1, b0, bm, 1, ~own)
        ):
            ok = (e > s) & (f > t) & (err + more <= budget)
            if keep is not None:
                ok &= keep
            if more == 0:  # a leaf with itself
                ok &= ~(own & (e - s == 1))
            parts.append((s[ok], e[ok], t[ok], f[ok], (err[ok] + more).astype(np.int8)))
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*parts, strict=True))))


def near_pairs(unit: np.ndarray, codes: np.ndarray, budget: int = 3, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As ``trie_pairs``, where units of few codes, which a walk doesn't help, are compared outright."""
    n = len(codes)
    edges = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1], True])
    size = np.diff(edges)
    large = np.repeat(size > FEW, size)
    if large.any():
        own = np.flatnonzero(large)
        for a, b in trie_pairs(unit[own], codes[own], budget, most):
            yield own[a], own[b]
    partners = np.where(large, 0, np.repeat(edges[1:], size) - np.arange(n) - 1)
    sums = np.cumsum(partners)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + most, side="right")))
        p = partners[at:to]
        i = np.repeat(np.arange(at, to), p)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(p) - p, p)
        near = np.bitwise_count(codes[i] ^ codes[j]) <= budget
        if near.any():
            yield i[near], j[near]
        at = to


#: The eight bits of a byte, each in a lane of eight bits; the lowest bit in the lowest lane.
LANES = np.array([sum(((v >> b) & 1) << (8 * b) for b in range(8)) for v in range(256)], dtype=np.uint64)
#: Hashes that such lanes can sum.
LANE_HASHES = 255


def lane_sums(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(groups, 64) counts of set bits, bit 0 first, of groups of 1 to LANE_HASHES consecutive hashes."""
    out = np.empty((len(starts), 64), np.int64)
    octets = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    for k in range(8):
        total = np.add.reduceat(LANES[octets[:, k]], starts)
        out[:, 8 * k : 8 * k + 8] = total.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    return out


def pack_majority(lanes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """uint64 per group: bit set where over half of the group's hashes have it."""
    bits = (2 * lanes > np.asarray(counts)[:, None]).astype(np.uint64)
    return (bits << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

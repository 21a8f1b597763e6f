"""Fuzzy line dedup: normalised lines meet in blocks, SimHash and edit similarity decide, one line of each group stays.

Blocks of SimHash bits can't propose lines of an edit similarity of 0.8: their SimHashes differ in 7 of
64 bits as a rule and in 13 often, and blocks that survive 13 changed bits have four bits each. So the
blocks that must be equal are of minima of word pairs (MinHash), and SimHash prunes what meets there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from weft.llm.common import breathe, let, marked, row_hash
from weft.llm.edits import within
from weft.llm.hamming import LANE_HASHES, Groups, by_unit, lane_sums, pack_majority
from weft.operators.components import connected_components
from weft.plans.runtime import as_planned, cut, reclaim, ship, stored

#: Least edit similarity of linked lines: 1 - distance / length of the longer, in characters.
SIMILARITY = 0.8
#: SimHash bits in which linked lines of WORDY characters or more may differ: 99.8 % of similar pairs do.
BUDGET = 20
#: Share of their different pairs of neighbouring words that such lines must have in common; 99.7 % of similar pairs do.
SHARED = 0.55
#: Characters up to which lines meet by what is left of them without up to two characters: all similar ones do.
SHORT = 14
#: Lines of fewer characters meet by runs of five characters, lines of WORDY or more by pairs of words. Similar
#: lines, whose lengths differ by a fifth at most, are both of the one sort or both of the other.
LETTERED, WORDY = 75, 48
#: MinHash bands, each of so many minima, of runs of characters and of pairs of words.
LETTER_BANDS, WORD_BANDS, MINIMA = 24, 10, 3
_RANDOM = np.random.default_rng(12)
_TIMES = _RANDOM.integers(0, 1 << 31, MINIMA * LETTER_BANDS, np.uint32) * np.uint32(2) + np.uint32(1)
#: A fourth of the characters of lines that are handed on at once, and the characters that are hashed at once.
PIECE, BULK = 1 << 19, 1 << 17
#: What a word's bytes are multiplied by powers of, and these powers once they are made.
_FACTOR = 0x100000001B3
_KEPT: list[np.ndarray] = []
#: Rows of a unit above which it is split into pairs of parts of so many rows.
UNIT_ROWS = 256
#: Lines of a frame in which units are compared, pairs of them that are looked at, and that are compared, at once.
FRAME_ROWS, PAIRS, COMPARED = 16_000, 1_000_000, 8192
#: Bits of the hashes of word pairs that are compared; a bulk has fewer lines of WORDY characters, and a step fewer pairs, than the others can number.
KEPT_BITS = 50
#: What str.split() takes for space.
_BLANKS = r"[\t\n\x0B\f\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
#: Units have so many bits: those of BUCKETS, by which they are dealt out, and 32 that are sent. A few more lines than
#: share a band meet so, and are compared. A task sends, and looks at, so many units at once.
BUCKETS, HELD = 1 << 12, 1 << 20
#: Bytes of batches that are put together to be compared at once.
GATHERED = 16 << 20
#: Bits of the filter that finds wanted lines again: it only saves work, and its words reach the driver.
FILTER_BITS = 1 << 24


def normal(line: str) -> str:
    """Lower case, with single spaces between words and none around."""
    return " ".join(line.lower().split())


def line_keys(lines: list[str]) -> np.ndarray:
    """(n, 2) numbers that name each normalised line: 128 bits of its XXH3."""
    raw = b"".join([xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass")) for line in lines])
    return np.frombuffer(raw, "<i8").reshape(-1, 2)


def _mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    hashes = (hashes ^ (hashes >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return hashes ^ (hashes >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of a word hash's factor and of its inverse, modulo 2 ** 64; those of a bulk are kept."""
    if not _KEPT:
        _KEPT.extend(_powers_of(x, 4 * BULK) for x in (_FACTOR, pow(_FACTOR, -1, 1 << 64)))
    if n > len(_KEPT[0]):
        return _powers_of(_FACTOR, n), _powers_of(pow(_FACTOR, -1, 1 << 64), n)
    return _KEPT[0][:n], _KEPT[1][:n]


def _powers_of(factor: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(factor))
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _word_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of words of each line."""
    raw = np.frombuffer("\n".join(lines).encode("utf-8", "surrogatepass") + b"\n", np.uint8)
    last = raw == 10
    gaps, ends = np.flatnonzero(last | (raw == 32)), np.flatnonzero(last)
    begins = np.r_[0, gaps[:-1] + 1]
    # Bytes weigh by their place in all lines; then each word's sum is brought to its begin. UTF-8 has no byte 255.
    power, inverse = _powers(len(raw))
    raw = raw + np.uint8(1)
    raw[ends] = 33  # as after other words
    hashes = np.add.reduceat(raw * power, begins) * inverse[begins]
    return _mixed(hashes), np.diff(np.r_[-1, np.searchsorted(gaps, ends)])


def _simhashes(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    firsts = np.cumsum(counts) - counts
    # Lanes hold so many words; a longer line is summed in parts.
    parts = -(-counts // LANE_HASHES)
    owner = np.repeat(np.arange(len(counts)), parts)
    starts = firsts[owner] + LANE_HASHES * (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts))
    sums = np.add.reduceat(lane_sums(hashes, starts), np.cumsum(parts) - parts, axis=0)
    return pack_majority(sums, counts)


def simhash_lines(lines: list[str]) -> np.ndarray:
    """SimHash over the words of normalised, non-empty lines (which have single spaces)."""
    return np.concatenate([_simhashes(*_word_hashes(some)) for some in _bulks(lines)]) if lines else np.zeros(0, np.uint64)


def _bulks(lines: list[str]) -> Iterator[list[str]]:
    at = 0
    while at < len(lines):
        to, n = at, 0
        while to < len(lines) and (to == at or n + len(lines[to]) <= BULK):
            n += len(lines[to]) + 1
            to += 1
        yield lines[at:to]
        at = to


def _bands(features: np.ndarray, counts: np.ndarray, bands: int) -> np.ndarray:
    """(groups, bands) keys of the MinHash bands of groups of so many consecutive features."""
    starts = np.cumsum(counts) - counts
    small = (features >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(counts), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(counts), np.uint64(bands << 16 | band))
        for k in range(MINIMA * band, MINIMA * band + MINIMA):
            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(small * _TIMES[k], starts))
        out[:, band] = key
    return out


def _pairs_of(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pairs of neighbouring words, where a line's begin and end count as words, and their number by line."""
    firsts = np.cumsum(counts) - counts
    before, after = np.insert(hashes, firsts, np.uint64(1)), np.insert(hashes, firsts + counts, np.uint64(2))
    return _mixed(before * np.uint64(0x9E3779B97F4A7C15) + after), counts + 1


def _word_pairs(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return _pairs_of(*_word_hashes(lines))


def signatures(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """SimHashes and word bands, of 32 bits each, of normalised, non-empty lines, whose words are hashed once for both."""
    sims, bands = [np.zeros(0, np.uint64)], [np.zeros((0, WORD_BANDS), np.uint32)]
    for some in _bulks(lines):
        hashes, counts = _word_hashes(some)
        sims.append(_simhashes(hashes, counts))
        bands.append(_bands(*_pairs_of(hashes, counts), WORD_BANDS).astype(np.uint32))
    return np.concatenate(sims), np.concatenate(bands)


def _word_bands(lines: list[str]) -> np.ndarray:
    return _bands(*_word_pairs(lines), WORD_BANDS)


def _letter_bands(lines: list[str]) -> np.ndarray:
    """Bands of the runs of five characters, with two before and after the line."""
    raw = np.frombuffer("".join(f"\0\0{x}\0\0" for x in lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    counts = np.fromiter(map(len, lines), np.int64, len(lines))
    starts = np.cumsum(counts + 4) - counts - 4
    at = np.repeat(starts, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    runs = np.zeros(len(at), np.uint64)
    for k in range(5):
        runs = _mixed(runs + raw[at + k])
    return _bands(runs, counts, LETTER_BANDS)


def _left_of(line: str) -> set[int]:
    """Hashes of a short line and of what is left of it without as many characters as may differ."""
    most = int((1 - SIMILARITY) * len(line) + 1e-9)
    kept = {"".join(c) for n in range(most + 1) for c in combinations(line, len(line) - n)}
    return {xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 7) for x in kept}


def _units(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The units in which lines meet, and for each the number of its line."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    owners, units = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for chosen, make in ((size >= WORDY, _word_bands), (size < LETTERED, _letter_bands)):
        if chosen.any():
            own = np.flatnonzero(chosen)
            found = np.concatenate([make(some) for some in _bulks([lines[k] for k in own.tolist()])])
            owners.append(np.repeat(own, found.shape[1]))
            units.append(found.ravel())
    for k in np.flatnonzero(size <= SHORT).tolist():
        left = _left_of(lines[k])
        owners.append(np.full(len(left), k))
        units.append(np.fromiter(left, np.uint64, len(left)))
    return np.concatenate(units), np.concatenate(owners)


def similar(a: str, b: str, least: float = SIMILARITY) -> bool:
    return bool(alike([a], [b], least)[0])


def alike(a: list[str], b: list[str], least: float = SIMILARITY, likely: bool = True) -> np.ndarray:
    """Whether each pair of lines has an edit similarity of ``least`` or more."""
    longest = np.fromiter((max(len(x), len(y)) for x, y in zip(a, b, strict=True)), np.int64, len(a))
    return within(a, b, np.floor((1 - least) * longest + 1e-9).astype(np.int64), likely)


#: What str.split() takes for space, but for a single space and the line break.
_OTHER_SPACES = "\t\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def normal_lines(text: str) -> list[str]:
    """``normal`` of each line of a text; at once where no line has other than single spaces between words."""
    lines = text.lower().split("\n")
    if "  " in text or any(c in text for c in _OTHER_SPACES) or any(x[:1] == " " or x[-1:] == " " for x in lines):
        return [normal(line) for line in text.split("\n")]
    return lines


def _text_lines(texts: pa.Array) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """(row, line number, normalised line) of lines that aren't blank, as three lists, in bulks."""
    rows, numbers, lines, size = [], [], [], 0
    for row, text in enumerate(texts.to_pylist()):
        for k, line in enumerate(normal_lines(text) if text else ()):
            if line:
                rows.append(row)
                numbers.append(k)
                lines.append(line)
                size += len(line)
        if size > 4 * PIECE:
            yield rows, numbers, lines
            rows, numbers, lines, size = [], [], [], 0
    if lines:
        yield rows, numbers, lines


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have so many rows, or GATHERED bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows or sum(x.nbytes for x in held) >= GATHERED:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _in_batches(docs: DataFrame, work: Callable[[pa.RecordBatch, set], Iterator[pa.RecordBatch]], schema: str, rows: int = 1) -> DataFrame:
    """``work`` on batches of ``rows`` or more; it gets a set, for lines that the task has had, which is emptied when it is large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in _gathered(batches, rows) if rows > 1 else batches:
            yield from work(batch, seen)
            if len(seen) > 200_000:
                seen.clear()
            breathe()
        seen.clear()
        breathe()

    return docs.mapInArrow(run, schema)


def _dealt(units: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Buckets, and for each the 32 low bits of its units, and their lines' codes, as bytes."""
    bucket = (units >> np.uint64(32)).astype(np.uint16) & np.uint16(BUCKETS - 1)
    order = np.argsort(bucket, kind="stable")
    counts = np.bincount(bucket, minlength=BUCKETS)
    used = np.flatnonzero(counts)
    ends = np.r_[0, np.cumsum(counts[used])]
    packed = [
        pa.Array.from_buffers(pa.binary(), len(used), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x)])
        for x in (units.astype(np.uint32)[order], codes[order])
    ]
    return used, *packed


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, row_hash, line_no, k1, k2) of every line that isn't blank, without its text, and rows of units.

    k1 and k2 name the line. Rows with a bucket have no line, but ``units`` in which lines meet others and
    ``codes``, the k1 of each unit's line; a task gives those of a line once, as a rule.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        schema = None

        def given() -> pa.RecordBatch:
            used, units, codes = _dealt(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            none = [pa.nulls(len(used), schema.field(k).type) for k in range(5)]
            return pa.RecordBatch.from_arrays([*none, pa.array(used, pa.int32()), units, codes], schema=schema)

        for batch in batches:
            for rows, numbers, lines in _text_lines(batch.column(2)):
                keys = line_keys(lines)
                new = []
                for k, key in enumerate(keys[:, 0].tolist()):
                    if key not in seen:
                        seen.add(key)
                        new.append(k)
                units, owner = _units([lines[k] for k in new])
                if len(units):
                    held.append((units, keys[new, 0][owner]))
                at = pa.array(rows)
                columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(numbers, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1])]
                columns += [pa.nulls(len(lines), pa.int32()), pa.nulls(len(lines), pa.binary()), pa.nulls(len(lines), pa.binary())]
                out = pa.RecordBatch.from_arrays(columns, ["doc_id", "row_hash", "line_no", "k1", "k2", "bucket", "units", "codes"])
                schema = out.schema
                yield out
                if sum(len(x) for x, _ in held) >= HELD:
                    yield given()
            if len(seen) > 200_000:
                seen.clear()
            breathe()
        if held:
            yield given()
        seen.clear()
        breathe()

    rows = docs.select("doc_id", row_hash().alias("row_hash"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, row_hash long, line_no long, k1 long, k2 long, bucket int, units binary, codes binary")


def _meetings(units: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, code, lead), each once, of the units of several codes; the lead is the smallest code of the unit."""
    order = np.argsort(units)
    same, hit = units[order[1:]] == units[order[:-1]], np.zeros(len(units), bool)
    hit[1:] = same
    hit[:-1] |= same
    own = order[hit]
    own = own[np.lexsort((codes[own], units[own]))]
    u, c = units[own], codes[own]
    new = np.r_[True, u[1:] != u[:-1]] if len(u) else np.zeros(0, bool)
    other = new | np.r_[True, c[1:] != c[:-1]] if len(u) else new
    u, c, new = u[other], c[other], new[other]
    begins = np.flatnonzero(new)
    size = np.diff(np.r_[begins, len(u)])
    lead, several = np.repeat(c[begins], size), np.repeat(size > 1, size)
    return u[several], c[several], lead[several]


def _met(rows: DataFrame) -> DataFrame:
    """(unit, code, lead) of the units of several lines; the code is a line's k1, and the lead the smallest of the unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units: list[np.ndarray] = []
        codes: list[np.ndarray] = []
        n, last = 0, -1

        def found() -> pa.RecordBatch:
            got = _meetings(np.concatenate(units), np.concatenate(codes))
            units.clear()
            codes.clear()
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in got], ["unit", "code", "lead"])

        for batch in batches:
            for bucket, low, own in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if bucket != last and n >= HELD:  # whole buckets only
                    yield found()
                    n = 0
                last = bucket
                units.append(np.frombuffer(low, np.uint32) | np.uint64(bucket << 32))
                codes.append(np.frombuffer(own, np.int64))
                n += len(codes[-1])
        if n:
            yield found()
        breathe()

    dealt = rows.filter("bucket IS NOT NULL").select("bucket", "units", "codes").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "unit long, code long, lead long")


def _items(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(code, k2, norm, size, sim, bands) of the wanted lines, each once: their text, its characters, SimHash and word bands, of 32 bits each.

    ``wanted`` has code. Texts are read again, and only lines that may be wanted leave their task, by a
    bitmap of codes.
    """
    spark = docs.sparkSession
    words = wanted.select((F.shiftrightunsigned("code", 5).bitwiseAND(F.lit(FILTER_BITS // 32 - 1).cast("long"))).alias("at"), F.expr("shiftleft(1L, cast(code & 31 as int))").alias("bit"))
    got = words.groupBy("at").agg(F.bit_or("bit").alias("word")).toPandas()
    bitmap = np.zeros(FILTER_BITS // 32, np.uint32)
    bitmap[got["at"].to_numpy()] = got["word"].to_numpy()
    sent = spark.sparkContext.broadcast(bitmap)

    def work(batch: pa.RecordBatch, seen: set) -> Iterator[pa.RecordBatch]:
        for _, _, lines in _text_lines(batch.column(0)):
            keys = line_keys(lines)
            code = keys[:, 0].view(np.uint64)
            hit = np.flatnonzero(sent.value[(code >> np.uint64(5)) & np.uint64(FILTER_BITS // 32 - 1)] >> (code & np.uint64(31)).astype(np.uint32) & np.uint32(1))
            new = []
            for k, key in zip(hit.tolist(), keys[hit, 0].tolist(), strict=True):
                if key not in seen:
                    seen.add(key)
                    new.append(k)
            if new:
                own = [lines[k] for k in new]
                sims, bands = signatures(own)
                packed = pa.array([x.tobytes() if len(line) >= WORDY else None for x, line in zip(bands, own, strict=True)], pa.binary())
                size = pa.array(np.fromiter(map(len, own), np.int64, len(own)))
                columns = [pa.array(keys[new, 0]), pa.array(keys[new, 1]), pa.array(own, pa.string()), size, pa.array(sims.view(np.int64)), packed]
                yield pa.RecordBatch.from_arrays(columns, ["code", "k2", "norm", "size", "sim", "bands"])

    found = _in_batches(docs.select("text"), work, "code long, k2 long, norm string, size long, sim long, bands binary")
    return found.join(wanted, "code", "left_semi").dropDuplicates(["code"])


def _plausible(size_a: np.ndarray, size_b: np.ndarray, sim_a: np.ndarray, sim_b: np.ndarray) -> np.ndarray:
    """Pairs that their lengths, and if they are long enough their SimHashes, don't tell apart."""
    longest = np.maximum(size_a, size_b)
    near = np.bitwise_count(sim_a ^ sim_b) <= BUDGET
    return (np.abs(size_a - size_b) <= (1 - SIMILARITY) * longest + 1e-9) & (near | (np.minimum(size_a, size_b) < WORDY))


def _share_words(texts: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs of lines of which one is short, or that have SHARED of the different word pairs of either in common."""
    out = np.fromiter((len(x) < WORDY for x in texts), bool, len(texts))
    out = out[a] | out[b]
    ask = np.flatnonzero(~out)
    mark = np.zeros(len(texts), bool)
    mark[a[ask]] = mark[b[ask]] = True
    used = np.flatnonzero(mark)
    # Each line's different pairs, by KEPT_BITS of their hashes, below its number, so that one sort is of all lines.
    kept, sizes, low = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64), np.uint64(64 - KEPT_BITS)
    at = 0
    for some in _bulks([texts[k] for k in used.tolist()]):
        hashes, counts = _word_pairs(some)
        keys = np.repeat(np.arange(len(some), dtype=np.uint64) << np.uint64(KEPT_BITS), counts) | hashes >> low
        keys.sort()
        keys = keys[np.r_[True, keys[1:] != keys[:-1]]]
        sizes[used[at : at + len(some)]] = np.bincount((keys >> np.uint64(KEPT_BITS)).view(np.int64), minlength=len(some))
        kept.append(keys & np.uint64((1 << KEPT_BITS) - 1))
        at += len(some)
    every, starts = np.concatenate(kept), np.cumsum(sizes) - sizes
    for begin in range(0, len(ask), 4096):
        own = ask[begin : begin + 4096]
        line = np.concatenate([a[own], b[own]])
        n = sizes[line]
        where = np.repeat(starts[line] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pair = np.arange(len(own), dtype=np.uint64) << np.uint64(KEPT_BITS)
        keys = np.repeat(np.concatenate([pair, pair]), n) | every[where]
        keys.sort()
        same = (keys[1:][keys[1:] == keys[:-1]] >> np.uint64(KEPT_BITS)).view(np.int64)
        out[own] = np.bincount(same, minlength=len(own)) >= SHARED * np.maximum(n[: len(own)], n[len(own) :])
    return out


def _linked_leads(met: DataFrame, items: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of lines that are similar to the lead of a unit. Texts are only brought to pairs that are plausible."""
    pairs = met.filter("code <> lead").select(F.col("lead").alias("a"), F.col("code").alias("b")).distinct()
    brief, own = items.select("code", "size", "sim"), texts.select("code", "norm")
    pairs = pairs.join(brief.toDF("b", "n", "t").hint("shuffle_hash"), "b").join(brief.toDF("a", "m", "s").hint("shuffle_hash"), "a")
    far = F.abs(F.col("m") - F.col("n")) > (1 - SIMILARITY) * F.greatest("m", "n") + 1e-9
    near = (F.bit_count(F.col("s").bitwiseXOR(F.col("t"))) <= BUDGET) | (F.least("m", "n") < WORDY)
    pairs = pairs.filter(~far & near).select("a", "b")
    both = pairs.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b").select("a", "b", "x", "y")

    def work(batch: pa.RecordBatch, _: set) -> Iterator[pa.RecordBatch]:
        x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        some = np.arange(len(x))
        some = some[_share_words(x + y, some, some + len(x))]
        good = some[alike([x[k] for k in some.tolist()], [y[k] for k in some.tolist()])]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), batch.column(1).take(pa.array(good))], ["a", "b"])

    return _in_batches(both, work, "a long, b long", COMPARED)


def _sorted_by_part(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.sort_values(["unit", "component"], kind="stable", ignore_index=True)


def _plausible_pairs(frame: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of a unit that are in different components and may be similar, of a frame that is ``_sorted_by_part``, in bulks.

    A pair that meets in several units of word bands is in that of the first band only.
    """
    unit, part, half, size = (frame[c].to_numpy() for c in ("unit", "component", "half", "size"))
    band, sim = frame["band"].to_numpy(), frame["sim"].to_numpy().view(np.uint64)
    n = len(frame)
    signed = np.zeros((n, WORD_BANDS), np.uint32)
    wordy = np.array([x is not None for x in frame["bands"]], bool)
    if wordy.any():
        signed[wordy] = np.frombuffer(b"".join(x for x in frame["bands"] if x is not None), np.uint32).reshape(-1, WORD_BANDS)
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
        at = to
        ok = _plausible(size[i], size[j], sim[i], sim[j]) & ((half[i] < 0) | (half[i] != half[j]))
        i, j = i[ok], j[ok]
        equal = (signed[i] == signed[j]) & (wordy[i] & wordy[j])[:, None]
        first = np.where(equal.any(axis=1), equal.argmax(axis=1), -1)
        here = (first < 0) | (signed[i, np.maximum(first, 0)] == (band[i] & 0xFFFFFFFF).astype(np.uint32))
        yield i[here], j[here]


def _in_question(frame: pd.DataFrame) -> pd.DataFrame:
    """The rows that are in any of the ``_plausible_pairs``, which needn't have texts yet."""
    frame = _sorted_by_part(frame)
    some = np.zeros(len(frame), bool)
    for i, j in _plausible_pairs(frame):
        some[i] = some[j] = True
    return frame[some]


def _across(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Links (a, b) between components that have similar lines in a unit; connected ones aren't compared."""
    frame = _sorted_by_part(frame)
    part, sim = frame["component"].to_numpy(), frame["sim"].to_numpy().view(np.uint64)
    texts = frame["norm"].tolist()
    n = len(texts)
    groups = Groups(n)
    # Rows of one component are one from the start, in whatever units they are.
    order = np.argsort(part, kind="stable")
    begins = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]])
    groups.label[order] = np.repeat(order[begins], np.diff(np.r_[begins, n]))
    for i, j in _plausible_pairs(frame):
        shared = _share_words(texts, i, j)
        i, j = i[shared], j[shared]
        # Near SimHashes first: what they link needn't be compared again.
        order = np.argsort(np.bitwise_count(sim[i] ^ sim[j]), kind="stable")
        i, j = i[order], j[order]
        for begin in range(0, len(i), COMPARED):
            a, b = i[begin : begin + COMPARED], j[begin : begin + COMPARED]
            label = groups.root()
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            good = alike([texts[k] for k in a.tolist()], [texts[k] for k in b.tolist()], likely=False)
            if good.any():
                groups.union(a[good], b[good])
                yield pd.DataFrame({"a": part[a[good]], "b": part[b[good]]})


def _linked_across(met: DataFrame, items: DataFrame, texts: DataFrame, parts: DataFrame) -> DataFrame:
    """(a, b) of components (of ``parts``, which has code and component, or of one line) with similar lines that meet in a unit.

    Units of over UNIT_ROWS rows are split into parts, and each two parts meet by themselves.
    """
    named = met.join(parts, "code", "left").select("unit", "code", F.coalesce("component", "code").alias("component")).repartition("unit")
    mixed = named.groupBy("unit").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).filter("low <> high")
    rest = named.join(mixed.select("unit", F.ceil(F.col("n") / UNIT_ROWS).cast("int").alias("parts")).hint("shuffle_hash"), "unit")
    rest = rest.withColumn("part", F.pmod(F.xxhash64("code"), F.col("parts").cast("long")).cast("int"))
    rest = rest.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    rest = rest.select(
        F.when(F.col("parts") == 1, F.col("unit")).otherwise(F.xxhash64("unit", low, high)).alias("unit"), F.col("unit").alias("band"),
        # Within a pair of parts, lines of one part don't meet again.
        F.when(low == high, -1).otherwise(F.col("part")).alias("half"), "code", "component",
    )
    # Texts are only brought to rows that have to be compared.
    brief = items.select("code", "size", "sim", "bands")
    schema = "code long, unit long, band long, half int, component long, size long, sim long, bands binary"
    rest = by_unit(rest.hint("shuffle_hash").join(brief, "code"), _in_question, schema, rows=FRAME_ROWS)
    return by_unit(rest.join(texts.select("code", "norm"), "code"), _across, "a long, b long", rows=FRAME_ROWS)


def line_links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(code, k2, component) of the lines that are linked to another; ``rows`` as of ``line_rows``.

    Lines link if they meet in a unit, their SimHashes differ in at most BUDGET bits and they share word pairs
    (both unless they are short), and their edit similarity is SIMILARITY or more. Equal lines are one line from the start. Lines are compared with
    their units' leads first; and then with what they aren't connected to by then, so that a group of
    near copies costs its size and not its square.
    """
    spark = docs.sparkSession
    met = cut(_met(rows))
    reclaim(spark)
    with as_planned(spark):  # so that texts aren't moved when they are joined by code
        texts = cut(_items(docs, met.select("code").distinct()))
    reclaim(spark)
    with stored(texts.drop("norm")) as items:
        parts = connected_components(cut(_linked_leads(met, items, texts)), "a", "b").withColumnRenamed("node", "code")
        reclaim(spark)
        across = cut(_linked_across(met, items, texts, parts).distinct())
        reclaim(spark)
        # A component is named by its smallest line, and so is what several of them make up.
        whole = connected_components(across, "a", "b").withColumnRenamed("component", "whole")
        parts = parts.join(whole, F.col("component") == F.col("node"), "full").select(F.coalesce("code", "node").alias("code"), F.coalesce("whole", "component").alias("component"))
        return cut(items.select("code", "k2").join(parts, "code"))


def _drops(docs: DataFrame) -> DataFrame:
    """(drop_id, drop_hash, drop_lines, drop_times): by row, the line numbers that go, and how many rows are the same."""
    with stored(line_rows(docs)) as table:
        linked = line_links(docs, table)
        reclaim(docs.sparkSession)
        rows = table.filter("bucket IS NULL").drop("bucket", "units", "codes")
        again = rows.groupBy("k1", "k2").agg(F.count("*").alias("n")).filter("n > 1").select("k1", "k2")
        groups = again.withColumn("component", F.lit(None).cast("long")).unionByName(linked.select(F.col("code").alias("k1"), "k2", "component"))
        groups = groups.groupBy("k1", "k2").agg(F.max("component").alias("component"))
        # A component's number is a k1; a line that is only repeated is a group by its whole name.
        own = F.coalesce("component", "k1").alias("group"), F.when(F.col("component").isNull(), F.col("k2")).otherwise(0).alias("group_k2")
        place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash", "line_no")
        placed = cut(rows.join(groups.hint("shuffle_hash"), ["k1", "k2"]).select(*own, place.alias("place")))
    firsts = placed.groupBy("group", "group_k2").agg(F.min("place").alias("first"))
    out = placed.join(firsts.hint("shuffle_hash"), ["group", "group_k2"]).select("place.doc_id", "place.row_hash", "place.line_no", (F.col("place") == F.col("first")).alias("stays"))
    # Rows that repeat another's id and text have its places, too. Both groupings are of rows that lie by document.
    out = out.repartition("doc_id", "row_hash").groupBy("doc_id", "row_hash", "line_no").agg(F.first("stays").alias("stays"), F.count("*").cast("int").alias("times"))
    return out.groupBy(F.col("doc_id").alias("drop_id"), F.col("row_hash").alias("drop_hash")).agg(
        F.collect_list(F.when(~F.col("stays"), F.col("line_no"))).alias("drop_lines"), F.max("times").alias("drop_times")
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` whose text lacks repeated lines, with n_lines and n_removed; columns of these names are replaced.

    One line of each group stays: the first by doc_id (null last), hash of the row, and line number. Blank
    lines always stay. A null text stays null and has no lines. Rows of one doc_id, or of none, with
    different texts are different documents. Of rows that repeat both, one keeps what is said above,
    and the others lose all lines that aren't blank. A document all of whose lines go has an empty
    text, or its blank lines. Only line numbers, names and units are shuffled before the one join that
    brings line numbers to texts, which rows without any bypass.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("n_lines", "n_removed")
    drops = cut(_drops(docs.select("doc_id", "text")))
    reclaim(spark)
    doc_id, text = F.col("line_doc.doc_id"), F.col("line_doc.text")
    whole = docs.select(F.struct(*docs.columns).alias("line_doc"), row_hash().alias("line_hash"))
    whole = marked(whole, F.col("line_hash"), drops.filter("drop_times > 1 OR size(drop_lines) > 0"), F.col("drop_hash"), "line_may")
    met = whole.filter("line_may").join(drops.hint("shuffle_hash"), doc_id.eqNullSafe(F.col("drop_id")) & (F.col("line_hash") == F.col("drop_hash")), "left")

    every = F.split(text, "\n")
    left = let(
        every,
        lambda x: F.transform(
            F.array_except(F.sequence(F.lit(0).cast("long"), F.size(x).cast("long") - 1), F.col("drop_lines")), lambda k: F.get(x, k.cast("int"))
        ),
    )
    n_drops = F.coalesce(F.when(F.col("drop_lines").isNull(), 0).otherwise(F.size("drop_lines")), F.lit(0))
    without = F.when(n_drops > 0, F.array_join(left, "\n")).otherwise(text)
    parts = [
        whole.filter(~F.col("line_may")).select("line_doc", F.lit(0).alias("line_drops"), text.alias("line_text")),
        met.filter("drop_times IS NULL OR drop_times = 1").select("line_doc", n_drops.alias("line_drops"), without.alias("line_text")),
    ]
    if not drops.filter("drop_times > 1").isEmpty():
        blanks = F.filter(every, lambda x: F.length(F.regexp_replace(x, _BLANKS, "")) == 0)
        nth = met.filter("drop_times > 1").withColumn("line_nth", F.expr("row_number() OVER (PARTITION BY drop_id, drop_hash ORDER BY drop_hash)"))
        first = F.col("line_nth") == 1
        parts.append(
            nth.select(
                "line_doc",
                F.when(first, n_drops).otherwise(F.size(every) - F.size(blanks)).alias("line_drops"),
                F.when(first, without).otherwise(F.array_join(blanks, "\n")).alias("line_text"),
            )
        )
    joined = reduce(DataFrame.unionByName, parts)
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return joined.select(
        *[F.col("line_text").alias(c) if c == "text" else F.col("line_doc").getField(c).alias(c) for c in docs.columns],
        F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.col("line_drops").cast("long").alias("n_removed"),
    )

"""Near-duplicates: SimHash fingerprints joined by a binary trie, alone or followed by the Jaccard similarity of word shingles; components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from weft.llm.common import frame_udf, marked, row_hash, series_udf
from weft.llm.hamming import LANE_HASHES, Groups, lane_sums, by_unit, hamming_units, linked_in_units, pack_majority, trie_pairs
from weft.operators.components import connected_components
from weft.plans.runtime import cut, reclaim, ship

#: Bytes of a text that are taken apart at once.
PIECE = 1 << 20
#: Of the near-duplicate stage: words of a shingle, and the least Jaccard similarity of linked texts.
WIDTH, LEAST = 5, 0.8
#: MinHash bands, each of so many minima, that deal texts to units: at a similarity of 0.8 they miss 3 in 100,000.
BANDS, MINIMA = 20, 4
#: Bits in which the fingerprints of texts that are compared may differ: at a similarity of 0.8 they differ in 8 to 12,
#: and in over 26 in 1 of 100,000 pairs of 5 shingles, and in none of 648,000 simulated pairs of 15 to 200.
BUDGET = 26
_RANDOM = np.random.default_rng(11)
_TIMES = _RANDOM.integers(0, 1 << 31, BANDS * MINIMA, np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _RANDOM.integers(0, 1 << 32, BANDS * MINIMA, np.uint32)


def _pieces(raw: bytes) -> Iterator[bytes]:
    """``raw`` in parts that end between words."""
    at = 0
    while len(raw) - at > PIECE:
        cut_at = at + PIECE
        while cut_at < len(raw) and raw[cut_at] not in b" \t\n\x0b\x0c\r":
            cut_at += 1
        yield raw[at:cut_at]
        at = cut_at
    yield raw[at:]


def shingle_hashes(raw: bytes, width: int = 3, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of the space-joined shingles of ``raw``, in bulks; of the whole where it has fewer words."""
    digest = xxhash.xxh64_intdigest
    carried: list[bytes] = []
    any_yet = False
    for piece in _pieces(raw):
        words = carried + piece.split()
        if len(words) >= width:
            any_yet = True
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            begins = np.r_[0, ends[:-1] + 1]
            spans = zip(begins[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
            yield np.array([digest(line[s:e], seed) for s, e in spans], dtype=np.uint64)
            carried = words[-(width - 1) :] if width > 1 else []
        else:
            carried = words
    if not any_yet and carried:
        yield np.array([digest(b" ".join(carried), seed)], dtype=np.uint64)


def fingerprint_of(text: str | None, width: int = 3) -> int:
    """The fingerprint as an unsigned number; 0 without words."""
    sums, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes((text or "").encode("utf-8", "replace").lower(), width):
        starts = np.arange(0, len(hashes), LANE_HASHES)
        sums += lane_sums(hashes, starts).sum(axis=0)
        n += len(hashes)
    return int(pack_majority(sums[None, :], np.array([n]))[0]) if n else 0


def fingerprint(text: Column, width: int = 3) -> Column:
    """Long column with the fingerprint's 64 bits (signed); null and empty texts have 0."""

    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t, width) for t in texts], dtype=np.uint64).view(np.int64))

    return series_udf(fingerprints, "long")(text)


def _links(frame: pd.DataFrame) -> pd.DataFrame:
    """For each code of a frame of units that is linked, one edge towards its group's smallest index."""
    frame = frame.sort_values(["unit", "code"], kind="stable")
    codes = frame["code"].to_numpy().view(np.uint64)
    order = np.lexsort((codes, frame["unit"].to_numpy()))
    unit, codes = frame["unit"].to_numpy()[order], codes[order]
    groups = Groups(len(codes))
    for a, b in trie_pairs(unit, codes):
        groups.union(a, b)
    root = groups.root()
    linked = np.flatnonzero(root != np.arange(len(root)))
    signed = codes.view(np.int64)
    return pd.DataFrame({"src": signed[linked], "dst": signed[root[linked]]}).drop_duplicates()


def fingerprint_components(rows: DataFrame) -> DataFrame:
    """(code, component_code, component_id) of each fingerprint in ``rows`` (doc_id, code).

    Fingerprints link at 3 or fewer differing bits. Equal ones are grouped first, so a group of copies
    is one code. Codes are dealt to bounded units in which all neighbours meet; a unit's trie is
    joined with itself, and only a spanning forest of its links leaves it. component_code is the
    smallest code reachable (signed), component_id the smallest doc_id of the component's rows, null
    where all are null.
    """
    ship(rows.sparkSession)
    codes = cut(rows.groupBy("code").agg(F.min("doc_id").alias("least_id")))
    edges = by_unit(hamming_units(codes.select("code")), _links, "src long, dst long")
    groups = connected_components(edges)
    named = codes.join(groups, codes["code"] == groups["node"], "left").select(
        "code", F.coalesce("component", "code").alias("component_code"), "least_id"
    )
    least = named.groupBy("component_code").agg(F.min("least_id").alias("component_id"))
    return cut(named.drop("least_id").join(least, "component_code").select("code", "component_code", "component_id"))


def near_duplicate_groups(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of ``docs``.

    Null and empty texts have fingerprint 0 and are linked like any others; repeated rows have equal
    values; rows with a null doc_id take part but name no component unless all of its ids are null.
    Other columns of ``docs`` play no part. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    rows = cut(docs.select("doc_id", fingerprint(F.col("text"), width).alias("code")))
    return rows.join(fingerprint_components(rows), "code").select(
        "doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (null last; of the smallest row hash, if tied).

    Repeated rows of that document are one. A component whose ids are all null keeps one row.
    """
    ship(docs.sparkSession)
    rows = cut(docs.select(row_hash().alias("row_hash"), "doc_id", fingerprint(F.col("text"), width).alias("code")))
    return _one_each(docs, rows.join(fingerprint_components(rows), "code"))


def _one_each(docs: DataFrame, named: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component_code of ``named`` (row_hash, doc_id, component_code).

    Which rows go is decided without texts; then only rows that may go, or may repeat the one that
    stays, are shuffled.
    """
    named = cut(named.select("row_hash", "component_code", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash").alias("place")))
    firsts = named.groupBy("component_code").agg(F.min("place")["row_hash"].alias("keep_hash"))
    hashes = named.join(firsts, "component_code").groupBy("row_hash").agg(
        F.max(F.col("row_hash") == F.col("keep_hash")).alias("stays"), F.count("*").alias("n")
    )
    odd = cut(hashes.filter("NOT stays OR n > 1").select(F.col("row_hash").alias("odd_hash"), "stays"))
    whole = docs.select(F.struct(*docs.columns).alias("near_doc"), row_hash().alias("near_hash"))
    whole = marked(whole, F.col("near_hash"), odd, F.col("odd_hash"), "near_may")
    alone = whole.filter(~F.col("near_may")).select("near_doc")
    met = whole.filter("near_may").join(odd, F.col("near_hash") == F.col("odd_hash"), "left")
    rest = met.filter("odd_hash IS NULL").select("near_doc").unionByName(met.filter("stays").dropDuplicates(["near_hash"]).select("near_doc"))
    return alone.unionByName(rest).select("near_doc.*")


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True


def _mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    hashes = (hashes ^ (hashes >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return hashes ^ (hashes >> np.uint64(31))


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased bytes, and where each begins."""
    space = _IS_SPACE[raw]
    begins = np.flatnonzero(~space & np.r_[True, space[:-1]])
    if not len(begins):
        return np.zeros(0, np.uint64), begins
    sizes = np.flatnonzero(~space & np.r_[space[1:], True]) + 1 - begins
    power = np.ones(int(sizes.max()) + 1, np.uint64)
    power[1:] = np.uint64(0x100000001B3)
    power = np.cumprod(power, dtype=np.uint64)
    firsts = np.cumsum(sizes) - sizes
    offset = np.arange(int(sizes.sum())) - np.repeat(firsts, sizes)
    return _mixed(np.add.reduceat((raw[~space].astype(np.uint64) + np.uint64(1)) * power[offset], firsts)), begins


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The different hashes of each text's shingles, sorted; of the whole text where it has fewer words; none without words."""
    at = 0
    while at < len(texts):
        raws, size = [], 0
        while at < len(texts) and (not raws or size < PIECE):
            raws.append((texts[at] or "").encode("utf-8", "replace"))
            size += len(raws[-1]) + 1
            at += 1
        words, begins = _words(_FOLD[np.frombuffer(b" ".join(raws), np.uint8)])
        edges = np.cumsum([0] + [len(x) + 1 for x in raws])
        counts = np.diff(np.searchsorted(begins, edges))
        firsts = np.cumsum(counts) - counts
        few = np.minimum(counts, width)
        made = counts - few + (counts > 0)  # shingles of each text
        owner = np.repeat(np.arange(len(raws)), made)
        where = np.repeat(firsts, made) + np.arange(len(owner)) - np.repeat(np.cumsum(made) - made, made)
        hashes, long = np.zeros(len(owner), np.uint64), few[owner]
        for k in range(width):
            inside = k < long
            hashes[inside] = _mixed(hashes[inside] * np.uint64(0x9E3779B97F4A7C15) + words[where[inside] + k])
        for part in np.split(hashes, np.cumsum(made)[:-1]):
            part = np.sort(part)
            yield part[np.r_[True, part[1:] != part[:-1]][: len(part)]]


def set_code(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).view(np.int64))


def set_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """SimHash of each set of hashes, unsigned; 0 of an empty one."""
    out, counts = np.zeros(len(sets), np.uint64), np.fromiter(map(len, sets), np.int64, len(sets))
    some = np.flatnonzero(counts)
    if len(some):
        counts = counts[some]
        # Lanes hold so many hashes; a larger set is summed in parts.
        parts = -(-counts // LANE_HASHES)
        owner, firsts = np.repeat(np.arange(len(some)), parts), np.cumsum(parts) - parts
        starts = (np.cumsum(counts) - counts)[owner] + LANE_HASHES * (np.arange(len(owner)) - firsts[owner])
        sums = np.add.reduceat(lane_sums(np.concatenate([sets[k] for k in some.tolist()]), starts), firsts, axis=0)
        out[some] = pack_majority(sums, counts)
    return out


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band; two sets share one with a chance of their similarity to the power of MINIMA."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    small = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.array([(small * t + p).min() for t, p in zip(_TIMES, _PLUS, strict=True)], np.uint64)
    rows, keys = least.reshape(BANDS, MINIMA), np.arange(BANDS, dtype=np.uint64)
    for k in range(MINIMA):
        keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return keys.view(np.int64)


def similar_components(docs: DataFrame, rows: DataFrame, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """(code, component_code), as ``fingerprint_components``, of sets linked at a Jaccard similarity of ``least``.

    ``rows`` has row_hash, code, sim (the SimHash) and bands of each of ``docs``. Equal sets are one from
    the start. Sets that share a band are in a unit; of each unit, tries of SimHashes are joined within
    BUDGET bits, and what meets there is compared, exactly.
    """
    sets = cut(rows.groupBy("code").agg(F.min("row_hash").alias("some_hash"), F.first("sim").alias("sim"), F.first("bands").alias("bands")))
    keys = sets.select(F.explode("bands").alias("unit"), "code", "sim")
    shared = keys.groupBy("unit").agg(F.count("*").alias("n"), F.min("code").alias("lead")).filter("n > 1")
    met = cut(keys.join(shared.select("unit", "lead"), "unit"))
    wanted = cut(met.select("code").distinct().join(sets.select("code", "some_hash"), "code").select("some_hash"))
    reclaim(docs.sparkSession)

    def shingles(texts: pd.Series) -> pd.DataFrame:
        found = list(shingle_sets(texts.tolist(), width))
        return pd.DataFrame({"code": [set_code(x) for x in found], "shingles": [x.view(np.int64) for x in found]})

    few = marked(docs.select("text", row_hash().alias("row_hash")), F.col("row_hash"), wanted, F.col("some_hash"), "may").filter("may")
    made = few.select(frame_udf(shingles, "code long, shingles array<long>")(F.col("text")).alias("s")).select("s.code", "s.shingles")
    arrays = made.join(met.select("code", "sim").distinct(), "code").dropDuplicates(["code"])
    arrays = cut(arrays.select("code", "sim", "shingles"))

    def alike(pairs: DataFrame) -> DataFrame:
        both = pairs.join(arrays.toDF("b", "t", "y"), "b").join(arrays.toDF("a", "s", "x"), "a")
        both = both.filter(F.bit_count(F.col("s").bitwiseXOR(F.col("t"))) <= BUDGET)
        both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("n"))
        return cut(both.filter(F.col("i") / (F.col("n") - F.col("i")) >= least).select("a", "b"))

    links = linked_in_units(met, alike, BUDGET)
    groups = connected_components(links, "a", "b")
    return cut(sets.join(groups, sets["code"] == groups["node"], "left").select("code", F.coalesce("component", "code").alias("component_code")))


def drop_similar(docs: DataFrame, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """``docs`` with one row of each group of texts linked at a Jaccard similarity of ``least`` of their ``width``-word shingles.

    Which row stays is as in ``drop_near_duplicates``. Texts of fewer words are one shingle; null and
    blank texts are equal. Candidates are those whose SimHashes, of the shingles, are within BUDGET bits
    by a join of tries. At a similarity of 0.8 fingerprints differ in some 10 bits of 64 and often in
    16, for which blocks of equal bits are too short, so bands of MinHash deal out the tries' units.
    """
    ship(docs.sparkSession)

    def keyed(texts: pd.Series) -> pd.DataFrame:
        sets = list(shingle_sets(texts.tolist(), width))
        sims = set_fingerprints(sets).view(np.int64)
        return pd.DataFrame({"code": [set_code(x) for x in sets], "sim": sims, "bands": [band_keys(x) for x in sets]})

    rows = docs.select(row_hash().alias("row_hash"), "doc_id", frame_udf(keyed, "code long, sim long, bands array<long>")(F.col("text")).alias("k"))
    rows = cut(rows.select("row_hash", "doc_id", "k.code", "k.sim", "k.bands"))
    named = rows.select("row_hash", "doc_id", "code").join(similar_components(docs, rows, width, least), "code")
    return _one_each(docs, named)

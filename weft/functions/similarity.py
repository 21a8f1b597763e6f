"""Vectors, MinHash signatures and string similarity."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

#: Fixed values of the signatures.
PERMUTATIONS, BANDS, SEED = 128, 16, 1
MERSENNE = (1 << 61) - 1
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
M64 = (1 << 64) - 1


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; 0 for vectors of different lengths, empty ones, and ones of norm 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    scale = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (scale > 0), dot / scale).otherwise(F.lit(0.0))


def fnv1a(raw: bytes) -> int:
    value = FNV_START
    for byte in raw:
        value = (value ^ byte) * FNV_PRIME & M64
    return value


def _splitmix(n: int, state: int = SEED) -> list[int]:
    out = []
    for _ in range(n):
        state = state + 0x9E3779B97F4A7C15 & M64
        z = (state ^ state >> 30) * 0xBF58476D1CE4E5B9 & M64
        z = (z ^ z >> 27) * 0x94D049BB133111EB & M64
        out.append(z ^ z >> 31)
    return out


def _parameters() -> tuple[np.ndarray, np.ndarray]:
    drawn = _splitmix(2 * PERMUTATIONS)
    a = np.array([x % (MERSENNE - 1) + 1 for x in drawn[::2]], np.uint64)
    return a, np.array([x % MERSENNE for x in drawn[1::2]], np.uint64)


A, B = _parameters()


@lru_cache(maxsize=1 << 16)
def _trigram_hash(trigram: str) -> int:
    return fnv1a(trigram.encode())


def shingles(label: str) -> np.ndarray:
    """Hashes of the character trigrams without white space; a shorter label is padded on the left."""
    text = "".join(label.split()).rjust(3, "^")
    return np.array([_trigram_hash(text[i : i + 3]) for i in range(len(text) - 2)], np.uint64)


def signature(label: str) -> np.ndarray:
    h = shingles(label)
    return ((A[:, None] * h[None, :] + B[:, None]) % np.uint64(MERSENNE) | np.uint64(1)).min(axis=1)


@F.pandas_udf(ArrayType(LongType()))
def band_keys(labels: pd.Series) -> pd.Series:
    """The 16 band keys of each label's MinHash signature, as signed longs."""
    known = [k for k, s in enumerate(labels) if s is not None]
    out: list[np.ndarray | None] = [None] * len(labels)
    if known:
        sigs = np.array([signature(labels.iloc[k]) for k in known], "<u8")
        octets = sigs.view(np.uint8).reshape(len(known) * BANDS, -1)
        # FNV-1a of all bands in step.
        value = np.full(len(octets), FNV_START, np.uint64)
        for column in octets.T:
            value = (value ^ column) * np.uint64(FNV_PRIME)
        for k, keys in zip(known, value.view(np.int64).reshape(-1, BANDS), strict=True):
            out[k] = keys
    return pd.Series(out, dtype=object)


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro similarity with a bonus for a common prefix of up to four characters, from 0.7 on."""
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, hit = [False] * len(b), [False] * len(a)
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                hit[i] = taken[j] = True
                break
    m = sum(hit)
    if not m:
        return 0.0
    x, y = [c for c, h in zip(a, hit) if h], [c for c, t in zip(b, taken) if t]
    swaps = sum(p != q for p, q in zip(x, y)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler_of(x, y) for x, y in zip(a, b)], dtype="float64")


def similar_pairs(vectors: DataFrame, threshold: float = 0.75, k: int = 5, block: int = 2048) -> DataFrame:
    """(source, target, score): for each vector its ``k`` most similar later ones, by id, with cosine >= threshold.

    Exact: vectors are dealt to blocks by hash, and each pair of blocks is one task of matrix products.
    Memory is that of two blocks; a block is sent to as many tasks as there are blocks. A task keeps k
    partners a vector, so what is shuffled grows with vectors times blocks, not with pairs.
    """
    n = vectors.count()
    blocks = max(1, -(-n // block))
    dealt = vectors.select("id", F.col("embedding").cast("array<float>").alias("v")).withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks).cast("long")).cast("int"))
    each = F.sequence(F.lit(0), F.lit(blocks - 1))
    pairs = dealt.withColumn("other", F.explode(each)).select("id", "v", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def products(key, frame: pd.DataFrame) -> pd.DataFrame:
        lo, hi = key
        frame = frame.sort_values("id", kind="stable")
        size = frame["v"].map(len).max() if len(frame) else 0
        m = np.array([np.asarray(v, np.float64) if len(v) == size else np.zeros(size) for v in frame["v"]])
        norm = np.linalg.norm(m, axis=1)
        m = np.divide(m, norm[:, None], out=np.zeros_like(m), where=norm[:, None] > 0)
        ids, own = frame["id"].to_numpy(), frame["own"].to_numpy()
        out = []
        for at in range(0, len(ids), 512):
            scores = m[at : at + 512] @ m.T
            rows = np.arange(at, at + len(scores))
            ok = (np.arange(len(ids))[None, :] > rows[:, None]) & (scores >= threshold)
            if lo != hi:
                ok &= own[rows][:, None] != own[None, :]
            for r in np.flatnonzero(ok.any(axis=1)):
                c = np.flatnonzero(ok[r])
                best = c[np.lexsort((ids[c], -np.round(scores[r, c], 9)))][:k]
                out += [(ids[at + r], ids[j], float(scores[r, j])) for j in best]
        return pd.DataFrame(out, columns=["source", "target", "score"])

    kind = dict(vectors.dtypes)["id"]
    found = pairs.groupBy("lo", "hi").applyInPandas(products, f"source {kind}, target {kind}, score double")
    nth = F.row_number().over(Window.partitionBy("source").orderBy(F.desc(F.round("score", 9)), "target"))
    return found.withColumn("nth", nth).filter(F.col("nth") <= k).select("source", "target", "score")


def plain_label(label: str) -> str:
    """Lower case and NFKC, with single spaces where other than letters and digits stood."""
    folded = unicodedata.normalize("NFKC", label.lower())
    return re.sub(r"[\W_]+", " ", folded).strip()

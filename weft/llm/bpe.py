"""Byte-level BPE by a rank queue under a hierarchical bitmap, one queue for all new pre-tokens of a bulk."""

from __future__ import annotations

import base64
import hashlib
import itertools
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from weft.llm.common import frame_udf, series_udf
from weft.plans.runtime import ship

#: Fixed value: the pattern of whose matches it is known that one begins at each space before a non-space.
SPACED_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words and pre-tokens are remembered up to so many bytes of them and their ids, those of up to SHORT characters.
SHORT, REMEMBERED_BYTES = 64, 32_000_000
#: What an entry of a dictionary takes besides its characters and ids.
ENTRY_BYTES = 170
#: Characters of text that are encoded together.
BULK = 1 << 21
#: Bytes of a pre-token up to which it is merged in step with others, and above which by itself.
LONG = 48
#: Ids that are decoded at once.
IDS = 1 << 18
_NO_RANK = 1 << 30


class RankQueue:
    """A queue that gives the smallest rank first, and of a rank the leftmost position.

    A bucket per merge rank holds positions, as a heap. A bitmap of two levels says which ranks have a
    bucket: words of about the root of the number of ranks, and one word that says which of them
    aren't zero; the first set bit is found in each.
    """

    __slots__ = ("buckets", "low", "mask", "shift", "top")

    def __init__(self, n_ranks: int):
        self.shift = -(-max(n_ranks - 1, 1).bit_length() // 2)
        self.mask = (1 << self.shift) - 1
        self.low = [0] * ((n_ranks >> self.shift) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def put(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        at = rank >> self.shift
        self.low[at] |= 1 << (rank & self.mask)
        self.top |= 1 << at

    def take(self) -> tuple[int, int]:
        at = (self.top & -self.top).bit_length() - 1
        word = self.low[at]
        rank = at << self.shift | (word & -word).bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        del self.buckets[rank]
        word &= word - 1
        self.low[at] = word
        if not word:
            self.top &= self.top - 1
        return rank, bucket[0]


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.n_ranks = max(self.tokens) + 1
        self.shift = RankQueue(self.n_ranks).shift
        self.pattern = regex.compile(pattern)
        self.spaced = pattern == SPACED_PATTERN
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.word_bytes = self.piece_bytes = 0
        self._pairs()

    def _pairs(self) -> None:
        """``pair``: rank of two tokens' concatenation, by left * n_ranks + right; also as sorted arrays."""
        pair, rank_of, n = {}, self.ranks.get, self.n_ranks
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                left = rank_of(token[:k])
                if left is not None:
                    right = rank_of(token[k:])
                    if right is not None:
                        pair[left * n + right] = rank
        self.pair = pair
        keys = np.fromiter(pair, np.int64, len(pair))
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.int64(1) << np.int64(62))
        self.pair_ranks = np.append(np.fromiter(pair.values(), np.int32, len(pair))[order], np.int32(_NO_RANK))
        # Bytes that are no token can't be encoded; they keep a number past the ranks and raise when ids are read.
        self.byte_ids = np.array([rank_of(bytes([b]), n) for b in range(256)], np.int32)

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.n_ranks + right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NO_RANK)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, packed as little-endian 32-bit numbers."""
        out: list[bytes] = [b""] * len(pieces)
        short = [k for k, x in enumerate(pieces) if len(x) <= LONG]
        if short:
            ids, counts = self._merge_together([pieces[k] for k in short])
            raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
            for k, a, b in zip(short, [0, *ends], ends):
                out[k] = raw[a:b]
        for k, x in enumerate(pieces):
            if len(x) > LONG:
                out[k] = self._merge_one(x).astype("<u4").tobytes()
        return out

    def _checked(self, ids: np.ndarray) -> np.ndarray:
        if len(ids) and int(ids.max()) >= self.n_ranks:
            raise ValueError("a byte of the text is no token of the rank file")
        return ids

    def _merge_one(self, piece: bytes) -> np.ndarray:
        """The ids of one long pre-token.

        The bytes are the nodes of a linked list. ``now`` has the rank of the pair that begins at a
        node; entries of the queue whose pair has changed since are skipped.
        """
        n = len(piece)
        token = array("i", self.byte_ids[np.frombuffer(piece, np.uint8)].tobytes()) + array("i", [-1])
        now = array("i", self._rank_of(np.array(token[:-2]), np.array(token[1:-1])).astype(np.int32).tobytes()) + array("i", [_NO_RANK] * 2)
        after, before = array("i", range(1, n + 2)), array("i", range(-1, n))
        queue = RankQueue(self.n_ranks)
        buckets, put, pair_of, n_ranks = queue.buckets, queue.put, self.pair.get, self.n_ranks
        for i, rank in enumerate(now):
            if rank != _NO_RANK:
                put(rank, i)
        while queue.top:
            rank, i = queue.take()
            if now[i] != rank:
                continue
            j = after[i]
            k = after[j]
            now[j] = now[i] = _NO_RANK
            after[i] = k
            token[i] = rank
            token[j] = -2
            if k < n:
                before[k] = i
                new = pair_of(rank * n_ranks + token[k])
                if new is not None:
                    now[i] = new
                    put(new, i)
            left = before[i]
            if left >= 0:
                new = pair_of(token[left] * n_ranks + rank)
                if new is None:
                    now[left] = _NO_RANK
                elif now[left] != new:
                    now[left] = new
                    put(new, left)
        ids = np.array(token[:-1])
        return self._checked(ids[ids >= 0])

    def _merge_together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of short pre-tokens, and their number for each.

        As ``_merge_one``, in step: one linked list holds the bytes of all, and no pair reaches from one
        pre-token into the next. A bucket is opened for the ranks of a word of the bitmap at once, found
        by its first set bit. Pre-tokens don't touch each other, so each merges its own smallest rank
        (the leftmost, if tied) of the open bucket, all by arrays, until the bucket has none left; what
        new pairs have a smaller bucket close the open one first.
        """
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        if not len(raw):
            return np.zeros(0, np.int32), sizes
        # After each pre-token there is a node without a token.
        starts = np.cumsum(sizes + 1) - sizes - 1
        total = len(raw) + len(pieces)
        inside = np.ones(total, bool)
        inside[starts + sizes] = False
        token = np.full(total, -1, np.int32)
        token[inside] = self.byte_ids[raw]
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes + 1)
        after = np.arange(1, total + 1, dtype=np.int32)
        before = np.arange(-1, total - 1, dtype=np.int32)
        before[starts] = total - 1
        now = np.full(total, _NO_RANK, np.int32)
        both = np.flatnonzero(inside[:-1] & inside[1:])
        now[both] = self._rank_of(token[both], token[both + 1])
        shift, buckets, top = self.shift, {}, 0

        def put(at: np.ndarray) -> int:
            """Deal nodes whose pair has a rank to their buckets; the bitmap of these."""
            groups = now[at] >> shift
            order = np.argsort(groups, kind="stable")
            at, groups, bits = at[order], groups[order], 0
            edges = np.flatnonzero(groups[1:] != groups[:-1]) + 1
            for group, part in zip(groups[np.r_[0, edges]].tolist() if len(at) else (), np.split(at, edges)):
                buckets.setdefault(group, []).append(part)
                bits |= 1 << group
            return bits

        top |= put(both[now[both] < _NO_RANK])
        while top:
            group = (top & -top).bit_length() - 1
            top &= top - 1
            at = _in_order(buckets.pop(group))
            while True:
                at = at[now[at] >> shift == group]
                if not len(at):
                    break
                of = owner[at]
                runs = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                # The smallest rank, and the leftmost of it, of each pre-token.
                least = np.minimum.reduceat(now[at].astype(np.int64) << 32 | at, runs)
                i, rank = (least & 0xFFFFFFFF).astype(np.int32), (least >> 32).astype(np.int32)
                j = after[i]
                k = after[j]
                now[j] = now[i] = _NO_RANK
                after[i] = k
                token[i] = rank
                token[j] = -2
                go_on = token[k] >= 0
                before[k[go_on]] = i[go_on]
                left = before[i]
                left = left[token[left] >= 0]
                first = np.concatenate([i[go_on], left])
                new = self._rank_of(token[first], token[after[first]])
                now[first] = new
                first = first[new < _NO_RANK]
                groups = now[first] >> shift
                own = groups == group
                bits = put(first[~own])
                top |= bits
                at = _in_order([at, first[own]]) if own.any() else at
                if bits and bits & ((1 << group) - 1):
                    top |= put(at[now[at] >> shift == group])
                    break
        alive = token >= 0
        counts = np.add.reduceat(alive, starts, dtype=np.int64)
        return self._checked(token[alive]), counts

    def _learn_pieces(self, found: list[str]) -> dict[str, bytes]:
        """Packed ids of pre-tokens: remembered ones, or new ones, which are remembered."""
        known = self.pieces
        out = dict.fromkeys(found)
        new = [w for w in out if w not in known]
        hits = {w: known[w] for w in out if w in known}
        made = dict(zip(new, self.merge([w.encode("utf-8", "replace") for w in new]), strict=True))
        if self.piece_bytes > REMEMBERED_BYTES:
            self.pieces, self.piece_bytes = dict(hits), _weight(hits)
        short = {w: x for w, x in made.items() if len(w) <= SHORT}
        self.pieces.update(short)
        self.piece_bytes += _weight(short)
        return hits | made

    def _learn_words(self, new: list[str]) -> dict[str, bytes]:
        """Ids of words that follow a space: of all their pre-tokens, of which the first begins with the space."""
        found = self.pattern.findall(" " + " ".join(new))
        ids = self._learn_pieces(found)
        parts = [ids[x] for x in found]
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        sizes = np.fromiter(map(len, new), np.int64, len(new)) + 1
        begins = np.searchsorted(ends, np.cumsum(sizes) - sizes, side="right").tolist()
        return {w: parts[a] if b - a == 1 else b"".join(parts[a:b]) for w, a, b in zip(new, begins, [*begins[1:], len(parts)], strict=True)}

    def _bulks(self, texts: list[str]) -> Iterator[list[tuple[int, str]]]:
        """(index, part) of parts of texts, in bulks; parts end before a space, and begin with it."""
        bulk, size = [], 0
        for index, text in enumerate(texts):
            at = 0
            while at < len(text):
                end = len(text)
                if self.spaced and end - at > BULK and (cut := _SPACE.search(text, at + BULK)):
                    end = cut.start()
                bulk.append((index, text[at:end]))
                size += end - at
                at = end
                if size >= BULK:
                    yield bulk
                    bulk, size = [], 0
        if bulk:
            yield bulk

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        out: list[list[bytes]] = [[] for _ in texts]
        for bulk in self._bulks(texts):
            if not self.spaced:
                for index, part in bulk:
                    words = self.pattern.finditer(part)
                    while found := [m.group() for m in itertools.islice(words, 1 << 16)]:
                        ids = self._learn_pieces(found)
                        out[index].append(b"".join([ids[w] for w in found]))
                continue
            split, wanted = [], set()
            for _, part in bulk:
                # A space before a space, or before what counts as one somewhere, isn't where a pre-token begins.
                words = part.split(" ") if _ODD.search(part) is None else _SPACE.split(part)
                split.append(words)
                wanted.update(itertools.islice(words, 1, None))
            known = self.words
            new = [w for w in wanted if w not in known]
            made = self._learn_words(new) if new else {}
            if self.word_bytes > REMEMBERED_BYTES:
                # Words that have come again are likely to come again.
                known = {w: known[w] for w in wanted if w in known}
                self.words, self.word_bytes = known, _weight(known)
            long = {w: made.pop(w) for w in new if len(w) > SHORT}
            known.update(made)
            self.word_bytes += _weight(made)
            # What comes before the first space: a text's first word, or nothing.
            heads = [self.pattern.findall(words[0]) if words[0] else [] for words in split]
            ids = self._learn_pieces([x for head in heads for x in head])
            for (index, _), words, head in zip(bulk, split, heads, strict=True):
                out[index] += [ids[x] for x in head]
                rest = itertools.islice(words, 1, None)
                out[index].append(b"".join([known.get(w) or long[w] for w in rest] if long else map(known.__getitem__, rest)))
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def decoded(self, ids: bytes) -> Iterator[bytes]:
        """The bytes of packed ids, in parts."""
        view, tokens = memoryview(ids).cast("I"), self.tokens
        for at in range(0, len(view), IDS):
            yield b"".join([tokens[x] for x in view[at : at + IDS].tolist()])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(self.decoded(ids))

    def decoded_sha256(self, ids: bytes) -> str:
        digest = hashlib.sha256()
        for part in self.decoded(ids):
            digest.update(part)
        return digest.hexdigest()


def _in_order(parts: list[np.ndarray]) -> np.ndarray:
    """The different numbers of some arrays, sorted. (np.unique hashes, which takes several times as long.)"""
    every = np.sort(np.concatenate(parts))
    return every[np.r_[True, every[1:] != every[:-1]]]


def _weight(ids: dict[str, bytes]) -> int:
    """About the bytes that a dictionary of ids takes."""
    return ENTRY_BYTES * len(ids) + sum(map(len, ids)) + sum(map(len, ids.values()))


#: A space before a non-space, by either library's notion; and a space before anything that one of them takes for one.
_SPACE = regex.compile(r" (?=[^\s\x1c-\x1f\x85])")
_ODD = regex.compile(r" (?:[\s\x1c-\x1f\x85]|$)")


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _sent(spark, rank_file: str) -> str:
    ship(spark)
    spark.sparkContext.addFile(rank_file)
    return rank_file.replace("\\", "/").rsplit("/", 1)[-1]


def encode_texts(docs: DataFrame, rank_file: str, pattern: str, decode: str | None = "bytes") -> DataFrame:
    """``docs`` with binary ``token_ids`` (little-endian unsigned 32-bit) and what they are when decoded again.

    ``decode``: "bytes" adds binary ``decoded``, "sha256" adds ``decoded_sha256``, which spares sending
    the bytes, None adds nothing. Each match of ``pattern`` is encoded by itself and special tokens
    aren't known. Columns of the new names are replaced. A null text counts as empty and has no ids;
    repeated rows have equal ids; an empty table gives an empty result. A pre-token of n bytes takes
    O(n log n) time and O(n) memory. The rank file is sent to the executors by name, once.
    """
    name = _sent(docs.sparkSession, rank_file)
    kinds = {"bytes": ", decoded binary", "sha256": ", decoded_sha256 string", None: ""}

    def coded(texts: pd.Series) -> pd.DataFrame:
        own = codec(SparkFiles.get(name), pattern)
        ids = own.encode_all([t or "" for t in texts])
        found = {"token_ids": ids}
        if decode == "bytes":
            found["decoded"] = [own.decode(x) for x in ids]
        elif decode == "sha256":
            found["decoded_sha256"] = [own.decoded_sha256(x) for x in ids]
        return pd.DataFrame(found, dtype=object)

    # Else idle workers would hold tables and words, some 100 MB each, beside whatever stage comes next.
    coder = frame_udf(coded, f"token_ids binary{kinds[decode]}", codec.cache_clear)
    out = docs.drop("token_ids", "bpe_struct").withColumn("bpe_struct", coder(F.col("text"))).withColumn("token_ids", F.col("bpe_struct.token_ids"))
    if decode:
        added = {"bytes": "decoded", "sha256": "decoded_sha256"}[decode]
        out = out.withColumn(added, F.col(f"bpe_struct.{added}"))
    return out.drop("bpe_struct")


def decode_ids(df: DataFrame, rank_file: str, pattern: str, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """``df`` with binary ``into``: the bytes of the packed ids; null stays null."""
    name = _sent(df.sparkSession, rank_file)

    def decoded(values: pd.Series) -> pd.Series:
        own = codec(SparkFiles.get(name), pattern)
        return pd.Series([None if v is None else own.decode(bytes(v)) for v in values], dtype=object)

    return df.withColumn(into, series_udf(decoded, "binary", codec.cache_clear)(F.col(ids)))

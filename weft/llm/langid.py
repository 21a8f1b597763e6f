"""Language ID: scripts narrow the candidates, and Viterbi over the words labels spans."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from weft.llm.common import breathe, frame_udf
from weft.plans.runtime import ship

#: Training documents of each language, those of the smallest hash: the model is fitted on this sample.
PER_LANGUAGE = 600
#: Hashed character trigrams of the model.
CELLS = 1 << 16
#: Added to each cell of each language.
PRIOR = 0.5
#: Log-likelihood that a change of language between neighbouring words must gain.
SWITCH = 8.0
#: Least share of a language's training letters that makes a script one of its own.
SCRIPT_SHARE = 0.01
#: Characters that are scored at once.
PIECE = 1 << 18
#: Characters whose words are labelled side by side.
BATCH = 1 << 21
#: Marks what isn't a candidate.
NEVER = -1e6

#: First code points of ranges, and the script of each range (Unicode blocks, coarsely).
SCRIPT_STARTS = (
    0x0000, 0x0250, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0750, 0x0780, 0x08A0, 0x0900, 0x0980, 0x0A00, 0x0A80,
    0x0B00, 0x0B80, 0x0C00, 0x0C80, 0x0D00, 0x0D80, 0x0E00, 0x0E80, 0x0F00, 0x1000, 0x10A0, 0x1100, 0x1200, 0x13A0,
    0x1780, 0x1800, 0x18B0, 0x1D00, 0x1F00, 0x2000, 0x2C60, 0x2C80, 0x3040, 0x30A0, 0x3100, 0x3130, 0x3190, 0x3400,
    0xA000, 0xA720, 0xA800, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0xFB50, 0xFE00, 0xFE70, 0xFF00, 0xFF66, 0xFFA0, 0x10000,
    0x20000, 0x30000,
)
SCRIPT_NAMES = (
    "Latin", "Latin", "Greek", "Cyrillic", "Armenian", "Hebrew", "Arabic", "Arabic", "Thaana", "Arabic", "Devanagari",
    "Bengali", "Gurmukhi", "Gujarati", "Oriya", "Tamil", "Telugu", "Kannada", "Malayalam", "Sinhala", "Thai", "Lao",
    "Tibetan", "Myanmar", "Georgian", "Hangul", "Ethiopic", "Cherokee", "Khmer", "Mongolian", "Other", "Latin", "Greek",
    "Other", "Latin", "Other", "Kana", "Kana", "Other", "Hangul", "Other", "Han", "Other", "Latin", "Other", "Hangul",
    "Other", "Han", "Latin", "Arabic", "Other", "Arabic", "Latin", "Kana", "Hangul", "Other", "Han", "Other",
)
SCRIPTS = tuple(dict.fromkeys(SCRIPT_NAMES))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1)
def _script_table() -> tuple[np.ndarray, np.ndarray]:
    return np.array(SCRIPT_STARTS), np.array([SCRIPTS.index(s) for s in SCRIPT_NAMES])


class Words:
    """The words (runs of letters) of some texts, with the trigrams inside them hashed to cells."""

    def __init__(self, texts: list[str], cells: int = CELLS):
        # Lower-casing may change a text's length, so it comes before the texts are joined.
        lowered = [t.lower() for t in texts]
        codes = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[codes]
        before = np.r_[False, letter[:-1]]
        self.start = np.flatnonzero(letter & ~before)
        self.stop = np.flatnonzero(~letter & before)
        self.letters = self.stop - self.start
        bounds = np.cumsum([0] + [len(t) + 1 for t in lowered])
        self.first = np.searchsorted(self.start, bounds)  # words of text i: first[i] to first[i + 1]
        at = np.flatnonzero(letter)
        plain = np.where(letter, codes, 0).astype(np.uint64)
        key = plain[at - 1] if len(at) and at[0] > 0 else np.r_[np.uint64(0), plain[at[1:] - 1]] if len(at) else plain[:0]
        mixed = (key * np.uint64(0x9E3779B97F4A7C15)) ^ (plain[at] * np.uint64(0xC2B2AE3D27D4EB4F))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) ^ (plain[at + 1] * np.uint64(0x165667B19E3779F9))
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        self.cell = (mixed >> np.uint64(40)).astype(np.int64) % cells
        self.head = np.cumsum(self.letters) - self.letters  # each word's first letter among the letters
        starts, names = _script_table()
        self.script = names[np.searchsorted(starts, codes[self.start], side="right") - 1]


class Model:
    """Log-probabilities (cells, languages), the scripts of each language, and the commonest language."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray, docs: np.ndarray):
        self.languages = languages
        self.table = np.log((counts + PRIOR) / (counts + PRIOR).sum(axis=0)).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(axis=0), 1)
        self.allowed = share >= SCRIPT_SHARE
        self.common = int(np.argmax(docs))

    def scores(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(words, languages) log-likelihoods, and whether a word's script belongs to any language."""
        if not len(words.start):
            return np.zeros((0, len(self.languages)), np.float32), np.zeros(0, bool)
        total = np.add.reduceat(self.table[words.cell], words.head, axis=0)
        allowed = self.allowed[words.script]
        known = allowed.any(axis=1)
        total[known] = np.where(allowed[known], total[known], NEVER)
        total[~known] = 0
        return total, known


def viterbi(score: np.ndarray, first: np.ndarray, last: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word, for sequences ``first`` to ``last`` of ``score``, all side by side.

    Staying costs nothing and a change costs ``switch``. Ties go to staying, then to the first label.
    """
    n_labels = score.shape[1]
    label = np.zeros(len(score), np.int16)
    order = np.argsort(first - last, kind="stable")
    first, length = first[order], (last - first)[order]
    first, length = first[length > 0], length[length > 0]
    if not len(first):
        return label
    back = np.empty((len(score), n_labels), np.int16)
    own = np.arange(n_labels, dtype=np.int16)
    best = score[first].astype(np.float64)
    alive = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")  # sequences with a word t
    for t in range(1, int(length[0])):
        k = alive[t]
        top = best[:k].argmax(axis=1)
        jump = best[np.arange(k), top] - switch
        stay = best[:k] >= jump[:, None]
        at = first[:k] + t
        back[at] = np.where(stay, own, top[:, None].astype(np.int16))
        best[:k] = np.where(stay, best[:k], jump[:, None]) + score[at]
    now = best.argmax(axis=1).astype(np.int16)
    label[first + length - 1] = now
    for t in range(int(length[0]) - 1, 0, -1):
        k = alive[t]
        now[:k] = back[first[:k] + t, now[:k]]
        label[first[:k] + t - 1] = now[:k]
    return label


def _bulks(texts: list[str], most: int = 0) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` (else PIECE) characters together; a longer text is one range."""
    most = most or PIECE
    at = n = 0
    for i, text in enumerate(texts):
        if n and n + len(text) > most:
            yield at, i
            at, n = i, 0
        n += len(text)
    yield at, len(texts)


def identify(texts: list[str | None], model: Model, switch: float = SWITCH, spans: bool = False) -> list[tuple]:
    """(language, score, spans) of each text; see ``language_columns``."""
    plain = [t or "" for t in texts]
    scores, knowns, sizes, firsts, n = [], [], [], [np.zeros(1, np.int64)], 0
    for lo, hi in _bulks(plain):  # the characters' arrays are large, what is kept of the words is small
        words = Words(plain[lo:hi])
        score, known = model.scores(words)
        scores.append(score)
        knowns.append(known)
        sizes.append(words.letters)
        firsts.append(words.first[1:] + n)
        n += len(known)
    score, known, size, first = (np.concatenate(x) for x in (scores, knowns, sizes, firsts))
    label = viterbi(score, first[:-1], first[1:], switch)
    which = np.repeat(np.arange(len(texts)), np.diff(first))
    n_labels = len(model.languages)
    share = np.bincount(which * n_labels + label, size * known, len(texts) * n_labels).reshape(len(texts), n_labels)
    letters = np.bincount(which, size, len(texts))
    out = []
    for i, text in enumerate(texts):
        if text is None or not letters[i]:
            out.append(("und", 0.0, []))
            continue
        a, b = first[i], first[i + 1]
        best = int(share[i].argmax()) if share[i].any() else model.common
        marks = []
        if spans:
            edges = np.flatnonzero(np.r_[True, label[a + 1 : b] != label[a : b - 1], True])
            marks = [(int(s), int(e), model.languages[label[a + s]]) for s, e in zip(edges[:-1], edges[1:], strict=True)]
        out.append((model.languages[best], float(share[i][best] / letters[i]), marks))
    return out


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, cells: int = CELLS) -> Model | None:
    """A model of rows (doc_id, text, lang); None without labelled text.

    Fitted on ``per_language`` documents of each language, those whose id has the smallest hash. Which
    they are is found from ids and labels alone; their texts are counted on the executors, and the
    driver gets a sum per language and cell: at most ``cells`` numbers a language.
    """
    ship(labelled.sparkSession)
    hashed = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").withColumn("pick", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    ranked = hashed.select("lang", "pick").withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("pick")))
    edges = ranked.filter(F.col("nth") <= per_language).groupBy("lang").agg(F.max("pick").alias("edge")).collect()
    if not edges:
        return None
    languages = sorted(r["lang"] for r in edges)
    limit = hashed.sparkSession.createDataFrame([(r["lang"], r["edge"]) for r in edges], "sample_lang string, edge long")
    sample = hashed.join(F.broadcast(limit), (hashed["lang"] == limit["sample_lang"]) & (hashed["pick"] <= limit["edge"]))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, own in batch.groupby("lang"):
                texts = own["text"].tolist()
                for lo, hi in _bulks(texts):
                    words = Words(texts[lo:hi], cells)
                    tally = np.bincount(words.cell, minlength=cells)
                    used = np.flatnonzero(tally)
                    script = np.bincount(words.script, words.letters, len(SCRIPTS)).astype(np.int64)
                    seen = np.flatnonzero(script)
                    what = np.r_[used, -1 - seen, -1000]
                    yield pd.DataFrame({"lang": lang, "what": what, "n": np.r_[tally[used], script[seen], hi - lo]})
            breathe()

    sums = sample.select("lang", "text").mapInPandas(count, "lang string, what long, n long")
    got = sums.groupBy("lang", "what").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((cells, len(languages)))
    scripts, docs = np.zeros((len(SCRIPTS), len(languages))), np.zeros(len(languages))
    column = got["lang"].map(languages.index).to_numpy()
    what, n = got["what"].to_numpy(), got["n"].to_numpy()
    cell, script, size = what >= 0, (what < 0) & (what > -1000), what == -1000
    counts[what[cell], column[cell]] = n[cell]
    scripts[-1 - what[script], column[script]] = n[script]
    docs[column[size]] = n[size]
    return Model(languages, counts, scripts, docs)


def language_columns(docs: DataFrame, model: Model | None, switch: float = SWITCH, spans: bool = False) -> DataFrame:
    """``docs`` with lang_pred, lang_score and, if asked, lang_spans; columns of these names are replaced.

    Each word (a run of letters) is scored by its character trigrams under the languages that use its
    script; Viterbi over the whole text's words, with a penalty for each change, labels them.
    lang_pred has most letters, lang_score its share of all letters, and lang_spans are
    structs of first word, end word and language. A null text, or one without letters, is "und" with
    score 0, as is every text without a model. Words in a script of no language count for none; a text
    of such words only has the commonest language with score 0. Repeated rows are labelled alike.
    Memory grows with the longest text of a batch. The model (256 KB a language) is broadcast.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("lang_pred", "lang_score", "lang_spans", "lang_struct")
    sent = spark.sparkContext.broadcast(model)

    def labelled(texts: pd.Series) -> pd.DataFrame:
        if sent.value is None:
            found = [("und", 0.0, []) for _ in texts]
        else:
            every = texts.tolist()
            found = [x for lo, hi in _bulks([t or "" for t in every], BATCH) for x in identify(every[lo:hi], sent.value, switch, spans)]
        rows = [(a, b, [{"first": s, "end": e, "lang": x} for s, e, x in c]) for a, b, c in found]
        return pd.DataFrame(rows, columns=["lang_pred", "lang_score", "lang_spans"])

    # Else a filter on the result would be pushed below it, and texts labelled twice.
    once = frame_udf(labelled, "lang_pred string, lang_score double, lang_spans array<struct<first:int,end:int,lang:string>>").asNondeterministic()
    out = docs.withColumn("lang_struct", once(F.col("text")))
    names = ["lang_pred", "lang_score"] + ["lang_spans"] * spans
    return out.select(*[F.col(c) for c in docs.columns], *[F.col(f"lang_struct.{n}").alias(n) for n in names])


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: the id's CRC-32, modulo 3, isn't 1. A null id counts as empty text."""
    return docs.filter(~held_out()).select("doc_id", "text", "lang")


def held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3).cast("long")) == 1

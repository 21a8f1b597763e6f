"""Names, labels and prose as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

MAX_LABEL, MAX_DOCSTRING = 256, 4096
#: Words that carry no signal in a question.
STOPWORDS = (
    "a an the and or but if then than that this these those there here of in on at by for with from into about as "
    "is are was were be been being am do does did doing have has had having will would shall should can could may "
    "might must to too it its itself they them their we us our you your i me my he she his her him what which who "
    "whom whose when where why how not no also just very some any each other more most"
).split()
#: Shapes of credentials, each replaced as a whole.
CREDENTIALS = (
    r"(?s)-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----.*?(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----|$)",
    r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b",
    r"(?:\b|_)(?:sk-[A-Za-z0-9_-]{12,}|(?:ghp_|gho_|ghu_|ghs_|ghr_|github_pat_)[A-Za-z0-9_]{12,}|glpat-[A-Za-z0-9_-]{12,}"
    r"|xox[baprse]-[A-Za-z0-9-]{12,}|AIza[A-Za-z0-9_-]{20,}|(?:AKIA|ASIA)[A-Z0-9]{16}|(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{12,}"
    r"|npm_[A-Za-z0-9]{12,}|hf_[A-Za-z0-9]{16,}|pypi-[A-Za-z0-9_-]{16,}|lin_api_[A-Za-z0-9]{16,}|dop_v1_[A-Za-z0-9]{16,})\b",
)
#: What may follow "Bearer" in prose.
BEARER_WORDS = ("authentication", "authorization", "credentials", "credential", "scheme", "token", "tokens")


def redact(text: Column) -> Column:
    """Recognisable credentials replaced; a scheme's name in prose and ordinary hashes stay."""
    for pattern in CREDENTIALS:
        text = F.regexp_replace(text, pattern, "[REDACTED]")
    prose = "|".join(BEARER_WORDS)
    text = F.regexp_replace(
        text,
        rf"""(?i)\bBearer[ \t]+(?!["']?(?:{prose})["']?(?:[\s"'`<>,;]|$))["']?([^\s"'`<>,;]+)["']?""",
        "Bearer [REDACTED]",
    )
    text = F.regexp_replace(text, r"""(?i)([a-z][a-z0-9+.-]*://[^\s/@:"']+:)[^\s/@"']+(@)""", "$1[REDACTED]$2")
    return F.regexp_replace(text, r"""(?i)([a-z][a-z0-9+.-]*://:)[^\s/@"']+(@)""", "$1[REDACTED]$2")


def _clean(text: Column, most: int) -> Column:
    return F.left(F.regexp_replace(redact(text), r"[\p{Cc}&&[^\n\t]]", ""), F.lit(most))


def sanitize_label(text: Column) -> Column:
    return _clean(text, MAX_LABEL)


def sanitize_docstring(text: Column) -> Column:
    return _clean(text, MAX_DOCSTRING)


def _fixpoint(name: str) -> str:
    for _ in range(6):
        folded = unicodedata.normalize("NFKC", name.lower())
        if folded == name:
            break
        name = folded
    return name


@F.pandas_udf(StringType())
def normalize_id(names: pd.Series) -> pd.Series:
    """Lower-cased and NFKC-composed until stable; other than word characters become single underscores."""
    return names.map(lambda s: None if s is None else re.sub(r"[\W_]+", "_", _fixpoint(s)).strip("_"))


@F.pandas_udf(StringType())
def normalize_symbol_id(names: pd.Series) -> pd.Series:
    """As ``normalize_id``, but underscores, dollar signs and hashes of identifiers stay."""
    return names.map(lambda s: None if s is None else re.sub(r"[^\w$#]+", "_", _fixpoint(s)))


def make_id(*parts: Column) -> Column:
    return F.concat_ws("::", *parts)


def tokens(text: Column) -> Column:
    """Lower-case words, split at other than letters and digits and where a capital follows another character.

    Runs of ideographs, kana or hangul, which no dictionary is at hand for, become pairs of characters.
    """
    cjk = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}]"
    split = F.lower(F.regexp_replace(text, r"(?<=[\p{L}\p{N}&&[^\p{Lu}]])(?=\p{Lu})", " "))
    words = F.filter(F.split(split, r"[^\p{L}\p{N}\p{M}]+"), lambda w: w != "")

    def pairs(word: Column) -> Column:
        n = F.length(word)
        two = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(word, i, F.lit(2)))
        return F.when(word.rlike(cjk) & (n > 2), two).otherwise(F.array(word))

    return F.when(text.rlike(cjk), F.flatten(F.transform(words, pairs))).otherwise(words)


def stem(token: Column) -> Column:
    """English plurals cut: "ies" of over four bytes, a single "s" of over three."""
    n = F.octet_length(token)
    return (
        F.when((n > 4) & token.endswith("ies"), F.substring(token, F.lit(1), F.length(token) - 3))
        .when((n > 3) & token.endswith("s") & ~token.endswith("ss"), F.substring(token, F.lit(1), F.length(token) - 1))
        .otherwise(token)
    )


def salient(words: Column) -> Column:
    """Words of three or more bytes that aren't stopwords."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(words, lambda w: (F.octet_length(w) > 2) & ~F.array_contains(stop, w))


def coverage(needle: Column, words: Column) -> Column:
    """Share of the needle's parts that are among the words, as they are or by their stems."""
    both = F.array_union(words, F.transform(words, stem))
    hits = F.filter(needle, lambda w: F.array_contains(both, w) | F.array_contains(both, stem(w)))
    return F.when(F.size(needle) > 0, F.size(hits) / F.size(needle)).otherwise(F.lit(0.0))


def normalize_question(text: Column) -> Column:
    return F.left(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), F.lit(200))


def snake_case(name: Column) -> Column:
    """camelCase to snake_case; of a run of capitals the last begins the next word."""
    name = F.regexp_replace(name, r"([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.lower(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2"))


def token_estimate(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character; an empty text has 0."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    parts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(n > 0, -F.aggregate(parts, F.lit(0.0), lambda a, p: a + p * F.log2(p))).otherwise(F.lit(0.0))


def dedup_label(label: Column) -> Column:
    """Lower case, with single spaces where other than letters and digits stood."""
    return F.trim(F.regexp_replace(F.lower(label), r"[^\p{L}\p{N}]+", " "))


def digit_runs(text: Column) -> Column:
    return F.sort_array(F.regexp_extract_all(text, F.lit(r"([0-9]+)"), F.lit(1)))


def label_shape(label: Column) -> Column:
    """"symbol" for calls, "file" for names with an extension of at most five characters, else "free"."""
    return F.when(label.endswith("()"), "symbol").when(label.rlike(r"^.+\.[A-Za-z0-9]{1,5}$"), "file").otherwise("free")


def is_test_path(path: Column) -> Column:
    """Paths of tests, specs, examples, fixtures and benchmarks, by the markers of common layouts."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return p.rlike(
        r"/(test|spec|example|fixture|benchmark)|(test|spec|example|fixture|benchmark)s/"
        r"|[_.](test|spec|example|fixture|benchmark)\.|__(test|spec|example|fixture|benchmark)s__/"
    )


#: Names of symbols that are called from outside.
ENTRY_LABELS = ("main", "index", "run", "mod", "__init__", "app", "server", "cli", "bin", "lib", "new", "setup", "handler", "serve", "start", "install", "init", "plugin", "middleware", "route")


def is_entry_label(label: Column) -> Column:
    bare = F.lower(F.regexp_replace(F.regexp_replace(F.trim(label), r"(\(\))+$", ""), r"^\.+", ""))
    return bare.isin(*ENTRY_LABELS)


def is_file_label(label: Column) -> Column:
    return F.regexp_replace(F.trim(label), r"(\(\))+$", "").rlike(r"^[^(]+\.[A-Za-z0-9]{1,5}$")

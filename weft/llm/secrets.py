"""Secret scans: base patterns, and formats learned by merging states of prefix trees."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from weft.llm.common import frame_udf
from weft.plans.runtime import ship

#: Order of kinds at the same start; "format" spans are the automata's.
KINDS = ("assign", "access", "hex", "format")
#: Labelled values of each kind, and of none, from which automata are inferred: those of the smallest
#: hash, and of at most so many characters. What is no credential is more varied.
SAMPLE, OTHER_SAMPLE, SAMPLE_CHARS = 400, 2000, 128
#: Confidence of the compatibility test, least visits of a state that it needs, and added mass.
ALPHA, LEAST_VISITS, MASS = 0.05, 12, 0.05
#: Nats by which a candidate's likelihood as a credential must exceed that as anything else.
MARGIN = 8.0

# The base patterns. A dot is part of a value, so the end of a sentence may be too.
ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
KEYWORDS = ("password", "passwd", "secret", "token", "api")
SYMBOLS = 68


def base_spans(text: str, tokens: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int, str]]:
    """(start, kind's index, end, value) of the base patterns, in order of start and kind.

    Access keys and hex runs are inside runs of a value's characters, so only long runs are searched.
    """
    found = []
    lowered = text.lower()
    if any(k in lowered for k in KEYWORDS):
        found += [(m.start(), 0, m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    for s, e in tokens if tokens is not None else [m.span() for m in CANDIDATE.finditer(text)]:
        if e - s >= 20:
            found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text, s, e)]
            found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text, s, e)]
    return sorted(found)


class Automaton:
    """A probabilistic deterministic automaton; state 0 is the start and the symbol "" the end."""

    def __init__(self, counts: list[dict[str, int]], moves: list[dict[str, int]]):
        self.moves = moves
        self.log = []
        for row in counts:
            total = sum(row.values()) + MASS * (SYMBOLS + 1)
            own = {c: math.log((n + MASS) / total) for c, n in row.items()}
            self.log.append((own, math.log(MASS / total)))

    def likelihood(self, value: str) -> float:
        """Log-probability; an unseen symbol leads to the start state."""
        at, total = 0, 0.0
        for c in value:
            own, other = self.log[at]
            total += own.get(c, other)
            at = self.moves[at].get(c, 0)
        own, other = self.log[at]
        return total + own.get("", other)


def infer(values: list[str], alpha: float = ALPHA, least: int = LEAST_VISITS) -> Automaton:
    """ALERGIA: merge states of the values' prefix tree whose futures don't differ significantly.

    States are taken in breadth-first order; each is merged into an accepted state that it is
    compatible with (Hoeffding's bound on each symbol and the end, for the states and, below them, for
    all states that the merge would put together), or else accepted. Of several, the one that gives its
    own symbols the highest likelihood is taken, the earliest if tied. States of under ``least`` visits
    have too little evidence against a merge.
    """
    counts: list[dict[str, int]] = [{}]
    moves: list[dict[str, int]] = [{}]
    for value in sorted(values):
        at = 0
        for c in value:
            counts[at][c] = counts[at].get(c, 0) + 1
            if c not in moves[at]:
                moves[at][c] = len(counts)
                counts.append({})
                moves.append({})
            at = moves[at][c]
        counts[at][""] = counts[at].get("", 0) + 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(a: int, b: int) -> bool:
        x, y = counts[a], counts[b]
        n, m = sum(x.values()), sum(y.values())
        if min(n, m) < least:
            return False
        limit = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        return any(abs(x.get(c, 0) / n - y.get(c, 0) / m) > limit for c in x.keys() | y.keys())

    def fit_of(a: int, b: int) -> float:
        row, total = counts[a], sum(counts[a].values()) + MASS * (SYMBOLS + 1)
        return sum(n * math.log((row.get(c, 0) + MASS) / total) for c, n in counts[b].items())

    def compatible(a: int, b: int) -> bool:
        pending, seen = [(a, b)], set()
        while pending:
            a, b = pending.pop()
            if a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            if differ(a, b):
                return False
            if sum(counts[b].values()) >= least:
                pending += [(moves[a][c], moves[b][c]) for c in moves[a].keys() & moves[b].keys()]
        return True

    def fold(into: int, other: int) -> None:
        pending = [(into, other)]
        while pending:
            into, other = pending.pop()
            if into == other:
                continue
            for c, n in counts[other].items():
                counts[into][c] = counts[into].get(c, 0) + n
            for c, target in moves[other].items():
                if c in moves[into]:
                    pending.append((moves[into][c], target))
                else:
                    moves[into][c] = target

    accepted = [0]
    while True:
        members = set(accepted)
        edge = next(((s, c, t) for s in accepted for c, t in sorted(moves[s].items()) if t not in members), None)
        if edge is None:
            break
        state, symbol, target = edge
        fitting = [candidate for candidate in accepted if compatible(candidate, target)]
        if fitting:
            best = max(fitting, key=lambda candidate: fit_of(candidate, target))
            moves[state][symbol] = best
            fold(best, target)
        else:
            accepted.append(target)
    name = {s: k for k, s in enumerate(accepted)}
    return Automaton([counts[s] for s in accepted], [{c: name[t] for c, t in moves[s].items()} for s in accepted])


class Formats:
    """The automata of credentials by kind, and of other runs of the same characters."""

    def __init__(self, kinds: dict[str, Automaton], other: Automaton | None, margin: float = MARGIN):
        self.kinds, self.other, self.margin = kinds, other, margin

    def is_secret(self, value: str) -> bool:
        if not self.kinds or self.other is None:
            return False
        best = max(a.likelihood(value) for a in self.kinds.values())
        return best - self.other.likelihood(value) > self.margin


def all_spans(text: str, formats: Formats | None) -> tuple[list, list]:
    """Base spans, and those that the formats add, of the candidates that aren't inside a base span."""
    tokens = [m.span() for m in CANDIDATE.finditer(text)]
    base = base_spans(text, tokens)
    added = []
    if formats is not None and formats.kinds:
        at = furthest = 0
        for s, e in tokens:
            while at < len(base) and base[at][0] <= s:
                furthest = max(furthest, base[at][2])
                at += 1
            if furthest < e and formats.is_secret(text[s:e]):
                added.append((s, 3, e, text[s:e]))
    return base, added


def untouched(text: str) -> tuple[list, list[str]]:
    """Base spans, and the candidates that none of them touches."""
    tokens = [m.span() for m in CANDIDATE.finditer(text)]
    base = base_spans(text, tokens)
    others, at, furthest = [], 0, 0
    for s, e in tokens:
        while at < len(base) and base[at][0] < e:
            furthest = max(furthest, base[at][2])
            at += 1
        if furthest <= s:
            others.append(text[s:e])
    return base, others


def fit(
    docs: DataFrame, sample: int = SAMPLE, other_sample: int = OTHER_SAMPLE, margin: float = MARGIN, sample_chars: int = SAMPLE_CHARS
) -> Formats:
    """Formats from the base patterns' finds, as labelled credentials, and from candidates they don't touch.

    All texts are searched, once; automata are inferred from ``sample`` different values of each kind, and
    from ``other_sample`` of no kind, of the smallest hashes and of at most ``sample_chars`` characters,
    which bounds a prefix tree. What is scored later may be longer. Without finds there are no formats.
    """
    ship(docs.sparkSession)

    def finds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = set()
            for text in batch["text"]:
                base, others = untouched(text or "")
                rows |= {(KINDS[k], v) for _, k, _, v in base if len(v) <= sample_chars}
                rows |= {("other", v) for v in others if len(v) <= sample_chars}
            yield pd.DataFrame(sorted(rows), columns=["kind", "value"])

    found = docs.select("text").mapInPandas(finds, "kind string, value string")
    # Pre-aggregated; and then a bounded number of each kind leaves a task.
    values = found.groupBy("kind", "value").agg(F.count("*").alias("n"))
    first = Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value")
    most = F.when(F.col("kind") == "other", other_sample).otherwise(sample)
    picked = values.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= max(sample, other_sample)).filter(F.col("nth") <= most)
    kinds: dict[str, list[str]] = {}
    for row in picked.select("kind", "value").collect():
        kinds.setdefault(row["kind"], []).append(row["value"])
    automata = {k: infer(v) for k, v in sorted(kinds.items())}
    other = automata.pop("other", None)
    return Formats(automata, other, margin)


COLUMNS = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]


def secret_columns(docs: DataFrame, formats: Formats | None) -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, base_sha256 and spans; columns of these names are replaced.

    spans joins kind:start:end of all spans in order of start and kind, in code points with the end
    excluded; base_sha256 hashes those of the base patterns. "format" spans are candidates of 16 or
    more characters, outside base spans, that are more likely as a credential of some kind than as
    anything else by the margin. A null text counts as empty; repeated rows have equal values; without
    ``formats`` there are base spans only.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop(*COLUMNS, "secret_struct")
    sent = spark.sparkContext.broadcast(formats)

    def scanned(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            base, added = all_spans(text or "", sent.value)
            name = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)
            n = [sum(k == kind for _, k, _, _ in base) for kind in range(3)]
            rows.append((*n, hashlib.sha256(name(base).encode()).hexdigest(), name(sorted(base + added))))
        return pd.DataFrame(rows, columns=COLUMNS)

    out = docs.withColumn("secret_struct", frame_udf(scanned, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")(F.col("text")))
    return out.select(*[F.col(c) for c in docs.columns], *[F.col(f"secret_struct.{n}").alias(n) for n in COLUMNS])

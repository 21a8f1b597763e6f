"""How strong an edge is."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Rank of each confidence label; any other is 0.5.
RANKS = {"DECLARED": 1.0, "EXTRACTED": 0.9, "RESOLVED": 0.85, "INFERRED": 0.7, "SEMANTIC": 0.6}
#: Relations that keep books rather than use anything.
NON_USAGE = ("contains", "similar_to", "relates_to", "shares_reference", "participate_in", "rationale_for", "forks")
#: Relations along which a change spreads backwards.
IMPACT = ("calls", "references", "imports", "imports_from", "inherits", "uses", "depends_on", "requires")


def confidence_rank(label: Column) -> Column:
    chain = F.lit(0.5)
    for name, rank in RANKS.items():
        chain = F.when(F.upper(label) == name, F.lit(rank)).otherwise(chain)
    return chain


def edge_weight(label: Column, score: Column) -> Column:
    """The stored score if it is in [0, 1], else the label's rank."""
    return F.when(score.between(0, 1), score).otherwise(confidence_rank(label))


def strength(label: Column, score: Column) -> Column:
    """The stored score as it is, else the label's rank."""
    return F.coalesce(score, confidence_rank(label))


def meets_detail(label: Column, score: Column, least: float) -> Column:
    """From 0.9 on, the label must be of the top tier whatever the score; below, the strength counts."""
    if least >= 0.9:
        return F.upper(label).isin("EXTRACTED", "DECLARED")
    return strength(label, score) >= least


def passes_floor(label: Column, score: Column, floor: float) -> Column:
    """Only SEMANTIC edges have to reach the floor."""
    return (F.upper(label) != "SEMANTIC") | (F.coalesce(score, confidence_rank(label)) >= floor)


def is_usage(relation: Column) -> Column:
    return ~relation.isin(*NON_USAGE)


def seed_score(cosine: Column, floor=0.45, strong=0.70, cap=0.67) -> Column:
    """A cosine on the scale of seed scores: 0 up to the floor, the cap from ``strong`` on."""
    return F.when(cosine <= floor, 0.0).otherwise(F.least(F.lit(cap), (cosine - floor) * (cap / (strong - floor))))


def description_seed_score(cosine: Column, floor=0.45, strong=0.70, cap=0.67) -> Column:
    """As ``seed_score``, but a strong match ranks like one of a label: 2.0 and up to 2.6."""
    return F.when(cosine < strong, seed_score(cosine, floor, strong, cap)).otherwise(F.least(F.lit(2.6), 2.0 + (cosine - strong) * 3.0))

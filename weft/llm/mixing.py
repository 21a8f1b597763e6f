"""Mixing sources to target weights by whole repeats and one Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weft.llm.common import hex_fraction, word_count
from weft.plans.runtime import cut

#: Largest number of sources whose table is sent to every executor (about 64 bytes each).
BROADCAST_SOURCES = 100_000


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), epochs: float = 1.5, ceiling: float = 2.0
) -> DataFrame:
    """(source, source_size, target, rate) from rows (source, size).

    Sources in order of code points, null last, weigh ``weights`` in turn and share ``epochs`` times
    all sizes. A target stops at ``ceiling`` times its source's size; what is above goes to the others
    by weight until none is above; a source without words has target and rate 0. That is water-filling: with the sources in order of ceiling over
    weight, the level is the remaining budget over the remaining weight at the first source that
    stays below its ceiling. The windows run over one row a source, not over documents.
    """
    per_source = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = per_source.withColumn(
        "w", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ).withColumn("cap", F.col("source_size") * F.lit(float(ceiling)))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = (
        weighed.withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(epochs)))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("heavy", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("heavy"))
        .withColumn("open", F.col("level") * F.col("w") < F.col("cap"))
    )
    level = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), "source", "level"))).over(whole)
    target = F.least(F.col("cap"), F.coalesce(level["level"] * F.col("w"), F.col("cap")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return levels.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "target", "rate")


def _copies(rate: Column, doc_id: Column, seed: int) -> Column:
    whole = F.floor(rate)
    extra = hex_fraction(F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null"))) < rate - whole
    return (whole + extra.cast("long")).cast("long")


def plan_mix(docs: DataFrame, seed: int = 7, **shares) -> DataFrame:
    """``docs`` with size, source_size, target, rate and copies; columns of these names are replaced, and one named mix_key goes.

    A document's copies are floor(rate) of its source plus one with the probability of the fraction,
    drawn from a hash of seed and doc_id: reruns and any partitioning agree, repeated rows are drawn
    alike, a null doc_id counts as the text "null", a null text has size 0 and a null source is a
    source of its own. With rates of at most 2, no document is taken more than twice. An empty table
    gives an empty result. The documents aren't shuffled: sizes are summed per source on the map side,
    and the small table of sources is broadcast after its rows have been counted; above
    BROADCAST_SOURCES it is joined by shuffle, where adaptive execution splits hot sources.
    """
    docs = docs.drop("size", "source_size", "target", "rate", "copies", "mix_key")
    sizes = docs.select("source", word_count(F.col("text")).alias("size"))
    targets = cut(source_targets(sizes, **shares)).withColumnRenamed("source", "mix_key")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    sized = docs.withColumn("size", word_count(F.col("text")))
    joined = sized.join(targets, sized["source"].eqNullSafe(targets["mix_key"]), "left").drop("mix_key")
    return joined.withColumn("copies", _copies(F.col("rate"), F.col("doc_id"), seed))


def mix_sources(docs: DataFrame, seed: int = 7, **shares) -> DataFrame:
    """The mix itself: every document once per copy, with the columns of ``docs``, whatever their names; see ``plan_mix``."""
    whole = docs.select(F.struct(*docs.columns).alias("mix_doc"), "doc_id", "source", "text")
    planned = plan_mix(whole, seed, **shares).filter("copies > 0")
    return planned.select("mix_doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("mix_copy")).select("mix_doc.*")

"""What questions teach: pairs, promotion, outcomes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window, functions as F

from weft.plans.runtime import cut

#: Pairs that a task counts at most, unless one number has more.
TASK_PAIRS = 2_000_000


def record_pairs(known: DataFrame, seen: DataFrame) -> DataFrame:
    """(source, target, question, hits, first_seen, last_seen) after new sightings (source, target, question, at)."""
    fresh = seen.select("source", "target", "question", F.lit(1).cast("long").alias("hits"), F.col("at").alias("first_seen"), F.col("at").alias("last_seen"))
    return known.unionByName(fresh).groupBy("source", "target", "question").agg(
        F.sum("hits").alias("hits"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )


def promote(pairs: DataFrame, outcomes: DataFrame, nodes: DataFrame | None = None, questions: int = 2, hits: int = 3) -> DataFrame:
    """(source, target, hits, confidence_score) of pairs that enough questions share and that haven't all failed."""
    kept = pairs
    if nodes is not None:
        for side in ("source", "target"):
            kept = kept.join(nodes.select(F.col("id").alias(side)), side, "left_semi")
    verdicts = outcomes.select("question", F.col("outcome").isin("dead_end", "corrected").alias("failed"))
    grouped = kept.join(verdicts, "question", "left").groupBy("source", "target").agg(
        F.countDistinct("question").alias("questions"), F.sum("hits").alias("hits"),
        F.countDistinct(F.when(F.col("failed"), F.col("question"))).alias("failures"),
    )
    good = grouped.filter((F.col("questions") >= questions) & (F.col("hits") >= hits) & (F.col("failures") < F.col("questions")))
    score = F.greatest(F.lit(0.1), F.least(F.lit(1.0), (F.col("hits") - 1) / F.lit(9.0)))
    return good.select("source", "target", "hits", score.alias("confidence_score"))


def learned_edges(edges: DataFrame, promoted: DataFrame) -> DataFrame:
    """``edges`` with all learned ones replaced by the promoted pairs."""
    new = promoted.select(
        "source", "target", F.lit("learned").alias("relation"), F.lit("INFERRED").alias("confidence"), "confidence_score", F.lit("query_history").alias("source_file")
    )
    return edges.filter("relation <> 'learned'").unionByName(new, allowMissingColumns=True)


def latest_outcomes(outcomes: DataFrame) -> DataFrame:
    """The last verdict of each question; of equal times, the first in the alphabet."""
    order = Window.partitionBy("question").orderBy(F.desc("updated_at"), "outcome")
    return outcomes.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def reflect(citations: DataFrame, outcomes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, useful, last_useful, dead, contested): how often each existing node helped, by its questions' outcomes."""
    live = citations.join(nodes.select(F.col("id").alias("node")), "node", "left_semi").join(latest_outcomes(outcomes), "question")
    good, bad = F.col("outcome") == "useful", F.col("outcome") == "dead_end"
    return live.groupBy("node").agg(
        F.count(F.when(good, 1)).alias("useful"), F.max(F.when(good, F.col("updated_at"))).alias("last_useful"), F.count(F.when(bad, 1)).alias("dead")
    ).withColumn("contested", (F.col("useful") > 0) & (F.col("dead") > 0))


def token_reduction(corpus_bytes: DataFrame, answers: DataFrame) -> DataFrame:
    """One row: tokens of the whole corpus, mean tokens of an answer, and their ratio."""
    whole = corpus_bytes.agg((F.sum("n_bytes") / 4).alias("corpus_tokens"))
    mean = answers.agg(F.avg("n_tokens").alias("answer_tokens")).scalar()
    return whole.withColumn("answer_tokens", mean).withColumn("reduction", F.col("corpus_tokens") / F.col("answer_tokens"))


def review_score(pulls: DataFrame) -> DataFrame:
    """Pull requests by how much they need a look: failed checks, coverage, requests, conflicts and impact."""
    score = (
        F.when(F.col("coverage_error"), 35).otherwise(0) + F.when(F.col("ci_failing"), 40).otherwise(0)
        + F.when(F.col("changes_requested"), 30).otherwise(0) + F.when(F.col("conflicts"), 25).otherwise(0)
        + F.least(F.col("impacted"), F.lit(30)) - F.when(F.col("draft"), 20).otherwise(0)
    )
    return pulls.withColumn("score", score).orderBy(F.desc("score"), "number")


def review_overlap(touched: DataFrame) -> DataFrame:
    """(first, second, shared): symbols that two pull requests both touch."""
    sets = cut(touched.filter("symbol IS NOT NULL").groupBy("symbol").agg(F.sort_array(F.collect_set("number")).alias("numbers")).select("numbers"))
    n = F.size("numbers").cast("long")
    pairs = sets.agg(F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0))).first()[0]
    # Each number goes to its counts with the later ones of a symbol in one row, so that only lists are shuffled.
    at = sets.select(F.posexplode("numbers").alias("at", "first"), "numbers").filter(F.col("at") < F.size("numbers") - 1)
    met = at.select("first", F.slice("numbers", F.col("at") + 2, F.size("numbers")).alias("later"))
    tasks = max(touched.sparkSession.sparkContext.defaultParallelism, -(-int(pairs) // TASK_PAIRS))
    return met.repartition(tasks, "first").select("first", F.explode("later").alias("second")).groupBy("first", "second").agg(F.count("*").alias("shared"))


def risk_score(changed: int, impacted: int, complete: bool) -> tuple[int | None, str]:
    """The score and its level; without complete coverage there is none."""
    if not complete:
        return None, "unknown"
    score = min(100, 2 * changed + impacted)
    return score, "high" if score >= 60 else "medium" if score >= 30 else "low"


OUTCOMES = ("useful", "dead_end", "corrected")


def save_result(nodes: DataFrame, edges: DataFrame, outcomes: DataFrame, question: str, outcome: str, cited: list[str], most: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph and the outcomes with a verdict added: a memory node, and references to cited nodes that exist."""
    if outcome not in OUTCOMES:
        raise ValueError(f"outcome is one of {', '.join(OUTCOMES)}")
    spark = nodes.sparkSession
    plain = " ".join(question.lower().split())[:200]
    row = spark.createDataFrame([(plain, outcome)], "question string, outcome string").withColumn("updated_at", F.current_timestamp())
    outcomes = outcomes.filter(F.col("question") != plain).unionByName(row.select(*outcomes.columns))
    ident = "memory::" + re.sub(r"[^0-9a-z]+", "_", plain).strip("_")
    node = spark.createDataFrame([(ident, question[:256], "document", f"memory/{ident[8:]}.md")], "id string, label string, file_type string, source_file string")
    known = nodes.filter(F.col("id").isin(cited)).select("id").orderBy("id").limit(most)
    new = known.select(F.lit(ident).alias("source"), F.col("id").alias("target"), F.lit("references").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.lit(1.0).alias("confidence_score"), F.lit(f"memory/{ident[8:]}.md").alias("source_file"))
    kept = nodes.filter(F.col("id") != ident).unionByName(node, allowMissingColumns=True)
    return kept, edges.filter(F.col("source") != ident).unionByName(new, allowMissingColumns=True), outcomes


def merge_gate(exists: bool, age_hours: float, covered: bool, health: int, risk: int | None) -> dict[str, bool]:
    """Each check by its name; a merge passes if all do, and an unknown risk fails."""
    return {"graph": exists, "age": age_hours <= 24, "coverage": covered, "health": health >= 60, "risk": risk is not None and risk <= 70}

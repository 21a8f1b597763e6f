"""Stages that a model may take part in: a digest, labels of communities with their cache, deep links, and small reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from weft.operators import analytics, traverse

#: What is asked of a model at most, and the least size of a community that is worth a label.
LABEL_CALLS, LABEL_LEAST, CONCEPTS, SYMBOLS = 48, 3, 80, 60


def digest(nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """(section, nth, name, size): the ``k`` largest communities, hubs and groups of files in cycles."""

    def section(title: str, rows: DataFrame, name: str, size: str) -> DataFrame:
        nth = F.row_number().over(Window.orderBy(F.desc(size), name))
        return rows.orderBy(F.desc(size), name).limit(k).select(F.lit(title).alias("section"), nth.alias("nth"), F.col(name).cast("string").alias("name"), F.col(size).cast("long").alias("size"))

    sizes = nodes.filter("community IS NOT NULL").groupBy("community").agg(F.count("*").alias("size"))
    out = section("communities", sizes, "community", "size")
    out = out.unionByName(section("hubs", analytics.hub_churn(nodes, edges, k), "id", "degree"))
    return out.unionByName(section("cycles", traverse.file_cycles(nodes, edges, k=k), "component", "size"))


def label_requests(members: DataFrame, cache: DataFrame, fingerprint: str, calls: int = LABEL_CALLS, least: int = LABEL_LEAST) -> DataFrame:
    """(community, size, member_hash, summary) of the communities that need a label from a model, the largest first.

    ``members`` has id, community and label; a community's summary is its first five labels. A label in
    ``cache`` (community, member_hash, summary, fingerprint, source) serves again if a model gave it and
    its members, summary and the model's fingerprint are the same. At most ``calls`` are asked for.
    """
    some = members.filter("community IS NOT NULL")
    first = F.array_join(F.slice(F.sort_array(F.collect_set(F.coalesce("label", "id"))), 1, 5), ", ").alias("summary")
    groups = some.groupBy("community").agg(F.count("*").alias("size"), first).filter(F.col("size") >= least)
    groups = groups.join(analytics.member_hash(some), "community")
    valid = cache.filter((F.col("source") == "llm") & (F.col("fingerprint") == fingerprint)).select("community", "member_hash", "summary")
    return groups.join(valid, ["community", "member_hash", "summary"], "left_anti").orderBy(F.desc("size"), "community").limit(calls).select("community", "size", "member_hash", "summary")


def label_communities(members: DataFrame, cache: DataFrame, fingerprint: str, ask: Callable[[str], str], **how) -> DataFrame:
    """``cache`` with a row for each request that ``ask`` answers (at most ``calls``, on the driver); a failed one is left for the next run."""
    rows = []
    for request in label_requests(members, cache, fingerprint, **how).collect():
        label = ask(request["summary"])
        if label:
            rows.append((request["community"], request["member_hash"], request["summary"], fingerprint, "llm", label))
    kind = dict(cache.dtypes)["community"]
    fresh = cache.sparkSession.createDataFrame(rows, f"community {kind}, member_hash string, summary string, fingerprint string, source string, label string")
    kept = cache.join(fresh.select("community"), "community", "left_anti")
    return kept.select(*fresh.columns).unionByName(fresh)


def deep_link_prompts(nodes: DataFrame, edges: DataFrame, concepts: int = CONCEPTS, symbols: int = SYMBOLS) -> tuple[DataFrame, DataFrame]:
    """What a model is shown: (id, label) of the most linked concepts, and (source_file, nth, id) of each file's most linked symbols."""
    semantic = nodes.filter(F.col("file_type").isin("concept", "pattern", "module"))
    best = semantic.join(analytics.degrees(edges).select("id", "degree"), "id", "left").fillna(0, ["degree"])
    best = best.orderBy(F.desc("degree"), "id").limit(concepts).select("id", "label")
    code = nodes.filter(F.col("file_type").isin("code", "entity"))
    return best, analytics.top_symbols(code, edges, symbols).select("source_file", "nth", "id")


def deep_links(concepts: DataFrame, symbols: DataFrame, proposed: DataFrame) -> DataFrame:
    """Edges of the proposed links (source, target) whose ends were both shown, in either direction; each once.

    They are INFERRED at 0.5, of the relation ``relates_to`` and the context ``deep``.
    """
    known = concepts.select("id").unionByName(symbols.select("id")).distinct()
    kept = proposed.filter("source <> target").select("source", "target").distinct()
    for side in ("source", "target"):
        kept = kept.join(known.select(F.col("id").alias(side)), side, "left_semi")
    return kept.select(
        "source", "target", F.lit("relates_to").alias("relation"), F.lit("INFERRED").alias("confidence"),
        F.lit(0.5).alias("confidence_score"), F.lit("deep").alias("context"),
    )


def vector_models(vectors: DataFrame) -> DataFrame:
    """(model, n): how many vectors each model has made."""
    return vectors.groupBy("model").agg(F.count("*").alias("n"))


def newest(history: DataFrame, k: int = 20, at: str = "created_at") -> DataFrame:
    """The newest ``k`` rows of a history, by ``at`` and then by all columns."""
    return history.orderBy(F.desc(at), *history.columns).limit(k)


def cost_report(calls: DataFrame, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """(stage, model, calls, tokens_in, tokens_out, cost, seconds) of a log of model calls; a model without a price costs null.

    ``prices``: per model, for a million tokens in and out.
    """
    sums = calls.groupBy("stage", "model").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("seconds").alias("seconds"))
    cost = F.lit(None).cast("double")
    for model, (into, out) in prices.items():
        cost = F.when(F.col("model") == model, (F.col("tokens_in") * into + F.col("tokens_out") * out) / 1e6).otherwise(cost)
    return sums.select("stage", "model", "calls", "tokens_in", "tokens_out", cost.alias("cost"), "seconds")

"""Joins that bind names, lines and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from weft.plans.runtime import cut


def bind_unique(wanted: DataFrame, candidates: DataFrame, keys: list[str], rank: str | None = None) -> DataFrame:
    """``wanted`` (edge_id, keys) with the ``target`` of its one candidate; of several, none binds.

    With ``rank`` (of the candidates), only those of the best rank compete. Candidates are counted by
    key before they meet the wanted names, so a name with many candidates and many uses isn't expanded.
    """
    if rank is not None:
        best = candidates.groupBy(*keys).agg(F.min(rank).alias("best_rank"))
        candidates = candidates.join(best, keys).filter(F.col(rank) == F.col("best_rank")).drop("best_rank", rank)
    single = candidates.groupBy(*keys).agg(F.min("target").alias("target"), F.max("target").alias("other"))
    return wanted.join(single.filter("target = other").drop("other"), keys)


def suffixes(name):
    """All scope suffixes of a qualified name, the longest first."""
    parts = F.split(name, "::")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "::"))


def as_of(events: DataFrame, facts: DataFrame, by: str, at: str, value: str, strict: bool = True) -> DataFrame:
    """``events`` with the ``value`` of the fact nearest before (``strict``), or at or before, in the same ``by``.

    Both sides are put in one order and the last fact is carried along: a sort, not a range join. Facts
    that tie are ordered by their value.
    """
    side = F.lit(1 if strict else 0)
    names = events.columns
    left = events.select(*names, (F.lit(0) if strict else F.lit(1)).alias("side"), F.lit(None).cast(facts.schema[value].dataType).alias("fact"))
    right = facts.select(by, at, side.alias("side"), F.col(value).alias("fact"), F.lit(True).alias("is_fact"))
    both = left.withColumn("is_fact", F.lit(False)).unionByName(right, allowMissingColumns=True)
    # Strict: events (0) come before facts (1) of the same place; else facts (0) before events (1).
    order = Window.partitionBy(by).orderBy(at, "side", "fact").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("carried", F.last(F.when(F.col("is_fact"), F.col("fact")), ignorenulls=True).over(order))
    return carried.filter(~F.col("is_fact")).select(*names, F.col("carried").alias(value))


def narrowest_spans(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """(file, line, span_id): the spans (file, first, last) that hold each line, narrowest only, ties kept.

    Spans are cut into blocks of 256 lines that equi-join the lines' blocks, so a long span doesn't meet
    every line of its file, and lines are kept once.
    """
    block = F.lit(256).cast("long")
    cutup = spans.select("file", "first", "last", "span_id", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor(F.col("last") / block))).alias("block"))
    met = lines.select("file", "line").distinct().withColumn("block", F.floor(F.col("line") / block)).join(cutup, ["file", "block"])
    held = met.filter(F.col("line").between(F.col("first"), F.col("last"))).withColumn("width", F.col("last") - F.col("first"))
    best = held.groupBy("file", "line").agg(F.min("width").alias("least_width"))
    return held.join(best, ["file", "line"]).filter("width = least_width").select("file", "line", "span_id")


def resolve_modules(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """(module, path): an exact alias, else the wildcard alias of the longest prefix (pattern "prefix*")."""
    exact = aliases.filter(~F.col("pattern").endswith("*")).select(F.col("pattern").alias("module"), "path", F.lit(1 << 20).alias("n"))
    wild = aliases.filter(F.col("pattern").endswith("*")).select(F.expr("left(pattern, length(pattern) - 1)").alias("prefix"), "path")
    modules = imports.select("module").distinct()
    prefixes = modules.select("module", F.explode(F.transform(F.sequence(F.lit(0), F.length("module")), lambda n: F.substring("module", F.lit(1), n))).alias("prefix"))
    starred = prefixes.join(wild, "prefix").select(
        "module", F.replace("path", F.lit("*"), F.expr("substr(module, length(prefix) + 1)")).alias("path"), F.length("prefix").alias("n")
    )
    every = modules.join(exact, "module").unionByName(starred)
    return every.groupBy("module").agg(F.max_by("path", F.struct("n", "path")).alias("path"))


def mentions(documents: DataFrame, names: DataFrame, most: int = 200) -> DataFrame:
    """(doc, name, line): the first line of each document that has each name as a whole token, ``most`` a document."""
    tokens = documents.select("doc", F.posexplode(F.split("text", "\n")).alias("line", "content")).select(
        "doc", (F.col("line") + 1).alias("line"), F.explode(F.array_distinct(F.split("content", r"[^A-Za-z0-9_./@-]+"))).alias("name")
    )
    first = tokens.join(names.select("name").distinct(), "name").groupBy("doc", "name").agg(F.min("line").alias("line"))
    nth = F.row_number().over(Window.partitionBy("doc").orderBy("line", "name"))
    return first.withColumn("nth", nth).filter(F.col("nth") <= most).drop("nth")


def dispatch(members: DataFrame, implements: DataFrame) -> DataFrame:
    """(source, target): an interface's member to the one of the same name in each type that implements it."""
    own = members.groupBy("owner", "name").agg(F.min("id").alias("id"), F.count("*").alias("n")).filter("n = 1").drop("n")
    a = own.select(F.col("owner").alias("interface"), "name", F.col("id").alias("source"))
    b = own.select(F.col("owner").alias("type"), "name", F.col("id").alias("target"))
    return implements.join(a, "interface").join(b, ["type", "name"]).select("source", "target", F.lit(0.6).alias("confidence_score"))


def structural_implements(members: DataFrame, interfaces: DataFrame, most: int = 10) -> DataFrame:
    """(interface, type): types that have all of an interface's members; of over ``most`` types, none is linked."""
    need = members.join(interfaces, members["owner"] == interfaces["interface"]).select("interface", "name").distinct()
    size = need.groupBy("interface").agg(F.count("*").alias("size"))
    have = members.join(interfaces, members["owner"] == interfaces["interface"], "left_anti").select(F.col("owner").alias("type"), "name").distinct()
    met = need.join(have, "name").groupBy("interface", "type").agg(F.count("*").alias("n")).join(size, "interface").filter("n = size")
    few = met.groupBy("interface").count().filter(F.col("count") <= most).select("interface")
    return met.join(few, "interface", "left_semi").select("interface", "type")


def inherited_members(receivers: DataFrame, members: DataFrame, parents: DataFrame, depth: int = 6) -> DataFrame:
    """(call, target, level): the member of each call's receiver type, or of its nearest ancestor, if it is one."""
    left, out = cut(receivers.select("call", "type", "name")), None
    for level in range(depth + 1):
        met = left.join(members.select(F.col("owner").alias("type"), "name", "id"), ["type", "name"])
        hit = met.groupBy("call").agg(F.min("id").alias("target"), F.max("id").alias("other"))
        named = hit.select("call", F.when(F.col("target") == F.col("other"), F.col("target")).alias("target"), F.lit(level).alias("level"))
        out = named if out is None else out.unionByName(named)
        left = left.join(hit.select("call"), "call", "left_anti").join(parents.select(F.col("child").alias("type"), "parent"), "type")
        left = cut(left.select("call", F.col("parent").alias("type"), "name").distinct())
        if left.isEmpty():
            break
    return out.filter("target IS NOT NULL")

"""Merging, comparing and federating graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from weft.plans.runtime import cut, dealt, light

EDGE_KEY = ("source", "target", "relation", "confidence", "confidence_score", "source_file")


def namespaced(nodes: DataFrame, edges: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """The graph with the ids of located nodes under ``tag``, and of the others under their lower-case label."""
    located = F.coalesce("source_file", F.lit("")) != ""
    new = F.when(located, F.concat(F.lit(f"{tag}::"), "id")).otherwise(F.concat(F.lit("stub::"), F.lower("label")))
    # Only ends that aren't located or have no node are looked up, so that edges aren't shuffled for it.
    bare, placed = cut(nodes.filter(~located)), nodes.filter(located)
    ends = edges.select(F.explode(F.array("source", "target")).alias("old"))
    kinds = {"end": ends, "placed": placed.select(F.col("id").alias("old")), "bare": bare.select(F.col("id").alias("old"))}
    met = None
    for kind, ids in kinds.items():
        ids = ids.select("old", *[F.lit(k == kind).alias(k) for k in kinds])
        met = ids if met is None else met.unionByName(ids)
    met = met.filter("old IS NOT NULL").groupBy("old").agg(*[F.max(k).alias(k) for k in kinds])
    odd = cut(met.filter("end AND (bare OR NOT placed)"))
    found = bare.select(F.col("id").alias("old"), new.alias("new")).join(light(odd.select("old"), odd.count()), "old", "left_semi").distinct()
    found = found.unionByName(odd.filter("placed").select("old", F.concat(F.lit(f"{tag}::"), "old").alias("new")))
    other = cut(found.unionByName(odd.filter("NOT placed AND NOT bare").select("old", F.lit(None).cast("string").alias("new"))).withColumn("odd", F.lit(True)))
    n, out = other.count(), edges
    for side in ("source", "target"):
        out = out.filter(F.col(side).isNotNull()).join(light(other, n), F.col(side) == F.col("old"), "left").filter("odd IS NULL OR new IS NOT NULL")
        out = out.withColumn(side, F.coalesce("new", F.concat(F.lit(f"{tag}::"), side))).drop("old", "new", "odd")
    return placed.unionByName(bare).withColumn("id", new).withColumn("repo", F.when(located, F.lit(tag))), out.select(*edges.columns)


def merge_graphs(graphs: list[tuple[str, DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """One graph of several (tag, nodes, edges): shared stubs are one, loops go, equal edges are one."""
    nodes = edges = None
    rows = 0
    for tag, n, e in graphs:
        rows += e.count()
        n, e = namespaced(n, e, tag)
        nodes = n if nodes is None else nodes.unionByName(n)
        edges = e if edges is None else edges.unionByName(e)
    first = Window.partitionBy("id").orderBy(F.col("repo").asc_nulls_last(), "label")
    nodes = nodes.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")
    return nodes, dealt(edges.filter("source <> target"), rows, "source", "target").dropDuplicates([c for c in EDGE_KEY if c in edges.columns])


def diff_graphs(old_nodes: DataFrame, old_edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> DataFrame:
    """(what, n): nodes by id, and edges by source, target and relation, that were added or removed."""
    rows, found = old_edges.count() + new_edges.count(), None
    for what, old, new, keys in (("nodes", old_nodes, new_nodes, ["id"]), ("edges", old_edges, new_edges, ["source", "target", "relation"])):
        side = lambda df, name: df.select(*keys, F.lit(name).alias("new"))  # noqa: B023, E731
        each = dealt(side(old, False).unionByName(side(new, True)), rows, *keys).groupBy(*keys).agg(F.min("new").alias("lo"), F.max("new").alias("hi"))
        whole = F.col(keys[0]).isNotNull()
        for key in keys[1:]:
            whole &= F.col(key).isNotNull()
        # A null is equal to nothing, so that what has one is both added and removed.
        n = each.agg(F.count_if(F.col("hi") & (F.col("lo") | ~whole)).alias("added"), F.count_if(~F.col("lo") & (~F.col("hi") | ~whole)).alias("removed"))
        n = n.select(F.explode(F.array(*[F.struct(F.lit(f"{what}_{c}").alias("what"), F.col(c).alias("n")) for c in ("added", "removed")])).alias("r")).select("r.*")
        found = n if found is None else found.unionByName(n)
    return found


def three_way_merge(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows by key: what one side alone has removed goes, and fields that one side alone has changed are its.

    Where both have changed a field, ours stays. Added rows stay; rows that both have removed go.
    """
    parts = {}
    for p, df in (("b", base), ("o", ours), ("t", theirs)):
        parts[p] = df.select(F.col(key).alias("key"), F.struct(*fields).alias(p))
    met = parts["b"].join(parts["o"], "key", "full_outer").join(parts["t"], "key", "full_outer")
    gone = (F.col("b").isNotNull() & (F.col("o").isNull() | F.col("t").isNull())) | (F.col("o").isNull() & F.col("t").isNull())

    def field(name: str):
        b, o, t = (F.col(f"{p}.{name}") for p in "bot")
        both = F.col("o").isNotNull() & F.col("t").isNotNull()
        return F.when(both & F.col("b").isNotNull() & o.eqNullSafe(b), t).when(F.col("o").isNotNull(), o).otherwise(t).alias(name)

    return met.filter(~gone).select(F.col("key").alias(key), *[field(f) for f in fields])


def overlay(facts: DataFrame) -> DataFrame:
    """The canonical fact of each node among its owners': a located one, then the richest, then the first owner."""
    rich = sum(F.col(c).isNotNull().cast("int") for c in ("docstring", "signature", "source_line"))
    order = Window.partitionBy("node_id").orderBy(F.when(F.coalesce("source_file", F.lit("")) != "", 0).otherwise(1), F.desc(rich), "owner")
    return facts.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def same_type_pairs(nodes: DataFrame) -> DataFrame:
    """(source, target): nodes of equal names in different repositories, each linked to the name's first of another.

    A chain through the names' firsts, not all pairs: a node of the first repository's first is linked to
    the first of the next repository.
    """
    named = nodes.select("id", "repo", F.lower("label").alias("name"))
    per_repo = named.groupBy("name", "repo").agg(F.min("id").alias("id"))
    later = F.lead("id").over(Window.partitionBy("name").orderBy("repo"))
    return per_repo.withColumn("target", later).filter("target IS NOT NULL").select(F.col("id").alias("source"), "target", "name")


def cross_repo_calls(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """(source, target): unresolved calls (source, repo, name) bound to the one definition in another repository."""
    # Calls meet one row of their name instead of each definition: its outermost ids, and those outside these ids' repositories.
    homes = definitions.filter("id IS NOT NULL AND repo IS NOT NULL").groupBy(F.lower("name").alias("key"), F.col("repo").alias("home")).agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    firsts = Window.partitionBy("key")
    ranked = homes.withColumn("l", F.row_number().over(firsts.orderBy("lo", "home"))).withColumn("h", F.row_number().over(firsts.orderBy(F.desc("hi"), "home")))
    nth = lambda order, k, c: F.max(F.when(F.col(order) == k, F.col(c))).alias(f"{c}_{order}{k}")
    ends = ranked.filter("l <= 2 OR h <= 2").groupBy("key").agg(*[nth("l", k, c) for k in (1, 2) for c in ("home", "lo")], *[nth("h", k, c) for k in (1, 2) for c in ("home", "hi")])
    called = calls.filter("repo IS NOT NULL").select("source", "repo", F.lower("name").alias("key")).join(ends, "key")
    low, high = (F.when(F.col(f"home_{o}1") != F.col("repo"), F.col(f"{c}_{o}1")).otherwise(F.col(f"{c}_{o}2")) for o, c in (("l", "lo"), ("h", "hi")))
    found = called.select("source", "key", low.alias("low"), high.alias("high")).repartition("source", "key")
    one = found.groupBy("source", "key").agg(F.min("low").alias("target"), F.max("high").alias("other"))
    return one.filter("target = other").select("source", "target")


def replace_repo(graph: DataFrame, repo: str, rows: DataFrame) -> DataFrame:
    """``graph`` with all rows of ``repo`` replaced; with empty ``rows``, removed."""
    return graph.filter(~F.col("repo").eqNullSafe(F.lit(repo))).unionByName(rows.withColumn("repo", F.lit(repo)))


def manifest_diff(old: DataFrame, new: DataFrame, path: str = "file_path", digest: str = "content_hash") -> DataFrame:
    """(path, status): new, changed, unchanged or removed files of two manifests."""
    a, b = old.select(path, F.col(digest).alias("was")), new.select(path, F.col(digest).alias("now"))
    status = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("was") == F.col("now"), "unchanged").otherwise("changed")
    return a.join(b, path, "full_outer").select(path, status.alias("status"))


def update_manifest(old: DataFrame, new: DataFrame, deferred: DataFrame, path: str = "file_path") -> DataFrame:
    """The manifest after a run: new rows replace old ones, files that are gone go, deferred files stay as they were."""
    seen = new.join(deferred.select(path), path, "left_anti")
    held = old.join(deferred.select(path), path, "left_semi").join(new.select(path), path, "left_semi")
    return seen.unionByName(held)

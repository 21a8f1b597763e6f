"""Traversals: balls, impact, call flows, paths, ranks and cycles, as loops of frontier joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from weft.functions.evidence import IMPACT, meets_detail, passes_floor, strength
from weft.plans.runtime import cut, stored


def neighbours(edges: DataFrame, directed: bool = False, least: float = 0.0, floor: float = 0.0, relations: Sequence[str] | None = None) -> DataFrame:
    """(a, b, relation, strength) of the edges that qualify, in both directions unless ``directed``."""
    label, score = F.col("confidence"), F.col("confidence_score")
    kept = edges.filter(meets_detail(label, score, least) & passes_floor(label, score, floor))
    if relations is not None:
        kept = kept.filter(F.col("relation").isin(*relations))
    out = kept.select(F.col("source").alias("a"), F.col("target").alias("b"), "relation", strength(label, score).alias("strength"))
    return out if directed else out.unionByName(out.select(F.col("b").alias("a"), F.col("a").alias("b"), "relation", "strength"))


#: Rows of a frontier up to which it is sent to every executor, so that a hop doesn't shuffle the edges.
BROADCAST_FRONTIER = 100_000


def _light(frontier: DataFrame, n: int) -> DataFrame:
    """A stored frontier of ``n`` rows, to be broadcast if it is small; a larger one is joined by shuffle."""
    return F.broadcast(frontier) if n <= BROADCAST_FRONTIER else frontier


def bfs(seeds: DataFrame, near: DataFrame, depth: int) -> DataFrame:
    """(id, distance) of what ``near`` (a, b) reaches from the seeds' ``id`` in at most ``depth`` hops.

    Each round joins the last round's nodes alone and leaves out those that were seen. The edges are
    computed once.
    """
    seen = cut(seeds.select("id").distinct().withColumn("distance", F.lit(0)))
    frontier, n = seen, seen.count()
    total = n
    pairs = cut(near.select("a", "b"))
    for hop in range(1, depth + 1):
        found = pairs.join(_light(frontier.select(F.col("id").alias("a")), n), "a").select(F.col("b").alias("id")).distinct()
        frontier = cut(found.join(_light(seen.select("id"), total), "id", "left_anti").withColumn("distance", F.lit(hop)))
        n = frontier.count()
        if not n:
            break
        total += n
        seen = seen.unionByName(frontier)
    return seen


def ball(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 2, **which) -> tuple[DataFrame, DataFrame]:
    """The nodes within ``depth`` hops, with distance, and the qualifying edges among them."""
    reached = bfs(seeds, neighbours(edges, **which), depth)
    label, score = F.col("confidence"), F.col("confidence_score")
    kept = edges.filter(meets_detail(label, score, which.get("least", 0.0)) & passes_floor(label, score, which.get("floor", 0.0)))
    inner = kept.join(reached.select(F.col("id").alias("source")), "source", "left_semi").join(
        reached.select(F.col("id").alias("target")), "target", "left_semi"
    )
    return nodes.join(reached, "id"), inner


def dfs_order(seeds: list[str], near: DataFrame, depth: int, limit: int = 50_000) -> list[str]:
    """Depth-first order with a depth cut; neighbours in order of their ids, and no second visits.

    The order is sequential, so it runs on the driver over the breadth-first ball, which holds all that
    it can visit. A ball of over ``limit`` pairs is an error rather than a sample.
    """
    spark = near.sparkSession
    reached = bfs(spark.createDataFrame([(s,) for s in seeds], "id string"), near, depth)
    pairs = near.select("a", "b").distinct().join(reached.select(F.col("id").alias("a")), "a", "left_semi")
    rows = pairs.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"the ball has over {limit} pairs; lower the depth")
    after: dict[str, list[str]] = {}
    for row in rows:
        after.setdefault(row["a"], []).append(row["b"])
    stack, seen, order = [(s, 0) for s in reversed(sorted(set(seeds)))], set(), []
    while stack:
        node, d = stack.pop()
        if node in seen:
            continue
        seen.add(node)
        order.append(node)
        if d < depth:
            stack += [(b, d + 1) for b in sorted(after.get(node, ()), reverse=True) if b not in seen]
    return order


def blast_radius(nodes: DataFrame, edges: DataFrame, seed: str, depth: int = 3, relation: str | None = None) -> DataFrame:
    """(id, label, depth, relation, provenance, via_file) of what a change of ``seed`` reaches backwards.

    Seeds are the node, its members by ``contains`` or ``method``, and the node of its bare name. Of
    the edges that reach a node first, the one of the smallest (target, relation, provenance, file) is kept.
    """
    if relation is not None and relation not in IMPACT:
        raise ValueError(f"unsupported relation {relation!r}; one of {', '.join(IMPACT)}")
    allowed = (relation,) if relation else IMPACT
    bare = seed.rsplit("::", 1)[-1]
    own = nodes.filter(F.col("id").isin(seed, bare)).select("id")
    members = edges.filter((F.col("source") == seed) & F.col("relation").isin("contains", "method")).select(F.col("target").alias("id"))
    seen = cut(own.unionByName(members).distinct())
    frontier, hits = seen, None
    n = total = seen.count()
    impact = cut(edges.filter(F.col("relation").isin(*allowed)).select("source", "target", "relation", "confidence", "source_file"))
    for hop in range(1, depth + 1):
        into = impact.join(_light(frontier.select(F.col("id").alias("target")), n), "target")
        first = F.min(F.struct("target", "relation", "confidence", "source_file")).alias("e")
        fresh = into.groupBy(F.col("source").alias("id")).agg(first).join(_light(seen, total), "id", "left_anti")
        fresh = cut(fresh.select("id", F.lit(hop).alias("depth"), "e.relation", F.col("e.confidence").alias("provenance"), F.col("e.source_file").alias("via")))
        hits = fresh if hits is None else hits.unionByName(fresh)
        n = fresh.count()
        if not n:
            break
        total += n
        frontier = fresh.select("id")
        seen = seen.unionByName(frontier)
    named = nodes.select("id", "label", "source_file")
    out = hits.join(named, "id", "left")
    via = F.when(F.coalesce("via", F.lit("")) != "", F.col("via")).otherwise(F.coalesce("source_file", F.lit("")))
    return out.select("id", F.coalesce("label", "id").alias("label"), "depth", "relation", "provenance", via.alias("via_file"))


def resolve_seed(nodes: DataFrame, name: str, shown: int = 10) -> str:
    """The id that a name stands for: an id, a label, a bare name, a label in any case, or the end of a path.

    The first of these that any node matches decides; stubs come last in it. Several located nodes of the
    deciding kind are an error that lists them, as is a name that nothing matches. One read of a few rows.
    """
    bare = name.strip().lstrip(".").removesuffix("()").lower()
    plain = F.lower(F.regexp_replace(F.regexp_replace("label", r"\(\)$", ""), r"^\.+", ""))
    path = name.replace("\\", "/").lstrip("/")
    tier = (
        F.when(F.col("id") == name, 0).when(F.col("label") == name, 1).when(F.lower("id").endswith("::" + bare) | (plain == bare), 2)
        .when(F.lower("label") == name.lower(), 3).when((F.col("source_file") == path) | F.col("source_file").endswith("/" + path), 4)
    )
    stub = (F.col("file_type") == "stub").cast("int")
    # The node of a file itself stands before what the file contains.
    found = nodes.withColumn("tier", tier).filter("tier IS NOT NULL").withColumn("stub", stub).withColumn("n", F.length("id"))
    rows = found.orderBy("stub", "tier", "n", "id").select("id", "tier", "stub", "source_file").limit(shown + 1).collect()
    if not rows:
        raise LookupError(f"no node {name!r}")
    best = [r for r in rows if (r["stub"], r["tier"]) == (rows[0]["stub"], rows[0]["tier"])]
    if len(best) > 1 and rows[0]["tier"] != 4 and not rows[0]["stub"]:
        raise LookupError(f"{name!r} is ambiguous: {', '.join(r['id'] for r in best[:shown])}")
    if rows[0]["tier"] == 4 and len({r["source_file"] for r in best}) > 1:
        raise LookupError(f"{name!r} is the end of several paths: {', '.join(sorted({r['source_file'] for r in best})[:shown])}")
    return best[0]["id"]


def call_flow(edges: DataFrame, seed: str, depth: int = 3, direction: str = "out", relation: str = "calls") -> DataFrame:
    """(source, target, depth) of the ``relation`` edges that a walk from the seed crosses."""
    calls = edges.filter(F.col("relation") == relation).select("source", "target").distinct()
    forward = calls.select(F.col("source").alias("a"), F.col("target").alias("b"), "source", "target")
    backward = calls.select(F.col("target").alias("a"), F.col("source").alias("b"), "source", "target")
    near = {"out": forward, "in": backward}.get(direction) or forward.unionByName(backward)
    start = edges.sparkSession.createDataFrame([(seed,)], "id string")
    reached = bfs(start, near, depth - 1) if depth > 1 else start.withColumn("distance", F.lit(0))
    return near.join(reached.select(F.col("id").alias("a"), "distance"), "a").groupBy("source", "target").agg((F.min("distance") + 1).alias("depth"))


def mermaid(flow: DataFrame, limit: int = 500) -> str:
    """A flow chart of the first ``limit`` edges, in order of depth and ids."""
    rows = flow.orderBy("depth", "source", "target").limit(limit).collect()
    names = {n: f"n{k}" for k, n in enumerate(dict.fromkeys(x for r in rows for x in (r["source"], r["target"])))}
    quoted = {n: '"' + n.replace('"', "'") + '"' for n in names}
    lines = [f"    {names[n]}[{quoted[n]}]" for n in names] + [f"    {names[r['source']]} --> {names[r['target']]}" for r in rows]
    return "\n".join(["flowchart LR", *lines])


def explain(nodes: DataFrame, edges: DataFrame, node: str, k: int = 20) -> DataFrame:
    """The node's neighbours, one edge each: outgoing before incoming, then the strongest; the strongest first."""
    s = strength(F.col("confidence"), F.col("confidence_score"))
    own = edges.filter(((F.col("source") == node) | (F.col("target") == node)) & (F.col("source") != F.col("target")))
    ends = own.select(
        F.when(F.col("source") == node, F.col("target")).otherwise(F.col("source")).alias("id"),
        F.when(F.col("source") == node, 0).otherwise(1).alias("side"), "relation", s.alias("strength"),
    )
    first = ends.groupBy("id").agg(F.min(F.struct("side", (-F.col("strength")).alias("weak"), "relation")).alias("e"))
    out = first.select("id", F.when(F.col("e.side") == 0, "out").otherwise("in").alias("direction"), "e.relation", (-F.col("e.weak")).alias("strength"))
    return out.join(nodes.select("id", "label"), "id").orderBy(F.desc("strength"), "relation", "id").limit(k)


def shortest_path(edges: DataFrame, source: str, target: str, directed: bool = False, depth: int = 32, most_routes: int = 1_000_000, **which) -> DataFrame:
    """One row (path, hops, weakest, routes) of the conservative shortest path, or none.

    Of the routes with fewest hops, the one whose weakest hop is weakest is told, the first by its ids
    if tied, so that a path isn't praised for its best reading. A hop is as strong as its strongest
    parallel edge. Layer by layer, each node keeps its weakest hop, its route and the number of routes.
    Layers hold the nodes on shortest routes alone: these are found first, from both ends at once.
    """
    spark = edges.sparkSession
    none = spark.createDataFrame([], "path array<string>, hops int, weakest double, routes long")
    if source == target:
        return spark.createDataFrame([([source], 0, None, 1)], "path array<string>, hops int, weakest double, routes long")
    with stored(neighbours(edges, True, **which).filter("a <> b").select("a", "b", "strength")) as way:
        back = way.select(F.col("b").alias("a"), F.col("a").alias("b"), "strength")
        near, into = (way, back) if directed else (way.unionByName(back),) * 2
        ahead, behind = _layers(near, into, source, target, depth)
        if ahead is None:
            return none
        # Hop by hop, the edges between a layer's nodes and the next one's that lead to the target.
        stages = ahead[:-1] + behind[::-1]
        steps, left, n = [], stages[-1][0], stages[-1][1]
        for from_, n_from in stages[-2::-1]:
            step = _met(into.select(F.col("a").alias("b"), F.col("b").alias("a"), "strength"), left, n, "b")
            step = cut(_met(step, from_, n_from, "a").groupBy("a", "b").agg(F.max("strength").alias("hop")))
            left = cut(step.select(F.col("a").alias("id")).distinct())
            n = left.count()
            steps.insert(0, step)
    layer = spark.createDataFrame([(source, 2.0, [source], 1)], "id string, weakest double, path array<string>, routes long")
    for step in steps:
        step = step.join(layer, step["a"] == layer["id"])
        step = step.select("b", F.least("weakest", "hop").alias("weakest"), F.concat("path", F.array("b")).alias("path"), "routes")
        best = step.groupBy("b").agg(F.min(F.struct("weakest", "path")).alias("m"), F.least(F.sum("routes"), F.lit(most_routes)).alias("routes"))
        layer = cut(best.select(F.col("b").alias("id"), "m.weakest", "m.path", "routes"))
    return layer.select("path", F.lit(len(steps)).alias("hops"), "weakest", "routes")


def _met(pairs: DataFrame, nodes: DataFrame, n: int, side: str) -> DataFrame:
    """The rows of ``pairs`` whose ``side`` is among the ``n`` stored nodes."""
    return pairs.join(_light(nodes.select(F.col("id").alias(side)), n), side, "left_semi")


def _layers(near: DataFrame, into: DataFrame, source: str, target: str, depth: int):
    """Layers of (nodes, their number) from the source, and back from the target, up to one that they share; or None twice.

    The smaller end goes on, so that a hub on one side needn't be spread if the other gets there. The
    last layer from the source and from the target is the shared one.
    """
    one = lambda name: (cut(near.sparkSession.createDataFrame([(name,)], "id string")), 1)
    ends = [{"near": near, "layers": [one(source)]}, {"near": into, "layers": [one(target)]}]
    for _ in range(depth):
        mine, other = sorted(ends, key=lambda e: e["layers"][-1][1])
        last, n = mine["layers"][-1]
        found = _met(mine["near"], last, n, "a").select(F.col("b").alias("id")).distinct()
        for old, n_old in mine["layers"]:
            found = found.join(_light(old, n_old), "id", "left_anti")
        found = cut(found)
        n = found.count()
        if not n:
            return None, None
        mine["layers"].append((found, n))
        far, n_far = other["layers"][-1]
        shared = cut(found.join(_light(far, n_far), "id", "left_semi"))
        if both := shared.count():
            mine["layers"][-1] = other["layers"][-1] = (shared, both)
            return ends[0]["layers"], ends[1]["layers"]
    return None, None


def pagerank(weights: DataFrame, vertices: DataFrame, damping: float = 0.85, rounds: int = 30) -> DataFrame:
    """(file, rank) over undirected ``weights`` (file_a, file_b, weight); what has no links shares its mass with all."""
    both = weights.unionByName(weights.select(F.col("file_b").alias("file_a"), F.col("file_a").alias("file_b"), "weight"))
    out = both.groupBy("file_a").agg(F.sum("weight").alias("total"))
    share = cut(both.join(out, "file_a").select("file_a", "file_b", (F.col("weight") / F.col("total")).alias("share")))
    linked = share.select(F.col("file_a").alias("file")).distinct().withColumn("linked", F.lit(True))
    files = cut(vertices.select("file").distinct().join(linked, "file", "left"))
    n = files.count()
    if not n:
        return files.select("file", F.lit(0.0).alias("rank"))
    rank = files.withColumn("rank", F.lit(1.0 / n))
    for _ in range(rounds):
        given = share.join(rank.select(F.col("file").alias("file_a"), "rank"), "file_a").groupBy(F.col("file_b").alias("file")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        loose = rank.filter("linked IS NULL").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        new = F.lit((1 - damping) / n + damping * loose / n) + damping * F.coalesce("got", F.lit(0.0))
        rank = cut(files.join(given, "file", "left").select("file", "linked", new.alias("rank")))
    return rank.select("file", "rank")


def _spread(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """The smallest label that reaches each node along ``pairs`` (a, b)."""
    while True:
        came = pairs.join(labels.select(F.col("id").alias("a"), "label"), "a").groupBy(F.col("b").alias("id")).agg(F.min("label").alias("came"))
        new = cut(labels.join(came, "id", "left").select("id", F.least("label", F.coalesce("came", "label")).alias("label"), (F.col("came") < F.col("label")).alias("moved")))
        labels = new.select("id", "label")
        if new.filter("moved").isEmpty():
            return labels


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of the nodes of ``edges`` (a, b) on a cycle; component is its smallest node.

    Nodes without a way in or out are trimmed. The smallest label is spread forwards; the nodes that
    bear it and reach its owner are a component. These go, and the rest begins again.
    """
    left = cut(edges.filter("a <> b").select("a", "b").distinct())
    found = None
    while True:
        while True:
            n = left.count()
            left = cut(left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi"))
            if left.count() == n:
                break
        if not n:
            break
        ids = left.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("label", F.col("id"))
        forward = _spread(cut(ids), left)
        fa, fb = (forward.select(F.col("id").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
        same = cut(left.join(fa, "a").join(fb, "b").filter("la = lb").select("a", "b"))
        backward = _spread(cut(ids), same.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumnRenamed("label", "back")
        whole = cut(forward.join(backward, "id").filter("label = back").select("id", F.col("label").alias("component")))
        found = whole if found is None else found.unionByName(whole)
        gone = whole.select("id")
        left = cut(left.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti"))
    if found is None:
        return edges.sparkSession.createDataFrame([], "id string, component string")
    sized = found.groupBy("component").count().filter("count > 1").select("component")
    return found.join(sized, "component", "left_semi").select("id", "component")


def file_cycles(nodes: DataFrame, edges: DataFrame, relations: Sequence[str] = ("calls", "imports"), k: int = 5) -> DataFrame:
    """(component, size, files) of the largest groups of files that depend on each other, by extracted edges only."""
    owned = nodes.filter(~F.col("file_type").isin("stub", "reference") & (F.coalesce("source_file", F.lit("")) != ""))
    s, t = (owned.select(F.col("id").alias(x), F.col("source_file").alias(y)) for x, y in (("source", "a"), ("target", "b")))
    kept = edges.filter(F.col("relation").isin(*relations) & (F.col("confidence") == "EXTRACTED")).select("source", "target")
    found = strong_components(kept.join(s, "source").join(t, "target").select("a", "b"))
    grouped = found.groupBy("component").agg(F.count("*").alias("size"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("files"))
    return grouped.orderBy(F.desc("size"), "component").limit(k)


def consumers(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(seed, id, depth, weakest, chain): by seed, the nearest consumer chain backwards, of those the strongest.

    The chain lists the ids from the consumer to the seed; its evidence is its weakest hop.
    """
    s = strength(F.col("confidence"), F.col("confidence_score"))
    back = edges.filter(F.col("relation").isin(*IMPACT)).groupBy("source", "target").agg(F.max(s).alias("hop"))
    now = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth"), F.lit(1.0).alias("weakest"), F.array("id").alias("chain"))
    out = seen = cut(now)
    for hop in range(1, depth + 1):
        step = back.join(now.withColumnRenamed("id", "target"), "target").select(
            "seed", F.col("source").alias("id"), F.least("weakest", "hop").alias("weakest"), F.concat(F.array("source"), "chain").alias("chain")
        )
        best = step.groupBy("seed", "id").agg(F.min(F.struct((-F.col("weakest")).alias("w"), "chain")).alias("m"))
        now = best.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").select("seed", "id", F.lit(hop).alias("depth"), (-F.col("m.w")).alias("weakest"), "m.chain")
        now = cut(now)
        if now.isEmpty():
            break
        out = seen = seen.unionByName(now)
    return out.filter("depth > 0")

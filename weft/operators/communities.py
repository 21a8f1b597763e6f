"""Communities by label propagation, within connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from weft.functions.evidence import edge_weight
from weft.plans.runtime import as_planned, cut

#: Fixed values of the passes.
ROUNDS, SPLIT_SHARE, SPLIT_LEAST, SPLIT_PASSES, LEAST_SIZE = 100, 0.25, 10, 3, 3
#: Weights as whole numbers, so that no sum depends on its order.
SCALE = 1_000_000
#: Links, in both directions, of a task of a sweep.
TASK_LINKS = 500_000


def link_weights(edges: DataFrame) -> DataFrame:
    """(a, b, weight) of undirected links, a < b: summed evidence in whole numbers; learned edges don't count."""
    w = F.round(edge_weight(F.col("confidence"), F.col("confidence_score")) * SCALE).cast("long")
    kept = edges.filter((F.col("relation") != "learned") & (F.col("source") != F.col("target")))
    return kept.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.sum(w).alias("weight"))


def hubs(links: DataFrame, floor: int = 12, factor: float = 4.0) -> DataFrame:
    """(id) of the nodes with so many links, at least ``floor`` and ``factor`` times the mean, that they'd glue communities."""
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    mean = ends.agg(F.avg("n").alias("mean")).scalar()
    return ends.filter(F.col("n") >= F.greatest(F.lit(floor), factor * mean)).select("id")


def detect_without_hubs(nodes: DataFrame, edges: DataFrame, **how) -> DataFrame:
    """As ``detect``, of the graph without its hubs; each hub then joins the community that it is tied to most."""
    links = cut(link_weights(edges))
    glue = cut(hubs(links))
    left = edges
    for side in ("source", "target"):
        left = left.join(glue.select(F.col("id").alias(side)), side, "left_anti")
    found = cut(detect(nodes.join(glue, "id", "left_anti"), left, **how))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    pull = both.join(glue.select(F.col("id").alias("a")), "a", "left_semi").join(found.select(F.col("id").alias("b"), "community"), "b")
    pull = pull.groupBy(F.col("a").alias("id"), "community").agg(F.sum("weight").alias("weight"))
    tied = pull.groupBy("id").agg(F.min(F.struct((-F.col("weight")).alias("w"), "community"))["community"].alias("community"))
    alone = glue.join(tied, "id", "left_anti").join(nodes.select("id"), "id", "left_semi")
    first = (F.coalesce(found.agg(F.max("community").alias("m")).scalar(), F.lit(-1)) + F.row_number().over(Window.orderBy("id"))).cast("long")
    return found.select("id", F.col("community").cast("long")).unionByName(tied.select("id", F.col("community").cast("long"))).unionByName(alone.select("id", first.alias("community")))


def detect(nodes: DataFrame, edges: DataFrame, resolution: float = 0.0) -> DataFrame:
    """(id, community): communities, numbered by their first member in order of ids.

    A node only takes a label that holds at least ``resolution`` of the weight around it: at 0 the
    heaviest wins whatever its share, at 1 all neighbours have to agree.

    Labels are propagated in rounds, all nodes at once; a node only takes a smaller label or, every other
    round, a heavier one. Large communities are split and small ones merged. It is one way at every
    size: nothing is gathered but a community's number.
    """
    links = cut(link_weights(edges))
    ids = cut(nodes.select("id"))
    found = _rounds(links, ids.count(), resolution)
    alone = ids.join(found.select("id"), "id", "left_anti").withColumn("lead", F.col("id"))
    every = cut(found.unionByName(alone))
    # Communities are numbered by their leads: first members in order of ids.
    leads = cut(every.select("lead").distinct())
    return every.join(_numbered(leads), "lead").select("id", "community")


def _numbered(leads: DataFrame, kind: str = "int") -> DataFrame:
    """(lead, community): the place of each lead in order, from ranges whose counts are summed first."""
    dealt = cut(leads.repartitionByRange("lead").withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("part", F.coalesce(ahead, F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("lead"))
    return dealt.withColumn("nth", nth).join(F.broadcast(starts), "part").select("lead", (F.col("start") + F.col("nth") - 1).cast(kind).alias("community"))


def _labels(links: DataFrame, resolution: float = 0.0, rounds: int = ROUNDS) -> DataFrame:
    """(id, lead, swept) of label propagation in rounds, until no node would move; a community's lead is its first member.

    ``swept`` is the lead again, for those who change ``lead``. Nodes are numbered in order of ids, and lie
    with the links that they send labels along, so that a round shuffles nothing but what nodes are told.
    Once all labels are as they were before, rounds would repeat, and the last one's labels are known.
    """
    spark = links.sparkSession
    numbers = cut(_numbered(cut(links.select(F.explode(F.array("a", "b")).alias("lead")).distinct()), "long").toDF("id", "number"))
    one = cut(links.join(numbers.toDF("a", "na"), "a").join(numbers.toDF("b", "nb"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"), "weight"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-2 * one.count() // TASK_LINKS))
    with as_planned(spark):
        both = cut(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).repartition(tasks, "b"))
        label = cut(numbers.select(F.col("number").alias("id")).repartition(tasks, "id").withColumn("lead", F.col("id")))
        past: dict[tuple, int] = {}
        states = []
        for k in range(rounds):
            if k:
                told = both.join(label.toDF("b", "lead").hint("shuffle_hash"), "b").select("a", "lead", "weight").repartition(tasks, "a")
            else:
                told = both.select(F.col("b").alias("a"), F.col("a").alias("lead"), "weight")
            tally = told.groupBy("a", "lead").agg(F.sum("weight").alias("weight"))
            best = tally.groupBy(F.col("a").alias("id")).agg(F.min(F.struct((-F.col("weight")).alias("w"), "lead")).alias("m"), F.sum("weight").alias("total"))
            pulled = (F.col("m.lead") != F.col("lead")) & (-F.col("m.w") >= resolution * F.col("total"))
            moves = pulled & ((F.col("m.lead") < F.col("lead")) | F.lit(k % 2 == 1))
            new = cut(label.join(best.hint("shuffle_hash"), "id").select("id", F.when(moves, F.col("m.lead")).otherwise(F.col("lead")).alias("lead"), pulled.alias("pulled")))
            label = new.select("id", "lead")
            states.append(label)
            row = new.agg(F.count_if("pulled").alias("n"), F.sum(F.xxhash64("id", "lead").cast("decimal(38,0)")).alias("h")).first()
            if not row["n"]:
                break
            # Rounds of one parity do the same to the same labels.
            before = past.setdefault((k % 2, row["n"], row["h"]), k)
            if before < k:
                label = states[before + (rounds - 1 - before) % (k - before)]
                break
    own, lead = numbers.select(F.col("number").alias("id"), F.col("id").alias("own")), numbers.select(F.col("number").alias("lead"), F.col("id").alias("name"))
    named = _led(label).join(own, "id").join(lead, "lead")
    return cut(named.select(F.col("own").alias("id"), F.col("name").alias("lead"), F.col("name").alias("swept")))


def _led(label: DataFrame) -> DataFrame:
    firsts = label.groupBy("lead").agg(F.min("id").alias("first"))
    return cut(label.join(firsts, "lead").select("id", F.col("first").alias("lead")))


def _rounds(links: DataFrame, n_all: int, resolution: float = 0.0) -> DataFrame:
    """(id, lead) of the linked nodes: a sweep, splits of what is too large, merges of what is too small.

    Several small communities join their neighbours at once: those that come before all small ones next to them.
    """
    links = cut(links)
    label = _labels(links, resolution)
    swept = label.select("id", F.col("swept").alias("fresh"))
    label = label.select("id", "lead")

    def ends(of: DataFrame) -> DataFrame:
        """The links with their ends' leads, la and lb."""
        return links.join(of.toDF("a", "la"), "a").join(of.toDF("b", "lb"), "b")

    for _ in range(SPLIT_PASSES):
        sizes = label.groupBy("lead").agg(F.count("*").alias("n"))
        large = cut(sizes.filter((F.col("n") >= SPLIT_LEAST) & (F.col("n") > SPLIT_SHARE * n_all)).select("lead"))
        if large.isEmpty():
            break
        # A community that no link leaves was swept as it is, so that this needn't be done again.
        left = ends(label).filter("la <> lb").select(F.explode(F.array("la", "lb")).alias("lead"))
        linked = cut(large.join(left.distinct(), "lead", "left_semi"))
        members = label.join(large, "lead", "left_semi")
        fresh = members.join(linked, "lead", "left_anti").join(swept, "id").select("id", "fresh")
        if not linked.isEmpty():
            inner = ends(label.join(linked, "lead", "left_semi")).filter("la = lb").select("a", "b", "weight")
            fresh = fresh.unionByName(_labels(inner, resolution).select("id", F.col("lead").alias("fresh")))
        split = cut(members.join(fresh, "id", "left").select("id", "lead", F.coalesce("fresh", "id").alias("fresh")))
        parted = split.groupBy("lead").agg(F.countDistinct("fresh").alias("n")).filter("n > 1")
        if parted.isEmpty():
            break
        label = cut(label.join(split.select("id", "fresh"), "id", "left").select("id", F.coalesce("fresh", "lead").alias("lead")))
    while True:
        small = cut(label.groupBy("lead").agg(F.count("*").alias("n")).filter(F.col("n") < LEAST_SIZE).select("lead"))
        if small.isEmpty():
            return label
        across = ends(label).filter("la <> lb")
        across = across.select(F.col("la").alias("lead"), F.col("lb").alias("other"), "weight").unionByName(across.select(F.col("lb").alias("lead"), F.col("la").alias("other"), "weight"))
        pull = cut(across.join(small, "lead", "left_semi").groupBy("lead", "other").agg(F.sum("weight").alias("weight")))
        waits = pull.filter("other < lead").join(small.select(F.col("lead").alias("other")), "other", "left_semi").select("lead").distinct()
        moves = pull.join(waits, "lead", "left_anti").groupBy("lead").agg(F.min(F.struct((-F.col("weight")).alias("w"), "other"))["other"].alias("to"))
        moves = cut(moves)
        if moves.isEmpty():
            return label
        label = _led(label.join(moves, "lead", "left").select("id", F.coalesce("to", "lead").alias("lead")))


def stable_labels(old: DataFrame, new: DataFrame, labels: DataFrame) -> DataFrame:
    """(community, label): labels of old communities that share most members, on both sides, with a new one."""
    a = old.groupBy(F.col("community").alias("o")).agg(F.count("*").alias("no"))
    b = new.groupBy(F.col("community").alias("c")).agg(F.count("*").alias("nc"))
    met = old.select("id", F.col("community").alias("o")).join(new.select("id", F.col("community").alias("c")), "id").groupBy("o", "c").agg(F.count("*").alias("both"))
    major = met.join(a, "o").join(b, "c").filter((2 * F.col("both") > F.col("no")) & (2 * F.col("both") > F.col("nc")))
    return major.join(labels.select(F.col("community").alias("o"), "label"), "o").select(F.col("c").alias("community"), "label")


def name_communities(members: DataFrame) -> DataFrame:
    """(community, name): the module that most different files of a community share; code before prose, then the first."""
    stem = F.regexp_replace(F.element_at(F.split("source_file", "/"), -1), r"\.[^.]*$", "")
    module = F.when(F.col("source_file").contains("/"), F.element_at(F.split("source_file", "/"), -2)).otherwise(stem)
    votes = members.filter(F.coalesce("source_file", F.lit("")) != "").groupBy("community", (F.col("file_type") == "code").alias("is_code"), module.alias("module")).agg(F.countDistinct("source_file").alias("files"))
    order = Window.partitionBy("community").orderBy(F.desc("is_code"), F.desc("files"), "module")
    return votes.withColumn("nth", F.row_number().over(order)).filter("nth = 1").select("community", F.col("module").alias("name"))

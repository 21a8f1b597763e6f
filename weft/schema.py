"""Schemas of the graph's relations, and validation of what is about to be written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

TYPES = {"string": StringType(), "int": IntegerType(), "long": LongType(), "double": DoubleType(), "strings": ArrayType(StringType(), False)}


def _struct(fields: str) -> StructType:
    """A schema from "name type" pairs; "!" after a type says that there are no nulls. Needs no session."""
    pairs = (field.split() for field in fields.split(","))
    return StructType([StructField(name, TYPES[kind.rstrip("!")], not kind.endswith("!")) for name, kind in pairs])


NODES = _struct(
    "id string!, label string!, file_type string!, source_file string!, source_line int, docstring string, signature string, "
    "community long, degree_centrality double, metadata string, repo string"
)
EDGES = _struct(
    "source string!, target string!, relation string!, confidence string!, confidence_score double, source_file string!, "
    "source_line int, context string"
)
HYPEREDGES = _struct("id string!, label string!, nodes strings!, relation string!, confidence string!, confidence_score double, source_file string!")
#: Labels that edges may carry.
CONFIDENCES = ("DECLARED", "EXTRACTED", "RESOLVED", "INFERRED", "SEMANTIC", "AMBIGUOUS")
#: Nodes whose name was never bound to a definition.
SPECULATIVE = ("stub", "reference")


def node_violations(nodes: DataFrame) -> DataFrame:
    """(rule, subject) of every node that may not be written: empty id, label or type, or a repeated id."""
    rules = {
        "empty id": F.coalesce(F.trim("id"), F.lit("")) == "",
        "empty label": F.coalesce(F.trim("label"), F.lit("")) == "",
        "empty file type": F.coalesce(F.trim("file_type"), F.lit("")) == "",
        "null locus": F.col("source_file").isNull(),
    }
    broken = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]), lambda r: r.isNotNull())
    single = nodes.select(F.explode(broken).alias("rule"), F.col("id").alias("subject"))
    repeated = nodes.groupBy("id").count().filter("count > 1").select(F.lit("repeated id").alias("rule"), F.col("id").alias("subject"))
    return single.unionByName(repeated)


def edge_violations(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(rule, subject) of every edge that may not be written; with ``nodes``, dangling endpoints too."""
    rules = {
        "empty endpoint": (F.coalesce("source", F.lit("")) == "") | (F.coalesce("target", F.lit("")) == ""),
        "empty relation": F.coalesce(F.trim("relation"), F.lit("")) == "",
        "unknown confidence": ~F.coalesce(F.upper("confidence"), F.lit("")).isin(*CONFIDENCES),
        "score out of range": ~F.col("confidence_score").between(0, 1),
    }
    broken = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]), lambda r: r.isNotNull())
    subject = F.concat_ws(" ", "source", "relation", "target").alias("subject")
    found = [edges.select(F.explode(broken).alias("rule"), subject)]
    if nodes is not None:
        ids = nodes.select(F.col("id").alias("known"))
        for side in ("source", "target"):
            lost = edges.join(ids, F.col(side) == F.col("known"), "left_anti")
            found.append(lost.select(F.lit(f"dangling {side}").alias("rule"), subject))
    return reduce(DataFrame.unionByName, found)


def require_valid(violations: DataFrame) -> None:
    """Raise with the number of violations of each rule, if there are any."""
    rows = violations.groupBy("rule").agg(F.count("*").alias("n"), F.min("subject").alias("first")).orderBy("rule").collect()
    if rows:
        raise ValueError("; ".join(f"{r['rule']}: {r['n']} (first: {r['first']})" for r in rows))

"""Extraction records as a graph: identities, stubs, cross-layer links, incremental replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from weft.functions.text import sanitize_docstring, sanitize_label, snake_case
from weft.operators.resolve import bind_unique, mentions
from weft.sources.graph import with_stubs

#: Node types that are stored as they are; others are "document" or "code".
OWN_TYPES = ("rationale", "test", "chunk", "concept", "entity", "pattern", "module", "reference", "package", "mcp_config", "mcp_server", "mcp_command", "mcp_package", "env_var")
PROSE = ("markdown", "pdf", "text", "rst", "html")
#: Files that a package is entered by, the best first.
ENTRY_FILES = ("src/lib.rs", "src/main.rs", "src/index.ts", "src/index.js", "index.ts", "index.js", "__init__.py", "__main__.py", "main.go", "main.py")


def graph_of(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of extraction records; of nodes of one id, that of the first file and line is kept.

    Names are redacted and capped before anything is stored. Speculative nodes have an empty locus.
    """
    node = records.select("language", F.explode("nodes").alias("n")).select("language", "n.*")
    kind = F.when(F.col("node_type").isin(*OWN_TYPES), F.col("node_type")).when(F.col("language").isin(*PROSE), "document").otherwise("code")
    first = Window.partitionBy("id").orderBy("source_file", F.col("source_line").asc_nulls_last(), "label")
    nodes = node.withColumn("nth", F.row_number().over(first)).filter("nth = 1").select(
        "id", sanitize_label(F.col("label")).alias("label"), kind.alias("file_type"), F.coalesce("source_file", F.lit("")).alias("source_file"), "source_line",
        sanitize_docstring(F.col("docstring")).alias("docstring"), "signature", F.lit(None).cast("long").alias("community"),
    )
    edges = records.select(F.explode("edges").alias("e")).select("e.*").filter("coalesce(source, '') <> '' AND coalesce(target, '') <> ''").distinct()
    return nodes, edges


def bind_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls and base types by bare name bound to the one definition of that name: in the file, else anywhere."""
    located = nodes.filter(F.col("file_type").isin("code", "test"))
    bare = F.regexp_replace(F.element_at(F.split("id", "::"), -1), r"__\d+$", "")
    names = located.select(bare.alias("name"), F.col("source_file").alias("file"), F.col("id").alias("target"))
    numbered = edges.withColumn("edge_id", F.xxhash64(*edges.columns))
    loose = numbered.filter(F.col("relation").isin("calls", "inherits")).join(nodes.select(F.col("id").alias("target")), "target", "left_anti")
    wanted = loose.select("edge_id", F.element_at(F.split("target", r"::|\."), -1).alias("name"), F.col("source_file").alias("file"))
    near = bind_unique(wanted, names, ["name", "file"]).select("edge_id", F.col("target").alias("bound"))
    far = bind_unique(wanted.join(near, "edge_id", "left_anti").select("edge_id", "name"), names.select("name", "target"), ["name"]).select("edge_id", F.col("target").alias("bound"))
    bound = near.unionByName(far).dropDuplicates(["edge_id"])
    out = numbered.join(bound, "edge_id", "left")
    is_bound = F.col("bound").isNotNull()
    return out.withColumns({
        "target": F.coalesce("bound", "target"), "confidence": F.when(is_bound, "RESOLVED").otherwise(F.col("confidence")),
        "confidence_score": F.when(is_bound, 0.85).otherwise(F.col("confidence_score")),
    }).select(*edges.columns)


def cross_layer(nodes: DataFrame, edges: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """``edges`` with its cross-layer ones replaced: packages to their entry files, documents to packages, foreign imports."""
    packages = nodes.filter("file_type = 'package'").select("id", "label", "source_file")
    files = nodes.filter("file_type IN ('code', 'document')").groupBy("source_file").agg(F.min_by("id", F.struct(F.length("id"), "id")).alias("file_id"))
    folder = F.regexp_replace("source_file", r"[^/]*$", "")
    entry = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(name).alias("name")) for k, name in enumerate(ENTRY_FILES)])
    guesses = packages.filter("source_file <> ''").select("id", F.explode(entry).alias("e"), folder.alias("folder")).select("id", "e.rank", F.concat("folder", "e.name").alias("source_file"))
    found = guesses.join(files, "source_file").groupBy("id").agg(F.min_by("file_id", "rank").alias("target"))
    link = lambda df, relation, file: df.select(
        F.col("id").alias("source"), "target", F.lit(relation).alias("relation"), F.lit("INFERRED").alias("confidence"), F.lit(0.7).alias("confidence_score"), file.alias("source_file"), F.lit("crosslayer").alias("context")
    )
    new = link(found, "entry_point", F.lit(""))
    if documents is not None:
        named = packages.filter(F.length("label") > 2).groupBy(F.col("label").alias("name")).agg(F.min("id").alias("target"))
        cited = mentions(documents.select(F.col("path").alias("doc"), "text"), named).join(named, "name")
        owners = files.select(F.col("source_file").alias("doc"), F.col("file_id").alias("id"))
        new = new.unionByName(link(cited.join(owners, "doc").withColumnRenamed("doc", "doc_path"), "references", F.col("doc_path")))
    native = nodes.filter("file_type = 'code' AND label LIKE '%()'").select(snake_case(F.regexp_replace("label", r"\(\)$", "")).alias("name"), F.col("id").alias("target"))
    imports = edges.filter("relation = 'imports'").select(F.col("source").alias("id"), snake_case(F.element_at(F.split("target", r"[./:]"), -1)).alias("name"), "source_file")
    foreign = bind_unique(imports.withColumn("edge_id", F.xxhash64("id", "name")), native, ["name"])
    new = new.unionByName(link(foreign, "ffi_binding", F.col("source_file")))
    kept = edges if "context" not in edges.columns else edges.filter("coalesce(context, '') <> 'crosslayer'")
    return kept.unionByName(new.filter("source <> target").distinct(), allowMissingColumns=True)


def replace_files(old: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """``old`` without the rows of the changed or removed ``files`` (file_path), and ``new``'s rows."""
    gone = files.select(F.col("file_path").alias("source_file"))
    return old.join(gone, "source_file", "left_anti").unionByName(new, allowMissingColumns=True)


def complete(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with stubs for unbound endpoints, and without the stubs that nothing refers to any more."""
    real = nodes.filter("file_type <> 'stub'")
    return with_stubs(real, edges), edges


def sanitize_semantic(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a model has proposed, made fit: the first node of an id, known enumerations, no dangling, self or repeated edges."""
    first = Window.partitionBy("id").orderBy("ordinal")
    nodes = nodes.filter("coalesce(id, '') <> ''").withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")
    kinds = ("concept", "entity", "pattern", "module")
    nodes = nodes.withColumn("file_type", F.when(F.col("file_type").isin(*kinds), F.col("file_type")).otherwise("concept"))
    relations = ("depends_on", "implements", "relates_to", "contains", "uses")
    edges = edges.withColumn("relation", F.when(F.col("relation").isin(*relations), F.col("relation")).otherwise("relates_to"))
    for side in ("source", "target"):
        edges = edges.join(nodes.select(F.col("id").alias(side)), side, "left_semi")
    edges = edges.filter("source <> target").withColumn("confidence", F.lit("SEMANTIC"))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.max("confidence_score")))
    return nodes, edges.groupBy("source", "target", "relation", "confidence").agg(score.alias("confidence_score"))

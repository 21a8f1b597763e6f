"""Graphs as JSON, GraphML, Cypher, Markdown and HTML."""

from __future__ import annotations

import html
import json
import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from weft.operators import analytics


def xml_escape(text: Column) -> Column:
    text = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def cypher_string(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.concat(F.lit("'"), F.regexp_replace(text, r"[\r\n]+", " "), F.lit("'"))


def cypher_relation(name: Column) -> Column:
    clean = F.upper(F.regexp_replace(name, r"[^A-Za-z0-9_]", "_"))
    return F.when(clean.rlike("^[A-Z_]"), clean).otherwise(F.concat(F.lit("R_"), clean))


def write_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A folder of JSON lines for nodes and one for edges."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def json_document(nodes: DataFrame, edges: DataFrame) -> str:
    """One JSON document, for graphs that fit the driver; rows arrive a partition at a time."""
    rows = lambda df, *keys: [r.asDict(recursive=True) for r in df.orderBy(*keys).toLocalIterator()]
    return json.dumps({"nodes": rows(nodes, "id"), "edges": rows(edges, "source", "target", "relation")}, ensure_ascii=False, default=str)


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, key, value): the lines of a GraphML document in order of part and key."""
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    head += [f'<key id="{k}" for="{f}" attr.name="{k}" attr.type="string"/>' for f, k in (("node", "label"), ("node", "file_type"), ("edge", "relation"), ("edge", "confidence"))]
    head += ['<graph edgedefault="directed">']
    spark = nodes.sparkSession
    top = spark.createDataFrame([(0, f"{k:03d}", line) for k, line in enumerate(head)] + [(3, "0", "</graph>"), (3, "1", "</graphml>")], "part int, key string, value string")
    x = lambda c: xml_escape(F.coalesce(F.col(c), F.lit("")))
    n = nodes.select(F.lit(1).alias("part"), F.col("id").alias("key"), F.format_string('<node id="%s"><data key="label">%s</data><data key="file_type">%s</data></node>', x("id"), x("label"), x("file_type")).alias("value"))
    e = edges.select(F.lit(2).alias("part"), F.concat_ws(" ", "source", "target", "relation").alias("key"), F.format_string('<edge source="%s" target="%s"><data key="relation">%s</data><data key="confidence">%s</data></edge>', x("source"), x("target"), x("relation"), x("confidence")).alias("value"))
    return top.unionByName(n).unionByName(e)


def cypher_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, key, value): MERGE statements, nodes before edges."""
    s = lambda c: cypher_string(F.coalesce(F.col(c), F.lit("")))
    n = nodes.select(F.lit(1).alias("part"), F.col("id").alias("key"), F.format_string("MERGE (n:Node {id: %s}) SET n.label = %s, n.file_type = %s;", s("id"), s("label"), s("file_type")).alias("value"))
    e = edges.select(F.lit(2).alias("part"), F.concat_ws(" ", "source", "target", "relation").alias("key"), F.format_string("MATCH (a:Node {id: %s}), (b:Node {id: %s}) MERGE (a)-[:%s {confidence: %s}]->(b);", s("source"), s("target"), cypher_relation(F.col("relation")), s("confidence")).alias("value"))
    return n.unionByName(e)


def write_lines(lines: DataFrame, path: str) -> None:
    """Text files whose lines are in order over the files' names."""
    lines.repartitionByRange("part", "key").sortWithinPartitions("part", "key").select("value").write.mode("overwrite").text(path)


def report(nodes: DataFrame, edges: DataFrame) -> str:
    """The counts, hubs, bridges and dead ends of a graph as Markdown; each list is a top-k read."""
    out = ["# Graph report", "", f"{nodes.count()} nodes, {edges.count()} edges", ""]
    for title, frame in (
        ("Diagnosis", analytics.diagnose(nodes, edges).orderBy("what").limit(25)), ("Most connected", analytics.god_nodes(nodes, edges)),
        ("Surprising connections", analytics.surprising_connections(nodes, edges).select("source", "relation", "target", "score")),
        ("Used by nothing", analytics.dead_code(nodes, edges)), ("Hubs", analytics.hub_churn(nodes, edges)),
    ):
        rows = frame.collect()
        out += [f"## {title}", "", "| " + " | ".join(frame.columns) + " |", "|" + " --- |" * len(frame.columns)]
        out += ["| " + " | ".join(str(v).replace("|", "\\|") for v in r) + " |" for r in rows] + [""]
    return "\n".join(out)


def wiki(nodes: DataFrame, edges: DataFrame, members: int = 20, links: int = 12) -> dict[str, str]:
    """An article for each community: its members of highest degree, and what it is linked to; and an index."""
    ranked = nodes.filter("community IS NOT NULL").join(analytics.degrees(edges).select("id", "degree"), "id", "left").fillna(0, ["degree"])
    nth = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "id"))
    top = ranked.withColumn("nth", nth).filter(F.col("nth") <= members).orderBy("community", "nth").collect()
    side = lambda a, b: nodes.select(F.col("id").alias(a), F.col("community").alias(b))
    between = edges.join(side("source", "c"), "source").join(side("target", "d"), "target").filter("c <> d").groupBy("c", "d").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("n"), "d"))
    linked = between.withColumn("nth", nth).filter(F.col("nth") <= links).orderBy("c", "nth").collect()
    pages: dict[str, list[str]] = {}
    for row in top:
        pages.setdefault(f"community-{row['community']}", [f"# Community {row['community']}", "", "## Members", ""]).append(f"- {row['label']} ({row['degree']})")
    for row in linked:
        page = pages.setdefault(f"community-{row['c']}", [])
        page.append(f"- linked to [[community-{row['d']}]] {row['n']} times")
    index = ["# Index", ""] + [f"- [[{name}]]" for name in sorted(pages)]
    return {"index": "\n".join(index), **{name: "\n".join(lines) for name, lines in pages.items()}}


def html_page(nodes: DataFrame, edges: DataFrame, limit: int = 5000) -> str:
    """A page that lists a graph of at most ``limit`` nodes; a larger one is an error."""
    rows = nodes.orderBy("id").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"the graph has over {limit} nodes")
    ids = nodes.select(F.col("id").alias("source"))
    links = edges.join(ids, "source", "left_semi").select("source", "target", "relation").orderBy("source", "target", "relation").toLocalIterator()
    items = "".join(f"<li id='{html.escape(r['id'])}'>{html.escape(r['label'])}</li>" for r in rows)
    arrows = "".join(f"<li>{html.escape(r['source'])} {html.escape(r['relation'])} {html.escape(r['target'])}</li>" for r in links)
    return f"<!DOCTYPE html><meta charset='utf-8'><title>Graph</title><ul>{items}</ul><ul>{arrows}</ul>"


def slug(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-") or "untitled"


def svg(nodes: DataFrame, edges: DataFrame, most_nodes: int = 2000, most_edges: int = 6000, labels: int = 30) -> str:
    """The most connected nodes on arcs by community, and the first edges among them. Top-k reads, laid out on the driver."""
    import math

    ranked = nodes.join(analytics.degrees(edges).select("id", "degree"), "id", "left").fillna(0, ["degree"])
    rows = ranked.orderBy(F.desc("degree"), "id").limit(most_nodes).collect()
    order = sorted(rows, key=lambda r: (r["community"] is None, r["community"] or 0, r["id"]))
    at = {r["id"]: (500 + 450 * math.cos(2 * math.pi * k / len(order)), 500 + 450 * math.sin(2 * math.pi * k / len(order))) for k, r in enumerate(order)}
    ids = nodes.sparkSession.createDataFrame([(i,) for i in at], "id string") if at else nodes.select("id").limit(0)
    inner = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    lines = [f'<line x1="{a[0]:.1f}" y1="{a[1]:.1f}" x2="{b[0]:.1f}" y2="{b[1]:.1f}" stroke="#999"/>' for a, b in (
        (at[r["source"]], at[r["target"]]) for r in inner.orderBy("source", "target", "relation").limit(most_edges).collect())]
    dots = [f'<circle cx="{at[r["id"]][0]:.1f}" cy="{at[r["id"]][1]:.1f}" r="3"/>' for r in order]
    names = [f'<text x="{at[r["id"]][0]:.1f}" y="{at[r["id"]][1]:.1f}" font-size="9">{html.escape(r["label"])}</text>' for r in rows[:labels]]
    return '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 1000 1000">' + "".join(lines + dots + names) + "</svg>"


def vault(nodes: DataFrame, edges: DataFrame, links: int = 50) -> DataFrame:
    """(name, text): a note for each node with links to its strongest neighbours, for readers of linked Markdown."""
    both = edges.select("source", "target", "relation").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "relation"))
    nth = F.row_number().over(Window.partitionBy("source").orderBy("relation", "target"))
    near = both.distinct().withColumn("nth", nth).filter(F.col("nth") <= links)
    line = F.concat(F.lit("- "), "relation", F.lit(" [["), "target", F.lit("]]"))
    grouped = near.groupBy(F.col("source").alias("id")).agg(F.sort_array(F.collect_list(F.struct("nth", line.alias("line")))).alias("lines"))
    text = F.concat_ws("\n", F.concat(F.lit("# "), "label"), F.col("source_file"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    return nodes.join(grouped, "id", "left").select(F.regexp_replace("id", r'[\\/:*?"<>|]', "_").alias("name"), text.alias("text"))

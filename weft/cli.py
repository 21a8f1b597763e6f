"""Command line: build a graph into a store, and ask it."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from weft import sinks
from weft.api import Graph
from weft.plans.store import Store


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="weft", description=__doc__)
    parser.add_argument("--store", required=True, help="folder of the graph's generations")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, *arguments in (
        ("run", "root"), ("query", "question"), ("affected", "node"), ("explain", "node"), ("path", "source", "target"), ("callflow", "node"),
        ("stats",), ("god-nodes",), ("map",), ("health",), ("report",), ("export", "format", "out"), ("cluster",), ("diff", "generation"),
    ):
        command = commands.add_parser(name)
        for argument in arguments:
            command.add_argument(argument)
        if name in ("query", "affected", "callflow"):
            command.add_argument("--depth", type=int, default=2)
        if name == "query":
            command.add_argument("--budget", type=int, default=2000)
            command.add_argument("--cursor", type=int, default=0)
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("weft").getOrCreate()
    store = Store(spark, given.store)
    if given.command == "run":
        built = Graph.from_tree(spark, given.root).clustered()
        print(store.publish({"nodes": built.nodes, "edges": built.edges}))
        return 0
    tables = store.read()
    graph = Graph(tables["nodes"], tables["edges"])
    if given.command == "export":
        lines = {"graphml": sinks.graphml_lines, "cypher": sinks.cypher_lines}.get(given.format)
        if lines:
            sinks.write_lines(lines(graph.nodes, graph.edges), given.out)
        elif given.format == "json":
            sinks.write_json(graph.nodes, graph.edges, given.out)
        else:
            raise SystemExit(f"unknown format {given.format!r}; one of graphml, cypher, json")
    elif given.command == "cluster":
        print(store.publish({"nodes": graph.clustered().nodes}))
    elif given.command == "diff":
        old = store.read(given.generation)
        Graph(old["nodes"], old["edges"]).diff(graph).show(truncate=False)
    else:
        {
            "query": lambda: print(graph.query_text(given.question, given.budget, given.cursor, given.depth)),
            "affected": lambda: graph.affected(given.node, given.depth).orderBy("depth", "label").show(100, False),
            "explain": lambda: graph.explain(given.node).show(100, False),
            "path": lambda: graph.path(given.source, given.target).show(1, False),
            "callflow": lambda: print(graph.call_flow(given.node, given.depth)),
            "stats": lambda: graph.stats().orderBy("what").show(100, False),
            "god-nodes": lambda: graph.god_nodes().show(10, False),
            "map": lambda: graph.repo_map().show(50, False),
            "health": lambda: print(json.dumps(graph.health(), indent=2)),
            "report": lambda: print(graph.report()),
        }[given.command]()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

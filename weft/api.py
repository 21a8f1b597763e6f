"""One object over the operators: build, query, compare and export graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weft import sinks
from weft.operators import analytics, build, communities, identity, memory, merge, retrieve, traverse
from weft.plans.runtime import cut
from weft.schema import edge_violations, node_violations, require_valid
from weft.sources import discovery, prose


class Graph:
    """Nodes and edges, and what can be asked of them. Results are DataFrames unless they say otherwise."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges, self.spark = nodes, edges, nodes.sparkSession

    @classmethod
    def from_tree(cls, spark: SparkSession, root: str) -> Graph:
        """The graph of a folder of sources, prose and manifests."""
        files = discovery.read_tree(spark, root)
        texts = files.filter("text IS NOT NULL")
        records = cut(prose.extract(texts))
        nodes, edges = build.graph_of(records)
        nodes, edges = cut(nodes), cut(build.bind_calls(nodes, edges))
        edges = cut(build.cross_layer(nodes, edges, texts.filter("kind = 'document'").select("path", "text")))
        nodes, edges = build.complete(nodes, edges)
        require_valid(node_violations(nodes).unionByName(edge_violations(edges, nodes)))
        return cls(nodes, edges)

    def deduplicated(self) -> Graph:
        merges = cut(identity.merge_map(self.nodes))
        return Graph(*identity.apply_merges(self.nodes, self.edges, merges))

    def clustered(self) -> Graph:
        found = communities.detect(self.nodes, self.edges)
        return Graph(self.nodes.drop("community").join(found, "id"), self.edges)

    def query(self, question: str, depth: int = 2, seeds: int = 5) -> DataFrame:
        """Nodes around the best seeds with distance and relevance, the most relevant first; empty without a confident match."""
        index = cut(retrieve.lexical_index(self.nodes))
        scores = cut(retrieve.score_nodes(index, retrieve.document_frequency(index), question))
        if retrieve.asks_for_entry(self.spark, question):
            entries = retrieve.entry_files(self.nodes, self.edges)
            scores = cut(scores.select("id", "label", "score").unionByName(entries).groupBy("id", "label").agg(F.max("score").alias("score")))
        elif not analytics.corpus_mode(self.nodes).first()["docs_majority"] and not retrieve.confident(scores):
            scores = scores.limit(0)
        chosen = cut(retrieve.seeds(scores, k=seeds))
        reached = traverse.bfs(chosen, traverse.neighbours(self.edges), depth)
        named = self.nodes.select("id", "label", "file_type", "source_file").join(reached, "id")
        degree = analytics.degrees(self.edges).select("id", "degree")
        out = named.join(scores.select("id", "score"), "id", "left").join(degree, "id", "left").fillna(0, ["score", "degree"])
        return out.orderBy((F.col("file_type") == "stub").cast("int"), F.desc("score"), "distance", F.desc("degree"), "label", "id")

    def query_text(self, question: str, budget: int = 2000, cursor: int = 0, depth: int = 2) -> str:
        """A page of the answer within a budget of tokens."""
        from pyspark.sql import Window

        found = cut(self.query(question, depth))
        order = Window.orderBy((F.col("file_type") == "stub").cast("int"), F.desc("score"), "distance", F.desc("degree"), "label", "id")
        nodes = found.select((F.row_number().over(order) - 1).alias("nth"), F.concat_ws(" ", F.lit("NODE"), "id", "label", "source_file").alias("record"))
        inner = self.edges.join(found.select(F.col("id").alias("source")), "source", "left_semi").join(found.select(F.col("id").alias("target")), "target", "left_semi")
        by = Window.orderBy("source", "target", "relation")
        edges = inner.select((F.row_number().over(by) - 1).alias("nth"), F.concat_ws(" ", F.lit("EDGE"), "source", "relation", "target", "confidence").alias("record"))
        page = retrieve.page(cut(retrieve.interleave(nodes, edges)), budget, cursor).orderBy("position").collect()
        if not page:
            near = [r["label"] for r in retrieve.did_you_mean(self.nodes, question).collect()]
            return "no match" + (f"; did you mean {', '.join(near)}?" if near else "")
        return "\n".join([r["record"] for r in page] + [f"next {page[-1]['position'] + 1}"])

    def stats(self) -> DataFrame:
        return analytics.diagnose(self.nodes, self.edges)

    def god_nodes(self, k: int = 10) -> DataFrame:
        return analytics.god_nodes(self.nodes, self.edges, k)

    def path(self, source: str, target: str, **which) -> DataFrame:
        """The conservative shortest path between two nodes, by any name that says which they are."""
        return traverse.shortest_path(self.edges, self.node(source), self.node(target), **which)

    def node(self, name: str) -> str:
        return traverse.resolve_seed(self.nodes, name)

    def affected(self, node: str, depth: int = 3, relation: str | None = None) -> DataFrame:
        return traverse.blast_radius(self.nodes, self.edges, self.node(node), depth, relation)

    def explain(self, node: str) -> DataFrame:
        return traverse.explain(self.nodes, self.edges, self.node(node))

    def neighbours(self, node: str, relation: str | None = None) -> DataFrame:
        """Of the node's first twenty neighbours those of a relation."""
        found = self.explain(node)
        return found.filter(F.col("relation") == relation) if relation else found

    def call_flow(self, node: str, depth: int = 3, direction: str = "out") -> str:
        return traverse.mermaid(traverse.call_flow(self.edges, self.node(node), depth, direction))

    def repo_map(self, k: int = 50) -> DataFrame:
        """Files by rank, with the symbols that most others touch."""
        files = self.nodes.filter("source_file <> ''").select(F.col("source_file").alias("file")).distinct()
        ranks = traverse.pagerank(analytics.file_weights(self.nodes, self.edges), files)
        top = analytics.top_symbols(self.nodes, self.edges).groupBy(F.col("source_file").alias("file")).agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "id"))), lambda x: x["id"]), ", ").alias("symbols")
        )
        return ranks.join(top, "file", "left").orderBy(F.desc("rank"), "file").limit(k)

    def health(self, age_days: int | None = None) -> dict:
        dead = [r["id"] for r in analytics.dead_code(self.nodes, self.edges).collect()]
        cycles = [r["files"] for r in traverse.file_cycles(self.nodes, self.edges).collect()]
        hubs = [r["id"] for r in analytics.hub_churn(self.nodes, self.edges).collect()]
        return {"score": analytics.health_score(len(dead), len(cycles), len(hubs), age_days), "dead": dead, "cycles": cycles, "hubs": hubs}

    def merge(self, tag: str, other: Graph, other_tag: str) -> Graph:
        return Graph(*merge.merge_graphs([(tag, self.nodes, self.edges), (other_tag, other.nodes, other.edges)]))

    def diff(self, newer: Graph) -> DataFrame:
        return merge.diff_graphs(self.nodes, self.edges, newer.nodes, newer.edges)

    def learn(self, pairs: DataFrame, outcomes: DataFrame) -> Graph:
        return Graph(self.nodes, memory.learned_edges(self.edges, memory.promote(pairs, outcomes, self.nodes)))

    def report(self) -> str:
        return sinks.report(self.nodes, self.edges)

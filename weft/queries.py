"""Registered queries of the graph operators over the test tables, and DuckDB SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from weft.functions import evidence, similarity, text
from weft.operators import analytics as an, communities, identity, memory, merge, resolve, retrieve, traverse
from weft.operators.components import connected_components
from weft.plans.runtime import cut
from weft.sources import graph as g

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: The entity graph as SQL: nodes, edges, and nodes with stubs.
GRAPH = """
nodes AS (
  SELECT 'region:' || r_regionkey AS id, r_name AS label, 'entity' AS file_type, 'region' AS source_file, CAST(r_regionkey AS BIGINT) AS community FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'entity', 'nation', n_regionkey FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, c_name, 'entity', 'customer/' || c_mktsegment, n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'entity', 'supplier', n_regionkey FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'entity', 'part/' || p_brand, p_size % 5 FROM part
  UNION ALL SELECT 'order:' || o_orderkey, CAST(o_orderkey AS VARCHAR), 'entity', 'orders/' || o_orderpriority, n_regionkey
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey),
edges AS (
  SELECT 'nation:' || n_nationkey AS source, 'region:' || n_regionkey AS target, 'references' AS relation, 'EXTRACTED' AS confidence, CAST(NULL AS DOUBLE) AS confidence_score, 'nation' AS source_file FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'references', 'EXTRACTED', NULL, 'customer/' || c_mktsegment FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'references', 'EXTRACTED', NULL, 'supplier' FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'type:' || p_type, 'references', 'EXTRACTED', NULL, 'part/' || p_brand FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'depends_on', 'EXTRACTED', NULL, 'orders/' || o_orderpriority FROM orders
  UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'uses', CASE l_returnflag WHEN 'A' THEN 'INFERRED' WHEN 'R' THEN 'RESOLVED' ELSE 'EXTRACTED' END,
    CASE WHEN l_linenumber % 2 = 1 THEN round(1 - l_discount, 2) END, 'lineitem' FROM lineitem
  UNION ALL SELECT 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'requires', 'RESOLVED', NULL, 'lineitem' FROM lineitem),
every AS (
  SELECT * FROM nodes UNION ALL
  SELECT id, id, 'stub', '', NULL FROM (SELECT source AS id FROM edges UNION SELECT target FROM edges) WHERE id NOT IN (SELECT id FROM nodes)),
deg AS (SELECT id, count(*) AS degree, sum(i) AS n_in, sum(o) AS n_out FROM (
  SELECT source AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT target, 1, 0 FROM edges) GROUP BY id)
"""


def register(name: str, sql: str | None = None, graph: bool = True):
    def add(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLE_SQL[name] = f"WITH {'RECURSIVE ' if 'RECURSIVE' in sql else ''}{GRAPH}{sql.replace('RECURSIVE', '')}" if graph else sql
        return query

    return add


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = g.entity_nodes(spark, sf_dir), g.entity_edges(spark, sf_dir)
    return g.with_stubs(nodes, edges), edges


def _r(c, places: int = 6):
    return F.round(c, places)


@register("god_nodes", "SELECT id, label, CAST(degree AS BIGINT) AS degree FROM every JOIN deg USING (id) WHERE file_type <> 'stub' ORDER BY degree DESC, id LIMIT 10")
def god_nodes(spark, sf_dir):
    return an.god_nodes(*_graph(spark, sf_dir))


@register("degree_centrality", """SELECT id, CAST(coalesce(degree, 0) AS BIGINT) AS degree,
  round(coalesce(degree, 0) / (SELECT CAST(max(degree) AS DOUBLE) FROM deg), 6) AS centrality FROM every LEFT JOIN deg USING (id)""")
def degree_centrality(spark, sf_dir):
    return an.degree_centrality(*_graph(spark, sf_dir)).withColumn("centrality", _r("centrality"))


@register("surprising_connections", """, size AS (SELECT community, count(*) AS n FROM every WHERE community IS NOT NULL GROUP BY community),
  met AS (SELECT e.source, s.label AS source_label, e.target, t.label AS target_label, e.relation, s.community AS source_community, t.community AS target_community,
    least(s.community, t.community) AS lo, greatest(s.community, t.community) AS hi FROM edges e JOIN every s ON s.id = e.source JOIN every t ON t.id = e.target
    WHERE s.community <> t.community AND s.file_type NOT IN ('stub', 'reference') AND t.file_type NOT IN ('stub', 'reference')),
  pair AS (SELECT lo, hi, count(*) AS bridges FROM met GROUP BY lo, hi)
  SELECT source, source_label, target, target_label, relation, source_community, target_community, round(least(a.n, b.n) / CAST(bridges AS DOUBLE), 6) AS score
  FROM met JOIN pair USING (lo, hi) JOIN size a ON a.community = source_community JOIN size b ON b.community = target_community
  ORDER BY least(a.n, b.n) / CAST(bridges AS DOUBLE) DESC, source, target, relation LIMIT 25""")
def surprising_connections(spark, sf_dir):
    return an.surprising_connections(*_graph(spark, sf_dir)).withColumn("score", _r("score"))


@register("hub_threshold", """SELECT CAST(quantile_disc(degree, 0.95) AS BIGINT) AS p95, CAST(greatest(quantile_disc(degree, 0.95), 10) AS BIGINT) AS threshold FROM deg""")
def hub_threshold(spark, sf_dir):
    return an.hub_threshold(g.entity_edges(spark, sf_dir))


@register("hub_churn", """SELECT id, label, CAST(degree AS BIGINT) AS degree FROM every JOIN deg USING (id)
  WHERE file_type NOT IN ('stub', 'reference') AND degree >= (SELECT greatest(quantile_disc(degree, 0.95), 10) FROM deg) ORDER BY degree DESC, id LIMIT 5""")
def hub_churn(spark, sf_dir):
    return an.hub_churn(*_graph(spark, sf_dir))


@register("dead_code", """SELECT id, label, source_file, CAST(n_out AS BIGINT) AS outgoing FROM every JOIN deg USING (id)
  WHERE file_type = 'entity' AND n_in = 0 AND n_out > 0 ORDER BY degree DESC, id LIMIT 15""")
def dead_code(spark, sf_dir):
    return an.dead_code(*_graph(spark, sf_dir), kind="entity")


@register("diagnose_counts", """SELECT 'self_loops' AS what, count(*) AS n FROM edges WHERE source = target
  UNION ALL SELECT 'dangling_edges', count(*) FROM edges WHERE source NOT IN (SELECT id FROM nodes) OR target NOT IN (SELECT id FROM nodes)
  UNION ALL SELECT 'duplicate_edges', count(*) FROM (SELECT 1 FROM edges GROUP BY source, target, relation HAVING count(*) > 1)
  UNION ALL SELECT 'unlinked_nodes', count(*) FROM nodes WHERE id NOT IN (SELECT id FROM deg)
  UNION ALL SELECT 'type:' || file_type, count(*) FROM nodes GROUP BY file_type""")
def diagnose_counts(spark, sf_dir):
    return an.diagnose(g.entity_nodes(spark, sf_dir), g.entity_edges(spark, sf_dir))


RANK_SQL = "CASE confidence WHEN 'DECLARED' THEN 1.0 WHEN 'EXTRACTED' THEN 0.9 WHEN 'RESOLVED' THEN 0.85 WHEN 'INFERRED' THEN 0.7 WHEN 'SEMANTIC' THEN 0.6 ELSE 0.5 END"


@register("edge_weights", f""", s AS (SELECT *, CAST({RANK_SQL} AS DOUBLE) AS rank FROM edges)
  SELECT relation, confidence, count(*) AS n, round(sum(CASE WHEN confidence_score BETWEEN 0 AND 1 THEN confidence_score ELSE rank END), 4) AS weight,
    round(sum(coalesce(confidence_score, rank)), 4) AS strength, count(*) FILTER (WHERE confidence IN ('EXTRACTED', 'DECLARED')) AS high,
    count(*) FILTER (WHERE coalesce(confidence_score, rank) >= 0.85) AS medium FROM s GROUP BY relation, confidence""")
def edge_weights(spark, sf_dir):
    label, score = F.col("confidence"), F.col("confidence_score")
    return g.entity_edges(spark, sf_dir).groupBy("relation", "confidence").agg(
        F.count("*").alias("n"), _r(F.sum(evidence.edge_weight(label, score)), 4).alias("weight"),
        _r(F.sum(evidence.strength(label, score)), 4).alias("strength"), F.count_if(evidence.meets_detail(label, score, 0.9)).alias("high"),
        F.count_if(evidence.meets_detail(label, score, 0.85)).alias("medium"),
    )


COHESION_SQL = """, met AS (SELECT s.community AS cs, t.community AS ct FROM edges e JOIN every s ON s.id = e.source JOIN every t ON t.id = e.target WHERE s.community IS NOT NULL AND t.community IS NOT NULL),
  touched AS (SELECT cs AS community, 1 AS i, 0 AS b FROM met WHERE cs = ct UNION ALL SELECT cs, 0, 1 FROM met WHERE cs <> ct UNION ALL SELECT ct, 0, 1 FROM met WHERE cs <> ct),
  c AS (SELECT community, sum(i) AS internal, sum(b) AS boundary FROM touched GROUP BY community)"""


@register("cohesion", COHESION_SQL + """ SELECT community, (SELECT count(*) FROM every v WHERE v.community = c.community) AS size, CAST(internal AS BIGINT) AS internal,
  CAST(boundary AS BIGINT) AS boundary, round(internal / (internal + boundary), 6) AS cohesion FROM c""")
def cohesion(spark, sf_dir):
    out = an.cohesion(*_graph(spark, sf_dir))
    return out.withColumn("cohesion", _r("cohesion")).select("community", "size", F.col("internal").cast("long"), F.col("boundary").cast("long"), "cohesion")


@register("modularity", COHESION_SQL + """, d AS (SELECT internal, 2 * internal + boundary AS d FROM c)
  SELECT round(sum(internal / (SELECT sum(d) / 2 FROM d) - power(d / (SELECT sum(d) FROM d), 2)), 6) AS modularity FROM d""")
def modularity(spark, sf_dir):
    return an.modularity(*_graph(spark, sf_dir)).select(_r("modularity").alias("modularity"))


@register("hyperedge_members", """, r AS (SELECT community, id, row_number() OVER (PARTITION BY community ORDER BY coalesce(degree, 0) DESC, id) AS nth
  FROM every LEFT JOIN deg USING (id) WHERE community IS NOT NULL AND file_type NOT IN ('stub', 'rationale', 'reference'))
  SELECT community, string_agg(id, ',' ORDER BY nth) AS members FROM r WHERE nth <= 12 GROUP BY community HAVING count(*) >= 3""")
def hyperedge_members(spark, sf_dir):
    return an.hyperedge_members(*_graph(spark, sf_dir))


@register("shared_references", """SELECT target, count(DISTINCT source_file) AS n_files FROM edges WHERE relation = 'references' GROUP BY target
  HAVING count(DISTINCT source_file) >= 3 ORDER BY n_files DESC, target LIMIT 200""")
def shared_references(spark, sf_dir):
    return an.shared_references(g.entity_edges(spark, sf_dir))


FILE_SQL = """, met AS (SELECT s.source_file AS sf, t.source_file AS tf FROM edges e JOIN every s ON s.id = e.source JOIN every t ON t.id = e.target
  WHERE s.source_file <> '' AND t.source_file <> '' AND s.source_file <> t.source_file),
  fw AS (SELECT least(sf, tf) AS file_a, greatest(sf, tf) AS file_b, count(*) AS weight FROM met GROUP BY ALL)"""


@register("file_weights", FILE_SQL + " SELECT * FROM fw")
def file_weights(spark, sf_dir):
    return an.file_weights(*_graph(spark, sf_dir))


@register("orphan_files", FILE_SQL + " SELECT DISTINCT source_file AS file FROM every WHERE source_file <> '' AND source_file NOT IN (SELECT sf FROM met UNION SELECT tf FROM met)")
def orphan_files(spark, sf_dir):
    return an.orphan_files(*_graph(spark, sf_dir))


@register("top_symbols", """, near AS (SELECT id, count(DISTINCT other) AS near FROM (SELECT source AS id, target AS other FROM edges UNION ALL SELECT target, source FROM edges) GROUP BY id),
  r AS (SELECT source_file, id, coalesce(near, 0) AS near, row_number() OVER (PARTITION BY source_file ORDER BY coalesce(near, 0) DESC, label, id) AS nth FROM every LEFT JOIN near USING (id) WHERE source_file <> '')
  SELECT source_file, nth, id, near FROM r WHERE nth <= 3""")
def top_symbols(spark, sf_dir):
    return an.top_symbols(*_graph(spark, sf_dir)).withColumn("nth", F.col("nth").cast("long"))


@register("directory_rollup", """SELECT directory, count(*) AS symbols FROM (SELECT '' AS directory FROM every WHERE source_file <> ''
  UNION ALL SELECT split_part(source_file, '/', 1) FROM every WHERE contains(source_file, '/')) GROUP BY directory""")
def directory_rollup(spark, sf_dir):
    return an.directory_rollup(_graph(spark, sf_dir)[0])


@register("member_hash", "SELECT community, sha256(string_agg(id || chr(10), '' ORDER BY id)) AS member_hash FROM every WHERE community IS NOT NULL GROUP BY community")
def member_hash(spark, sf_dir):
    return an.member_hash(_graph(spark, sf_dir)[0])


@register("orientation_counts", "SELECT 'documentation' AS orientation, count(*) AS n FROM every")
def orientation_counts(spark, sf_dir):
    n = _graph(spark, sf_dir)[0]
    return n.groupBy(an.orientation(F.col("source_file"), F.col("file_type"), F.col("id")).alias("orientation")).agg(F.count("*").alias("n"))


#: Consecutive event types of a user are a pair, and the user's day the question.
PAIRS_SQL = """seen AS (SELECT event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target,
  user_id || ':' || CAST(ts AS DATE) AS question, ts AS seen_at FROM events)"""


def _sightings(spark, sf_dir):
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    question = F.concat(F.col("user_id").cast("string"), F.lit(":"), F.to_date("ts").cast("string"))
    return g.table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), after.alias("target"), question.alias("question"), F.col("ts").alias("at")).filter("target IS NOT NULL")


def _recorded(spark, sf_dir):
    seen = _sightings(spark, sf_dir)
    none = seen.select("source", "target", "question", F.lit(0).cast("long").alias("hits"), F.col("at").alias("first_seen"), F.col("at").alias("last_seen")).limit(0)
    return memory.record_pairs(none, seen)


@register("record_pairs", f"WITH {PAIRS_SQL} SELECT source, target, question, count(*) AS hits, min(seen_at) AS first_seen, max(seen_at) AS last_seen FROM seen WHERE target IS NOT NULL GROUP BY ALL", graph=False)
def record_pairs(spark, sf_dir):
    return _recorded(spark, sf_dir)


@register("promote_learned", f"""WITH {PAIRS_SQL}, p AS (SELECT source, target, question, count(*) AS hits FROM seen WHERE target IS NOT NULL GROUP BY ALL),
  o AS (SELECT DISTINCT user_id || ':' || CAST(ts AS DATE) AS question FROM events WHERE value > 150)
  SELECT source, target, CAST(sum(hits) AS BIGINT) AS hits, round(greatest(0.1, least(1.0, (sum(hits) - 1) / 9.0)), 6) AS confidence_score FROM p LEFT JOIN o USING (question)
  GROUP BY source, target HAVING count(DISTINCT question) >= 2 AND sum(hits) >= 3 AND count(DISTINCT CASE WHEN o.question IS NOT NULL THEN p.question END) < count(DISTINCT p.question)""", graph=False)
def promote_learned(spark, sf_dir):
    question = F.concat(F.col("user_id").cast("string"), F.lit(":"), F.to_date("ts").cast("string"))
    failed = g.table(spark, sf_dir, "events").filter("value > 150").select(question.alias("question"), F.lit("dead_end").alias("outcome")).distinct()
    return memory.promote(_recorded(spark, sf_dir), failed).withColumn("confidence_score", _r("confidence_score"))


@register("graph_diff", """SELECT 'nodes_added' AS what, count(*) AS n FROM every WHERE file_type = 'stub'
  UNION ALL SELECT 'nodes_removed', count(*) FROM every WHERE source_file = 'supplier'
  UNION ALL SELECT 'edges_added', count(*) FROM (SELECT DISTINCT source, target, relation FROM edges WHERE relation = 'requires')
  UNION ALL SELECT 'edges_removed', count(*) FROM (SELECT DISTINCT source, target, relation FROM edges WHERE relation = 'uses')""")
def graph_diff(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return merge.diff_graphs(n.filter("file_type <> 'stub'"), e.filter("relation <> 'requires'"), n.filter("source_file <> 'supplier'"), e.filter("relation <> 'uses'"))


@register("graph_merge", """, a AS (SELECT CASE WHEN source_file <> '' THEN 'a::' || id ELSE 'stub::' || lower(label) END AS id FROM every),
  b AS (SELECT CASE WHEN source_file <> '' THEN 'b::' || id ELSE 'stub::' || lower(label) END AS id FROM every)
  SELECT 'nodes' AS what, count(*) AS n FROM (SELECT id FROM a UNION SELECT id FROM b)
  UNION ALL SELECT 'edges', 2 * count(*) FROM (SELECT DISTINCT * FROM edges)""")
def graph_merge(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    nodes, edges = merge.merge_graphs([("a", n, e), ("b", n, e)])
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return count(nodes, "nodes").unionByName(count(edges, "edges"))


@register("three_way_merge", """WITH b AS (SELECT * FROM part WHERE p_partkey % 11 <> 0), o AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand || '*' ELSE p_brand END AS p_brand, p_size FROM part WHERE p_partkey % 7 <> 0),
  t AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand || '!' ELSE p_brand END AS p_brand, CASE WHEN p_partkey % 5 = 0 THEN p_size + 100 ELSE p_size END AS p_size FROM part WHERE p_partkey % 13 <> 0)
  SELECT p_partkey, CASE WHEN b.p_partkey IS NOT NULL AND o.p_partkey IS NOT NULL AND t.p_partkey IS NOT NULL AND o.p_brand = b.p_brand THEN t.p_brand WHEN o.p_partkey IS NOT NULL THEN o.p_brand ELSE t.p_brand END AS p_brand,
  CAST(CASE WHEN b.p_partkey IS NOT NULL AND o.p_partkey IS NOT NULL AND t.p_partkey IS NOT NULL AND o.p_size = b.p_size THEN t.p_size WHEN o.p_partkey IS NOT NULL THEN o.p_size ELSE t.p_size END AS INTEGER) AS p_size
  FROM b FULL JOIN o USING (p_partkey) FULL JOIN t USING (p_partkey) WHERE NOT ((b.p_brand IS NOT NULL AND (o.p_brand IS NULL OR t.p_brand IS NULL)) OR (o.p_brand IS NULL AND t.p_brand IS NULL))""", graph=False)
def three_way_merge(spark, sf_dir):
    p = g.table(spark, sf_dir, "part")
    mark = lambda n, c: F.when(F.col("p_partkey") % n == 0, F.concat("p_brand", F.lit(c))).otherwise(F.col("p_brand")).alias("p_brand")
    base = p.filter("p_partkey % 11 <> 0").select("p_partkey", "p_brand", "p_size")
    ours = p.filter("p_partkey % 7 <> 0").select("p_partkey", mark(3, "*"), "p_size")
    theirs = p.filter("p_partkey % 13 <> 0").select("p_partkey", mark(2, "!"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 100).otherwise(F.col("p_size")).alias("p_size"))
    return merge.three_way_merge(base, ours, theirs, "p_partkey", ["p_brand", "p_size"])


WALK = """, RECURSIVE near AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges),
  walk AS (SELECT 'customer:1' AS id, 0 AS distance UNION SELECT b, distance + 1 FROM walk JOIN near ON a = id WHERE distance < 2),
  reached AS (SELECT id, min(distance) AS distance FROM walk GROUP BY id)"""


@register("bfs_ball", WALK + " SELECT id, distance FROM reached")
def bfs_ball(spark, sf_dir):
    start = spark.createDataFrame([("customer:1",)], "id string")
    return traverse.bfs(start, traverse.neighbours(g.entity_edges(spark, sf_dir)), 2)


@register("bfs_induced", WALK + " SELECT e.relation, count(*) AS n FROM edges e WHERE source IN (SELECT id FROM reached) AND target IN (SELECT id FROM reached) GROUP BY e.relation")
def bfs_induced(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return traverse.ball(n, e, spark.createDataFrame([("customer:1",)], "id string"), 2)[1].groupBy("relation").agg(F.count("*").alias("n"))


@register("blast_radius", """, RECURSIVE hit AS (SELECT 'nation:3' AS id, 0 AS depth UNION SELECT source, depth + 1 FROM hit JOIN edges ON target = id WHERE depth < 2),
  f AS (SELECT id, min(depth) AS depth FROM hit GROUP BY id)
  SELECT f.id, label, f.depth, relation, confidence AS provenance, via_file FROM f JOIN every USING (id) JOIN LATERAL
  (SELECT relation, confidence, e.source_file AS via_file FROM edges e JOIN f g ON g.id = e.target AND g.depth = f.depth - 1 WHERE e.source = f.id ORDER BY e.target, relation, confidence, e.source_file LIMIT 1) ON TRUE WHERE f.depth > 0""")
def blast_radius(spark, sf_dir):
    return traverse.blast_radius(*_graph(spark, sf_dir), "nation:3", 2)


@register("call_flow", """, RECURSIVE w AS (SELECT 'customer:2' AS id, 0 AS d UNION SELECT source, d + 1 FROM w JOIN edges ON target = id AND relation = 'depends_on' WHERE d < 2)
  SELECT e.source, e.target, min(d) + 1 AS depth FROM w JOIN edges e ON e.target = w.id AND e.relation = 'depends_on' WHERE d < 3 GROUP BY ALL""")
def call_flow(spark, sf_dir):
    return traverse.call_flow(g.entity_edges(spark, sf_dir), "customer:2", 3, "in", "depends_on")


@register("explain_node", f""", own AS (SELECT CASE WHEN source = 'order:1' THEN target ELSE source END AS id, CASE WHEN source = 'order:1' THEN 0 ELSE 1 END AS side, relation,
  coalesce(confidence_score, {RANK_SQL}) AS strength FROM edges WHERE (source = 'order:1' OR target = 'order:1') AND source <> target),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY side, strength DESC, relation) AS nth FROM own)
  SELECT id, CASE side WHEN 0 THEN 'out' ELSE 'in' END AS direction, relation, round(CAST(strength AS DOUBLE), 6) AS strength, label FROM r JOIN every USING (id) WHERE nth = 1 ORDER BY strength DESC, relation, id LIMIT 20""")
def explain_node(spark, sf_dir):
    return traverse.explain(*_graph(spark, sf_dir), "order:1").withColumn("strength", _r("strength"))


def _path_sql(source: str, target: str, depth: int) -> str:
    """Layer after layer, with what was seen before left out."""
    out = f""", s AS (SELECT source, target, coalesce(confidence_score, CASE confidence WHEN 'EXTRACTED' THEN 0.9 WHEN 'RESOLVED' THEN 0.85 WHEN 'INFERRED' THEN 0.7 END) AS hop FROM edges WHERE source <> target),
      near AS MATERIALIZED (SELECT a, b, max(hop) AS hop FROM (SELECT source AS a, target AS b, hop FROM s UNION ALL SELECT target, source, hop FROM s) GROUP BY ALL),
      l0 AS MATERIALIZED (SELECT '{source}' AS id, CAST(2 AS DOUBLE) AS weakest, ['{source}'] AS path, CAST(1 AS BIGINT) AS routes)"""
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM l{j}" for j in range(k))
        out += f""", l{k} AS MATERIALIZED (SELECT id, m.weakest AS weakest, m.path AS path, routes FROM (
          SELECT b AS id, min({{'weakest': least(weakest, hop), 'path': list_append(path, b)}}) AS m, CAST(least(sum(routes), 1000000) AS BIGINT) AS routes
          FROM near JOIN l{k - 1} ON a = id WHERE b NOT IN ({seen}) GROUP BY b))"""
    found = " UNION ALL ".join(f"SELECT path, {k} AS hops, weakest, routes FROM l{k} WHERE id = '{target}'" for k in range(1, depth + 1))
    return out + f" SELECT array_to_string(path, ' > ') AS path, CAST(hops AS INT) AS hops, round(weakest, 6) AS weakest, routes FROM ({found}) ORDER BY hops LIMIT 1"


@register("conservative_path", _path_sql("supplier:1", "region:1", 6))
def conservative_path(spark, sf_dir):
    path = traverse.shortest_path(g.entity_edges(spark, sf_dir), "supplier:1", "region:1")
    return path.select(F.array_join("path", " > ").alias("path"), "hops", _r("weakest").alias("weakest"), "routes")


def _pagerank_sql(rounds: int) -> str:
    out = FILE_SQL + """, twin AS MATERIALIZED (SELECT file_a AS a, file_b AS b, weight FROM fw UNION ALL SELECT file_b, file_a, weight FROM fw),
      share AS MATERIALIZED (SELECT a, b, weight / CAST(sum(weight) OVER (PARTITION BY a) AS DOUBLE) AS s FROM twin),
      files AS MATERIALIZED (SELECT DISTINCT source_file AS file FROM every WHERE source_file <> ''), n AS MATERIALIZED (SELECT CAST(count(*) AS DOUBLE) AS n FROM files),
      r0 AS MATERIALIZED (SELECT file, 1.0 / n AS rank FROM files, n)"""
    for k in range(1, rounds + 1):
        out += f""", r{k} AS MATERIALIZED (SELECT file, 0.15 / n + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{k - 1} WHERE file NOT IN (SELECT a FROM share)) / n + 0.85 * coalesce(got, 0) AS rank
          FROM files CROSS JOIN n LEFT JOIN (SELECT b AS file, sum(rank * s) AS got FROM share JOIN r{k - 1} ON a = file GROUP BY b) USING (file))"""
    return out + f" SELECT file, round(rank, 6) AS rank FROM r{rounds}"


@register("pagerank_files", _pagerank_sql(30))
def pagerank_files(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    files = n.filter("source_file <> ''").select(F.col("source_file").alias("file")).distinct()
    return traverse.pagerank(an.file_weights(n, e), files).withColumn("rank", _r("rank"))


CC_EDGES = "SELECT vec_id AS a, vec_id + 7 AS b FROM embeddings WHERE vec_id % 5 = 0 UNION ALL SELECT vec_id, vec_id * 2 FROM embeddings WHERE vec_id % 3 = 1"


@register("connected_components", f"""WITH RECURSIVE e AS ({CC_EDGES}), twin AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
  w AS (SELECT DISTINCT a AS node, a AS component FROM twin UNION SELECT b, component FROM w JOIN twin ON a = node WHERE component < b)
  SELECT node, min(component) AS component FROM w GROUP BY node""", graph=False)
def components(spark, sf_dir):
    v = g.table(spark, sf_dir, "embeddings")
    e = v.filter("vec_id % 5 = 0").selectExpr("vec_id AS src", "vec_id + 7 AS dst").unionByName(v.filter("vec_id % 3 = 1").selectExpr("vec_id AS src", "vec_id * 2 AS dst"))
    return connected_components(e)


SIM = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@register("similar_to", f"""WITH p AS (SELECT a.vec_id AS source, b.vec_id AS target, {SIM} AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(s, 9) DESC, target) AS nth FROM p WHERE s >= 0.3) SELECT source, target, round(s, 6) AS score FROM r WHERE nth <= 5""", graph=False)
def similar_to(spark, sf_dir):
    v = g.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return similarity.similar_pairs(v, 0.3, 5).withColumn("score", _r("score"))


@register("semantic_candidates", f"SELECT b.vec_id AS id, round({SIM}, 6) AS score FROM embeddings b, (SELECT embedding FROM embeddings WHERE vec_id = 0) a WHERE b.vec_id <> 0 AND {SIM} >= 0.2 ORDER BY {SIM} DESC, id LIMIT 50", graph=False)
def semantic_candidates(spark, sf_dir):
    v = g.table(spark, sf_dir, "embeddings")
    query = v.filter("vec_id = 0").select(F.max("embedding").alias("query")).scalar()
    scored = v.filter("vec_id <> 0").withColumn("query", query).select(F.col("vec_id").alias("id"), similarity.cosine(F.col("embedding"), F.col("query")).alias("score"))
    return scored.filter("score >= 0.2").orderBy(F.desc("score"), "id").limit(50).withColumn("score", _r("score"))


@register("url_kind", r"""WITH u AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '') AS host,
  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) AS path FROM pages)
  SELECT page_id, CASE WHEN regexp_matches(host, '(^|\.)(twitter|x)\.com$') THEN 'tweet' WHEN regexp_matches(host, '(^|\.)arxiv\.org$') THEN 'arxiv_abstract' WHEN path LIKE '%.pdf' THEN 'pdf'
  WHEN regexp_matches(path, '\.(png|jpg|jpeg|webp|gif)$') THEN 'image' ELSE 'webpage' END AS kind FROM u""", graph=False)
def url_kind(spark, sf_dir):
    return g.table(spark, sf_dir, "pages").select("page_id", g.url_kind(F.col("url")).alias("kind"))


@register("html_text", r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'gis'), '<[^>]*>', ' ', 'gs'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages""", graph=False)
def html_text(spark, sf_dir):
    return g.table(spark, sf_dir, "pages").select("page_id", g.html_text(F.col("html")).alias("text"))


@register("href_edges", """SELECT source, target, count(*) AS n FROM (SELECT url AS source, unnest(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1)) AS target FROM pages) GROUP BY ALL""", graph=False)
def href_edges(spark, sf_dir):
    return g.href_edges(g.table(spark, sf_dir, "pages")).groupBy("source", "target").agg(F.count("*").alias("n"))


@register("asof_previous", """SELECT e.event_id, p.value AS value FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts > p.ts""", graph=False)
def asof_previous(spark, sf_dir):
    e = g.table(spark, sf_dir, "events")
    facts = e.filter("event_type = 'purchase'").select("user_id", "ts", "value")
    return resolve.as_of(e.select("event_id", "user_id", "ts"), facts, "user_id", "ts", "value").select("event_id", "value")


@register("narrowest_spans", """WITH s AS (SELECT p_brand AS file, p_partkey AS span_id, (p_partkey * 37) % 2000 AS first, (p_partkey * 37) % 2000 + p_size * 9 AS last FROM part),
  l AS (SELECT DISTINCT p_brand AS file, (p_partkey * 53) % 2400 AS line FROM part), m AS (SELECT l.file, line, span_id, rank() OVER (PARTITION BY l.file, line ORDER BY last - first) AS r FROM l JOIN s ON s.file = l.file AND line BETWEEN first AND last)
  SELECT file, line, span_id FROM m WHERE r = 1""", graph=False)
def narrowest_spans(spark, sf_dir):
    p = g.table(spark, sf_dir, "part")
    spans = p.selectExpr("p_brand AS file", "p_partkey AS span_id", "(p_partkey * 37) % 2000 AS first", "(p_partkey * 37) % 2000 + p_size * 9 AS last")
    return resolve.narrowest_spans(p.selectExpr("p_brand AS file", "(p_partkey * 53) % 2400 AS line"), spans)


@register("manifest_diff", """WITH o AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT doc_id, md5(CASE WHEN doc_id % 5 = 0 THEN text || '.' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0)
  SELECT doc_id AS file_path, CASE WHEN o.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'removed' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS status FROM o FULL JOIN n USING (doc_id)""", graph=False)
def manifest_diff(spark, sf_dir):
    d = g.table(spark, sf_dir, "documents")
    old = d.filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("file_path"), F.md5("text").alias("content_hash"))
    new = d.filter("doc_id % 11 <> 0").select(F.col("doc_id").alias("file_path"), F.md5(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))).alias("content_hash"))
    return merge.manifest_diff(old, new)


@register("redact_counts", r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '\b(?:AKIA|ASIA)[A-Z0-9]{16}\b')) AS BIGINT) AS n FROM documents""", graph=False)
def redact_counts(spark, sf_dir):
    red = text.redact(F.col("text"))
    return g.table(spark, sf_dir, "documents").select("doc_id", F.regexp_count(red, F.lit(r"\[REDACTED\]")).cast("long").alias("n"))


@register("question_norm", r"SELECT conv_id, turn, left(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), 200) AS question FROM conversations", graph=False)
def question_norm(spark, sf_dir):
    return g.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalize_question(F.col("text")).alias("question"))


@register("jaro_winkler", """WITH t AS (SELECT DISTINCT p_type AS t FROM part) SELECT a.t AS first, b.t AS second, round(jaro_winkler_similarity(a.t, b.t), 6) AS score FROM t a JOIN t b ON a.t < b.t""", graph=False)
def jaro_winkler(spark, sf_dir):
    t = g.table(spark, sf_dir, "part").select("p_type").distinct()
    pairs = t.select(F.col("p_type").alias("first")).join(t.select(F.col("p_type").alias("second")), F.col("first") < F.col("second"))
    return pairs.select("first", "second", _r(similarity.jaro_winkler("first", "second")).alias("score"))


@register("idf_table", r"""WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents WHERE lang = 'en'),
  s AS (SELECT DISTINCT doc_id, CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN left(w, length(w) - 3) WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END AS stem FROM t)
  SELECT stem, count(*) AS df FROM s GROUP BY stem HAVING count(*) >= 5""", graph=False)
def idf_table(spark, sf_dir):
    d = g.table(spark, sf_dir, "documents").filter("lang = 'en'")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)))
    stems = F.array_distinct(F.transform(words, text.stem))
    return d.select(F.explode(stems).alias("stem")).groupBy("stem").agg(F.count("*").alias("df")).filter("df >= 5")


def _document_nodes(spark, sf_dir):
    d = g.table(spark, sf_dir, "documents")
    first = F.substring_index("text", "\n", 1)
    return d.select(F.concat(F.lit("doc:"), "doc_id").alias("id"), text.sanitize_label(first).alias("label"), F.lit("document").alias("file_type"), F.coalesce("source", F.lit("")).alias("source_file"), F.col("text").alias("docstring"))


@register("idf_nodes")
def idf_nodes(spark, sf_dir):
    return retrieve.document_frequency(retrieve.lexical_index(_document_nodes(spark, sf_dir)))


@register("score_nodes")
def score_nodes(spark, sf_dir):
    index = cut(retrieve.lexical_index(_document_nodes(spark, sf_dir)))
    scores = retrieve.score_nodes(index, retrieve.document_frequency(index), "which public license and rights are reserved")
    return scores.select("id", "label", _r("score").alias("score")).orderBy(F.desc("score"), "id").limit(20)


@register("communities")
def community_members(spark, sf_dir):
    return communities.detect(*_graph(spark, sf_dir))


@register("merge_entities")
def merge_entities(spark, sf_dir):
    return identity.merge_map(g.entity_nodes(spark, sf_dir))


@register("file_cycles", """, dep AS (SELECT source, target FROM edges WHERE relation IN ('references', 'depends_on') AND confidence = 'EXTRACTED'
    UNION ALL SELECT target, source FROM edges WHERE relation = 'references' AND source LIKE 'nation:%'),
  own AS (SELECT id, source_file FROM every WHERE file_type NOT IN ('stub', 'reference') AND source_file <> ''),
  pair AS MATERIALIZED (SELECT DISTINCT x.source_file AS a, y.source_file AS b FROM dep JOIN own x ON x.id = source JOIN own y ON y.id = target WHERE x.source_file <> y.source_file),
  RECURSIVE reach AS (SELECT a, b FROM pair UNION SELECT reach.a, pair.b FROM reach JOIN pair ON reach.b = pair.a),
  mate AS (SELECT x.a AS id, min(x.b) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
  SELECT component, count(*) AS size, string_agg(id, ',' ORDER BY id) AS files FROM mate GROUP BY component HAVING count(*) > 1 ORDER BY size DESC, component LIMIT 5""")
def file_cycles(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    extra = e.filter("relation = 'references' AND source LIKE 'nation:%'").select(F.col("target").alias("source"), F.col("source").alias("target"), "relation", "confidence", "confidence_score", "source_file")
    return traverse.file_cycles(n, e.unionByName(extra), ("references", "depends_on"))


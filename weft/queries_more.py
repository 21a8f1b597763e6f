"""Further registered queries: scalar rules, bindings, federation, memory, paging and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft import sinks
from weft.functions import evidence, text
from weft.operators import analytics as an, memory, merge, resolve, retrieve, stages, traverse
from weft.queries import QUERIES, _graph, _r, register
from weft.sources import discovery, graph as g


def table_sql(name: str, sql: str):
    return register(name, sql, graph=False)


@table_sql("seed_calibration", """WITH c AS (SELECT event_id, value / 200 AS x FROM events) SELECT event_id,
  round(CASE WHEN x <= 0.45 THEN 0 ELSE least(0.67, (x - 0.45) * (0.67 / 0.25)) END, 6) AS seed,
  round(CASE WHEN x < 0.7 THEN CASE WHEN x <= 0.45 THEN 0 ELSE least(0.67, (x - 0.45) * (0.67 / 0.25)) END ELSE least(2.6, 2 + (x - 0.7) * 3) END, 6) AS described FROM c""")
def seed_calibration(spark, sf_dir):
    x = F.col("value") / 200
    return g.table(spark, sf_dir, "events").select("event_id", _r(evidence.seed_score(x)).alias("seed"), _r(evidence.description_seed_score(x)).alias("described"))


@register("semantic_floor", """SELECT relation, count(*) FILTER (WHERE CASE WHEN confidence = 'INFERRED' THEN coalesce(confidence_score, 0.6) >= 0.95 ELSE TRUE END) AS kept, count(*) AS n FROM edges GROUP BY relation""")
def semantic_floor(spark, sf_dir):
    label = F.when(F.col("confidence") == "INFERRED", "SEMANTIC").otherwise(F.col("confidence"))
    return g.entity_edges(spark, sf_dir).groupBy("relation").agg(F.count_if(evidence.passes_floor(label, F.col("confidence_score"), 0.95)).alias("kept"), F.count("*").alias("n"))


@table_sql("snake_case", r"SELECT DISTINCT c_name AS name, lower(regexp_replace(regexp_replace(c_name, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS snake FROM customer")
def snake(spark, sf_dir):
    return g.table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), text.snake_case(F.col("c_name")).alias("snake")).distinct()


@table_sql("label_entropy", """WITH c AS (SELECT p_partkey, unnest(string_split(p_name, '')) AS ch, length(p_name) AS n FROM part), k AS (SELECT p_partkey, ch, n, count(*) AS m FROM c GROUP BY ALL)
  SELECT p_partkey, round(-sum(m / CAST(n AS DOUBLE) * log2(m / CAST(n AS DOUBLE))), 6) AS bits FROM k GROUP BY p_partkey""")
def label_entropy(spark, sf_dir):
    return g.table(spark, sf_dir, "part").select("p_partkey", _r(text.entropy(F.col("p_name"))).alias("bits"))


@table_sql("token_estimate", "SELECT doc_id, CAST(strlen(text) // 4 AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return g.table(spark, sf_dir, "documents").select("doc_id", text.token_estimate(F.col("text")).cast("long").alias("tokens"))


@table_sql("dedup_label", r"SELECT vec AS page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g')) AS norm FROM (SELECT page_id AS vec, url FROM pages)")
def dedup_label(spark, sf_dir):
    return g.table(spark, sf_dir, "pages").select("page_id", text.dedup_label(F.col("url")).alias("norm"))


@table_sql("file_kinds", r"""SELECT page_id, CASE WHEN regexp_matches(url, '(?i)\.html$') THEN 'document' END AS kind FROM pages""")
def file_kinds(spark, sf_dir):
    return g.table(spark, sf_dir, "pages").select("page_id", F.when(F.col("url").rlike(r"(?i)\.html$"), discovery.file_kind(F.regexp_extract("url", r"([^/]*)$", 1))).alias("kind"))


@table_sql("bind_unique", """WITH c AS (SELECT p_type || p_brand AS name, min(p_partkey) AS target, count(*) AS n FROM part WHERE p_size > 25 GROUP BY p_type || p_brand) SELECT p_partkey AS edge_id, target FROM part JOIN c ON p_type || p_brand = name WHERE n = 1""")
def bind_unique(spark, sf_dir):
    p = g.table(spark, sf_dir, "part")
    found = resolve.bind_unique(p.selectExpr("p_partkey AS edge_id", "p_type || p_brand AS name"), p.filter("p_size > 25").selectExpr("p_type || p_brand AS name", "p_partkey AS target"), ["name"])
    return found.select("edge_id", "target")


@table_sql("resolve_modules", """WITH a(pattern, path) AS (VALUES ('Brand#*', 'b/*'), ('Brand#1*', 'one/*'), ('Brand#11', 'exact'), ('Brand#2*', 'two/*')), m AS (SELECT DISTINCT p_brand AS module FROM part),
  w AS (SELECT module, CASE WHEN pattern LIKE '%*' THEN replace(path, '*', substr(module, length(pattern))) ELSE path END AS path, CASE WHEN pattern LIKE '%*' THEN length(pattern) - 1 ELSE 9999 END AS n
    FROM m JOIN a ON pattern = module OR (pattern LIKE '%*' AND starts_with(module, left(pattern, length(pattern) - 1))))
  SELECT module, arg_max(path, n) AS path FROM w GROUP BY module""")
def resolve_modules(spark, sf_dir):
    aliases = spark.createDataFrame([("Brand#*", "b/*"), ("Brand#1*", "one/*"), ("Brand#11", "exact"), ("Brand#2*", "two/*")], "pattern string, path string")
    return resolve.resolve_modules(g.table(spark, sf_dir, "part").select(F.col("p_brand").alias("module")), aliases)


@table_sql("document_mentions", r"""WITH l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
  t AS (SELECT DISTINCT doc, line, unnest(regexp_split_to_array(content, '[^A-Za-z0-9_./@-]+')) AS name FROM l)
  SELECT doc, name, min(line) AS line FROM t WHERE name IN ('Public', 'License', 'rights', 'version') GROUP BY doc, name""")
def document_mentions(spark, sf_dir):
    names = spark.createDataFrame([("Public",), ("License",), ("rights",), ("version",)], "name string")
    found = resolve.mentions(g.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"), names)
    return found.withColumn("line", F.col("line").cast("long"))


@table_sql("interface_dispatch", """WITH m AS (SELECT s_nationkey AS owner, s_suppkey % 7 AS name, min(s_suppkey) AS id, count(*) AS n FROM supplier GROUP BY ALL HAVING count(*) = 1)
  SELECT a.id AS source, b.id AS target, CAST(0.6 AS DOUBLE) AS confidence_score FROM m a JOIN m b ON b.owner = a.owner + 1 AND a.name = b.name""")
def interface_dispatch(spark, sf_dir):
    members = g.table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS owner", "s_suppkey % 7 AS name", "s_suppkey AS id")
    types = g.table(spark, sf_dir, "nation").selectExpr("n_nationkey AS interface", "n_nationkey + 1 AS type")
    return resolve.dispatch(members, types)


@table_sql("structural_implements", """WITH m AS (SELECT DISTINCT l_suppkey AS owner, l_linenumber AS name FROM lineitem), need AS (SELECT owner AS interface, name FROM m WHERE owner <= 3),
  s AS (SELECT interface, count(*) AS size FROM need GROUP BY interface), k AS (SELECT interface, owner AS type, count(*) AS n FROM need JOIN m USING (name) WHERE owner > 3 GROUP BY ALL),
  x AS (SELECT interface, type FROM k JOIN s USING (interface) WHERE n = size) SELECT interface, type FROM x WHERE interface IN (SELECT interface FROM x GROUP BY interface HAVING count(*) <= 100000)""")
def structural_implements(spark, sf_dir):
    members = g.table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS owner", "l_linenumber AS name")
    return resolve.structural_implements(members, members.filter("owner <= 3").selectExpr("owner AS interface").distinct(), 100_000)


@table_sql("inherited_members", """WITH RECURSIVE m AS (SELECT p_size AS owner, p_brand AS name, min(p_partkey) AS id, count(*) AS n FROM part WHERE p_size % 4 = 0 GROUP BY ALL),
  w AS (SELECT p_partkey AS call, p_size AS type, p_brand AS name, 0 AS level FROM part UNION ALL SELECT call, type + 1, name, level + 1 FROM w WHERE level < 6 AND type < 50 AND NOT EXISTS (SELECT 1 FROM m WHERE owner = type AND m.name = w.name))
  SELECT call, id AS target, level FROM w JOIN m ON owner = type AND m.name = w.name WHERE n = 1""")
def inherited_members(spark, sf_dir):
    p = g.table(spark, sf_dir, "part")
    members = p.filter("p_size % 4 = 0").selectExpr("p_size AS owner", "p_brand AS name", "p_partkey AS id")
    parents = spark.range(1, 50).selectExpr("CAST(id AS INT) AS child", "CAST(id + 1 AS INT) AS parent")
    return resolve.inherited_members(p.selectExpr("p_partkey AS call", "p_size AS type", "p_brand AS name"), members, parents)


@table_sql("fact_overlay", """WITH f AS (SELECT p_size AS node_id, p_brand AS owner, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS source_file, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS docstring FROM part),
  u AS (SELECT node_id, owner, min(source_file) AS source_file, min(docstring) AS docstring FROM f GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY CASE WHEN source_file <> '' THEN 0 ELSE 1 END, CASE WHEN docstring IS NULL THEN 1 ELSE 0 END, owner) AS nth FROM u) SELECT node_id, owner, source_file, docstring FROM r WHERE nth = 1""")
def fact_overlay(spark, sf_dir):
    p = g.table(spark, sf_dir, "part")
    facts = p.selectExpr("p_size AS node_id", "p_brand AS owner", "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS source_file", "CASE WHEN p_partkey % 2 = 0 THEN p_name END AS docstring")
    one = facts.groupBy("node_id", "owner").agg(F.min("source_file").alias("source_file"), F.min("docstring").alias("docstring"))
    out = merge.overlay(one.withColumn("signature", F.lit(None).cast("string")).withColumn("source_line", F.lit(None).cast("int")))
    return out.select("node_id", "owner", "source_file", "docstring")


@table_sql("same_type_pairs", """WITH n AS (SELECT lower(p_type) AS name, p_brand AS repo, min(p_partkey) AS id FROM part GROUP BY ALL), l AS (SELECT id AS source, lead(id) OVER (PARTITION BY name ORDER BY repo) AS target, name FROM n) SELECT * FROM l WHERE target IS NOT NULL""")
def same_type_pairs(spark, sf_dir):
    return merge.same_type_pairs(g.table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_brand AS repo", "p_type AS label"))


@table_sql("cross_repo_calls", """WITH d AS (SELECT lower(p_type || p_size) AS key, p_brand AS home, p_partkey AS id FROM part), c AS (SELECT p_partkey AS source, p_brand AS repo, lower(p_type || p_size) AS key FROM part),
  m AS (SELECT source, min(id) AS target, max(id) AS other FROM c JOIN d USING (key) WHERE home <> repo GROUP BY source, key) SELECT source, target FROM m WHERE target = other""")
def cross_repo_calls(spark, sf_dir):
    p = g.table(spark, sf_dir, "part")
    return merge.cross_repo_calls(p.selectExpr("p_partkey AS source", "p_brand AS repo", "p_type || p_size AS name"), p.selectExpr("p_type || p_size AS name", "p_brand AS repo", "p_partkey AS id"))


@table_sql("manifest_update", """WITH o AS (SELECT doc_id AS file_path, md5(text) AS content_hash FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT doc_id AS file_path, md5(text || '.') AS content_hash FROM documents WHERE doc_id % 11 <> 0)
  SELECT * FROM n WHERE file_path % 5 <> 0 UNION ALL SELECT * FROM o WHERE file_path % 5 = 0 AND file_path IN (SELECT file_path FROM n)""")
def manifest_update(spark, sf_dir):
    d = g.table(spark, sf_dir, "documents")
    old = d.filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("file_path"), F.md5("text").alias("content_hash"))
    new = d.filter("doc_id % 11 <> 0").select(F.col("doc_id").alias("file_path"), F.md5(F.concat("text", F.lit("."))).alias("content_hash"))
    return merge.update_manifest(old, new, d.filter("doc_id % 5 = 0").select(F.col("doc_id").alias("file_path")))


@table_sql("reflect", """WITH o AS (SELECT user_id AS question, CASE event_type WHEN 'purchase' THEN 'useful' WHEN 'click' THEN 'dead_end' ELSE 'corrected' END AS outcome, ts AS updated_at FROM events),
  l AS (SELECT question, outcome, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY updated_at DESC, outcome) AS nth FROM o) WHERE nth = 1),
  c AS (SELECT DISTINCT user_id AS question, event_id % 40 AS node FROM events)
  SELECT node, count(*) FILTER (WHERE outcome = 'useful') AS useful, max(updated_at) FILTER (WHERE outcome = 'useful') AS last_useful, count(*) FILTER (WHERE outcome = 'dead_end') AS dead,
  count(*) FILTER (WHERE outcome = 'useful') > 0 AND count(*) FILTER (WHERE outcome = 'dead_end') > 0 AS contested FROM c JOIN l USING (question) GROUP BY node""")
def reflect(spark, sf_dir):
    e = g.table(spark, sf_dir, "events")
    outcomes = e.selectExpr("user_id AS question", "CASE event_type WHEN 'purchase' THEN 'useful' WHEN 'click' THEN 'dead_end' ELSE 'corrected' END AS outcome", "ts AS updated_at")
    cited = e.selectExpr("user_id AS question", "event_id % 40 AS node").distinct()
    return memory.reflect(cited, outcomes, spark.range(40))


@table_sql("token_reduction", "SELECT round((SELECT sum(strlen(text)) / 4 FROM documents), 4) AS corpus_tokens, round((SELECT avg(strlen(text) // 4) FROM conversations), 4) AS answer_tokens, round((SELECT sum(strlen(text)) / 4 FROM documents) / (SELECT avg(strlen(text) // 4) FROM conversations), 4) AS reduction")
def token_reduction(spark, sf_dir):
    corpus = g.table(spark, sf_dir, "documents").select(F.octet_length("text").alias("n_bytes"))
    answers = g.table(spark, sf_dir, "conversations").select(text.token_estimate(F.col("text")).alias("n_tokens"))
    return memory.token_reduction(corpus, answers).select(*[_r(c, 4).alias(c) for c in ("corpus_tokens", "answer_tokens", "reduction")])


PULLS = "o_orderkey AS number, o_orderkey % 5 = 0 AS coverage_error, o_orderkey % 3 = 0 AS ci_failing, o_orderkey % 4 = 0 AS changes_requested, o_orderkey % 7 = 0 AS conflicts, CAST(o_totalprice / 10000 AS INT) AS impacted, o_orderkey % 2 = 0 AS draft"


@table_sql("review_score", """SELECT o_orderkey AS number, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 35 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 40 ELSE 0 END + CASE WHEN o_orderkey % 4 = 0 THEN 30 ELSE 0 END
  + CASE WHEN o_orderkey % 7 = 0 THEN 25 ELSE 0 END + least(CAST(trunc(o_totalprice / 10000) AS INT), 30) - CASE WHEN o_orderkey % 2 = 0 THEN 20 ELSE 0 END AS INT) AS score FROM orders""")
def review_score(spark, sf_dir):
    return memory.review_score(g.table(spark, sf_dir, "orders").selectExpr(*[p.strip() for p in PULLS.split(", ")])).select("number", "score")


@table_sql("review_overlap", "WITH t AS (SELECT DISTINCT l_suppkey AS number, l_partkey AS symbol FROM lineitem) SELECT a.number AS first, b.number AS second, count(*) AS shared FROM t a JOIN t b ON a.symbol = b.symbol AND a.number < b.number GROUP BY ALL")
def review_overlap(spark, sf_dir):
    return memory.review_overlap(g.table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS number", "l_partkey AS symbol"))


@table_sql("interleaved_page", """WITH n AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS nth, c_name AS record FROM customer), e AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS nth, s_name AS record FROM supplier)
  SELECT nth + least(nth // 2, (SELECT count(*) FROM e)) AS position, 'node' AS kind, record FROM n UNION ALL SELECT nth + least(2 * (nth + 1), (SELECT count(*) FROM n)), 'edge', record FROM e""")
def interleaved_page(spark, sf_dir):
    n = g.table(spark, sf_dir, "customer").selectExpr("c_custkey - min(c_custkey) OVER (PARTITION BY 1) AS nth", "c_name AS record")
    e = g.table(spark, sf_dir, "supplier").selectExpr("s_suppkey - min(s_suppkey) OVER (PARTITION BY 1) AS nth", "s_name AS record")
    return retrieve.interleave(n, e)


@register("graph_exports", """SELECT 'graphml' AS sink, (SELECT count(*) FROM every) + (SELECT count(*) FROM edges) + 9 AS lines UNION ALL SELECT 'cypher', (SELECT count(*) FROM every) + (SELECT count(*) FROM edges)""")
def graph_exports(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    count = lambda df, name: df.agg(F.count("value").alias("lines")).select(F.lit(name).alias("sink"), "lines")
    return count(sinks.graphml_lines(n, e), "graphml").unionByName(count(sinks.cypher_lines(n, e), "cypher"))


@register("usage_consumers", f""", s AS (SELECT *, coalesce(confidence_score, CASE confidence WHEN 'EXTRACTED' THEN 0.9 WHEN 'RESOLVED' THEN 0.85 WHEN 'INFERRED' THEN 0.7 END) AS hop FROM edges),
  h AS (SELECT source, target, max(hop) AS hop FROM s GROUP BY ALL), one AS (SELECT source AS id, 1 AS depth, hop AS weakest FROM h WHERE target = 'nation:1'),
  two AS (SELECT h.source AS id, 2 AS depth, max(least(h.hop, one.weakest)) AS weakest FROM h JOIN one ON h.target = one.id WHERE h.source NOT IN (SELECT id FROM one) GROUP BY h.source)
  SELECT id, depth, round(weakest, 6) AS weakest FROM one UNION ALL SELECT id, depth, round(weakest, 6) FROM two""")
def usage_consumers(spark, sf_dir):
    seeds = spark.createDataFrame([("nation:1",)], "id string")
    return traverse.consumers(g.entity_edges(spark, sf_dir), seeds, 2).select("id", "depth", _r("weakest").alias("weakest"))


@table_sql("catalog_graph", """WITH k(a, b) AS (VALUES ('nation', 'region'), ('customer', 'nation'), ('supplier', 'nation'), ('orders', 'customer'), ('lineitem', 'orders'), ('lineitem', 'part'), ('lineitem', 'supplier')),
  e AS (SELECT a AS name, 0 AS i, 1 AS o FROM k UNION ALL SELECT b, 1, 0 FROM k)
  SELECT 'pg_db::' || name AS id, name AS label, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out, count(*) AS degree FROM e GROUP BY name""")
def catalog_graph(spark, sf_dir):
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
    keys = [("nation", "region"), ("customer", "nation"), ("supplier", "nation"), ("orders", "customer"), ("lineitem", "orders"), ("lineitem", "part"), ("lineitem", "supplier")]
    nodes, edges = g.catalog_graph(spark.createDataFrame([(n, "r") for n in names], "relname string, kind string"), spark.createDataFrame(keys, "`from` string, `to` string"))
    return an.degrees(edges).join(nodes.select("id", "label"), "id")


@register("document_chunks")
def document_chunks(spark, sf_dir):
    from weft.sources import prose

    files = g.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), "doc_id", F.lit(".md")).alias("path"), "text")
    return prose.extract(files).select("file_path", "status", F.size("nodes").cast("long").alias("n_nodes"), F.size("edges").cast("long").alias("n_edges"))


@register("did_you_mean", """, t(term) AS (VALUES ('nations'), ('germny'), ('frnce')), l AS (SELECT DISTINCT label FROM nodes),
  best AS (SELECT label, max(jaro_winkler_similarity(lower(label), term)) AS similarity FROM l, t GROUP BY label)
  SELECT label, round(similarity, 6) AS similarity FROM best WHERE similarity > 0.6 ORDER BY best.similarity DESC, label LIMIT 3""")
def did_you_mean(spark, sf_dir):
    return retrieve.did_you_mean(g.entity_nodes(spark, sf_dir), "nations of germny and frnce").withColumn("similarity", _r("similarity"))


@register("health_report", """SELECT id, 'dead' AS finding FROM (SELECT id FROM every JOIN deg USING (id) WHERE file_type = 'entity' AND n_in = 0 AND n_out > 0 ORDER BY degree DESC, id LIMIT 15)
  UNION ALL SELECT id, 'hub' FROM (SELECT id FROM every JOIN deg USING (id) WHERE file_type NOT IN ('stub', 'reference') AND degree >= (SELECT greatest(quantile_disc(degree, 0.95), 10) FROM deg) ORDER BY degree DESC, id LIMIT 5)""")
def health_report(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    dead, hubs = an.dead_code(n, e, kind="entity"), an.hub_churn(n, e)
    return dead.select("id", F.lit("dead").alias("finding")).unionByName(hubs.select("id", F.lit("hub").alias("finding")))


@register("digest", """, c AS (SELECT CAST(community AS VARCHAR) AS name, count(*) AS size FROM every WHERE community IS NOT NULL GROUP BY community),
  h AS (SELECT id AS name, CAST(degree AS BIGINT) AS size FROM every JOIN deg USING (id) WHERE file_type NOT IN ('stub', 'reference') AND degree >= (SELECT greatest(quantile_disc(degree, 0.95), 10) FROM deg)),
  a AS (SELECT 'communities' AS section, * FROM c UNION ALL SELECT 'hubs', * FROM h), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY section ORDER BY size DESC, name) AS INT) AS nth FROM a)
  SELECT section, nth, name, size FROM r WHERE nth <= 5""")
def digest(spark, sf_dir):
    return stages.digest(*_graph(spark, sf_dir))


@register("label_requests", """, g AS (SELECT community, count(*) AS size, sha256(string_agg(id || chr(10), '' ORDER BY id)) AS member_hash, list_sort(list(DISTINCT coalesce(label, id))) AS labels FROM every WHERE community IS NOT NULL GROUP BY community)
  SELECT community, size, member_hash, array_to_string(labels[1:5], ', ') AS summary FROM g WHERE size >= 3 AND community % 2 = 0""")
def label_requests(spark, sf_dir):
    n, _ = _graph(spark, sf_dir)
    every = stages.label_requests(n, spark.createDataFrame([], "community long, member_hash string, summary string, fingerprint string, source string"), "m1")
    cache = every.select("community", "member_hash", "summary", F.lit("m1").alias("fingerprint"), F.when(F.col("community") % 2 == 1, "llm").otherwise("heuristic").alias("source"))
    return stages.label_requests(n, cache, "m1")


@register("deep_links", """, near AS (SELECT id, count(DISTINCT other) AS near FROM (SELECT source AS id, target AS other FROM edges UNION ALL SELECT target, source FROM edges) GROUP BY id),
  r AS (SELECT id, row_number() OVER (PARTITION BY source_file ORDER BY coalesce(near, 0) DESC, label, id) AS nth FROM nodes LEFT JOIN near USING (id)), k AS (SELECT id FROM r WHERE nth <= 60)
  SELECT DISTINCT source, target, 'relates_to' AS relation, 'INFERRED' AS confidence, CAST(0.5 AS DOUBLE) AS confidence_score, 'deep' AS context FROM edges WHERE source <> target AND source IN (FROM k) AND target IN (FROM k)""")
def deep_links(spark, sf_dir):
    n, e = g.entity_nodes(spark, sf_dir), g.entity_edges(spark, sf_dir)
    return stages.deep_links(*stages.deep_link_prompts(n, e), e)


@table_sql("cost_report", """SELECT event_type AS stage, CASE WHEN user_id % 2 = 0 THEN 'small' ELSE 'large' END AS model, count(*) AS calls, CAST(sum(event_id % 100) AS BIGINT) AS tokens_in, CAST(sum(event_id % 10) AS BIGINT) AS tokens_out,
  round(CASE WHEN user_id % 2 = 0 THEN (sum(event_id % 100) * 2.0 + sum(event_id % 10) * 8.0) / 1e6 END, 9) AS cost, CAST(sum(user_id % 5) AS BIGINT) AS seconds FROM events GROUP BY event_type, user_id % 2""")
def cost_report(spark, sf_dir):
    e = g.table(spark, sf_dir, "events").selectExpr("event_type AS stage", "CASE WHEN user_id % 2 = 0 THEN 'small' ELSE 'large' END AS model", "event_id % 100 AS tokens_in", "event_id % 10 AS tokens_out", "user_id % 5 AS seconds")
    return stages.cost_report(e, {"small": (2.0, 8.0)}).withColumn("cost", _r("cost", 9))


@table_sql("newest_events", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 20")
def newest_events(spark, sf_dir):
    return stages.newest(g.table(spark, sf_dir, "events").select("event_id", "ts"), at="ts")


__all__ = ["QUERIES"]

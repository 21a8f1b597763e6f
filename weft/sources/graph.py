"""Relational tables, documents and web pages as graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder; a missing one is an error when it is read, and nothing is created."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node(df: DataFrame, kind: str, key: str, label: str, file: Column, community: Column) -> DataFrame:
    return df.select(
        F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"), F.col(label).cast("string").alias("label"),
        F.lit("entity").alias("file_type"), file.alias("source_file"), community.cast("long").alias("community"),
    )


def _edge(df: DataFrame, source: str, s_key: str, target: str, t_key: str, relation: str, confidence: Column, score: Column, file: Column) -> DataFrame:
    return df.select(
        F.concat(F.lit(f"{source}:"), F.col(s_key).cast("string")).alias("source"),
        F.concat(F.lit(f"{target}:"), F.col(t_key).cast("string")).alias("target"),
        F.lit(relation).alias("relation"), confidence.alias("confidence"), score.cast("double").alias("confidence_score"),
        file.alias("source_file"),
    )


def entity_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node for each row of the relational tables; its community is its region, or a part's size modulo 5."""
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders")}
    nation = t["nation"].select("n_nationkey", "n_regionkey")
    customer = t["customer"].join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    supplier = t["supplier"].join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    owner = customer.select("c_custkey", "n_regionkey")
    orders = t["orders"].join(owner, F.col("o_custkey") == F.col("c_custkey"), "left")
    region = F.col("n_regionkey")
    parts = [
        _node(t["region"], "region", "r_regionkey", "r_name", F.lit("region"), F.col("r_regionkey")),
        _node(t["nation"], "nation", "n_nationkey", "n_name", F.lit("nation"), region),
        _node(customer, "customer", "c_custkey", "c_name", F.concat(F.lit("customer/"), "c_mktsegment"), region),
        _node(supplier, "supplier", "s_suppkey", "s_name", F.lit("supplier"), region),
        _node(t["part"], "part", "p_partkey", "p_name", F.concat(F.lit("part/"), "p_brand"), F.pmod("p_size", F.lit(5))),
        _node(orders, "order", "o_orderkey", "o_orderkey", F.concat(F.lit("orders/"), "o_orderpriority"), region),
    ]
    return reduce(DataFrame.unionByName, parts)


def entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge for each foreign key; line items give parallel ones, and part types have no node of their own."""
    t = {n: table(spark, sf_dir, n) for n in ("nation", "customer", "supplier", "part", "orders", "lineitem")}
    sure, none = F.lit("EXTRACTED"), F.lit(None)
    flag = F.when(F.col("l_returnflag") == "A", "INFERRED").when(F.col("l_returnflag") == "R", "RESOLVED").otherwise("EXTRACTED")
    score = F.when(F.pmod("l_linenumber", F.lit(2)) == 1, F.round(1 - F.col("l_discount"), 2))
    parts = [
        _edge(t["nation"], "nation", "n_nationkey", "region", "n_regionkey", "references", sure, none, F.lit("nation")),
        _edge(t["customer"], "customer", "c_custkey", "nation", "c_nationkey", "references", sure, none, F.concat(F.lit("customer/"), "c_mktsegment")),
        _edge(t["supplier"], "supplier", "s_suppkey", "nation", "s_nationkey", "references", sure, none, F.lit("supplier")),
        _edge(t["part"], "part", "p_partkey", "type", "p_type", "references", sure, none, F.concat(F.lit("part/"), "p_brand")),
        _edge(t["orders"], "order", "o_orderkey", "customer", "o_custkey", "depends_on", sure, none, F.concat(F.lit("orders/"), "o_orderpriority")),
        _edge(t["lineitem"], "order", "l_orderkey", "part", "l_partkey", "uses", flag, score, F.lit("lineitem")),
        _edge(t["lineitem"], "order", "l_orderkey", "supplier", "l_suppkey", "requires", F.lit("RESOLVED"), none, F.lit("lineitem")),
    ]
    return reduce(DataFrame.unionByName, parts)


def with_stubs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` and a stub, without locus, for each endpoint that isn't among them."""
    ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id"))).distinct()
    lost = ends.join(nodes.select("id"), "id", "left_anti")
    stubs = lost.select("id", F.col("id").alias("label"), F.lit("stub").alias("file_type"), F.lit("").alias("source_file"))
    return nodes.unionByName(stubs, allowMissingColumns=True)


#: Hosts and extensions of each kind of URL.
IMAGES = ("png", "jpg", "jpeg", "webp", "gif")
MEDIA_HOSTS = ("youtube.com", "youtu.be", "vimeo.com", "dailymotion.com", "twitch.tv")
MEDIA_EXTENSIONS = ("mp3", "wav", "m4a", "ogg", "flac", "mp4", "mov", "mkv", "webm", "avi")


def url_kind(url: Column) -> Column:
    """tweet, arxiv_abstract, arxiv_pdf, pdf, image, media or webpage, by the parsed host and path."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    low = F.lower(path)

    def on(*domains: str) -> Column:
        return reduce(lambda a, b: a | b, [(host == d) | host.endswith("." + d) for d in domains])

    return (
        F.when(host == "", "webpage")
        .when(on("twitter.com", "x.com"), "tweet")
        .when(on("arxiv.org") & (path.startswith("/pdf/") | path.endswith(".pdf")), "arxiv_pdf")
        .when(on("arxiv.org"), "arxiv_abstract")
        .when(low.endswith(".pdf"), "pdf")
        .when(low.rlike(rf"\.({'|'.join(IMAGES)})$"), "image")
        .when(on(*MEDIA_HOSTS) | low.rlike(rf"\.({'|'.join(MEDIA_EXTENSIONS)})$"), "media")
        .otherwise("webpage")
    )


def html_text(html: Column) -> Column:
    """What is to be read of a page: scripts, styles, comments and tags gone, the common entities decoded."""
    text = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def html_title(html: Column) -> Column:
    return html_text(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1))


def html_meta(html: Column, name: str) -> Column:
    """The content of the meta tag of a name or property, in either order of its attributes."""
    a = F.regexp_extract(html, rf"""(?is)<meta\b[^>]*\b(?:name|property)\s*=\s*["']{name}["'][^>]*\bcontent\s*=\s*["']([^"']*)["']""", 1)
    b = F.regexp_extract(html, rf"""(?is)<meta\b[^>]*\bcontent\s*=\s*["']([^"']*)["'][^>]*\b(?:name|property)\s*=\s*["']{name}["']""", 1)
    return html_text(F.when(a != "", a).otherwise(b))


def href_edges(pages: DataFrame) -> DataFrame:
    """(source, target) of the links of each page, repeats included."""
    links = F.regexp_extract_all("html", F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    return pages.select(F.col("url").alias("source"), F.explode(links).alias("target"))


def catalog_graph(relations: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of (relname, kind) and ``references`` edges of the foreign keys (from, to) of a database."""
    ident = lambda c: F.concat(F.lit("pg_db::"), F.col(c))
    nodes = relations.select(
        ident("relname").alias("id"), F.col("relname").alias("label"), F.lit("entity").alias("file_type"), F.lit("postgres").alias("source_file")
    )
    edges = keys.select(
        ident("from").alias("source"), ident("to").alias("target"), F.lit("references").alias("relation"),
        F.lit("EXTRACTED").alias("confidence"), F.lit(1.0).alias("confidence_score"), F.lit("postgres").alias("source_file"),
    )
    return nodes, edges

"""Reading trees, prose and code; storing, exporting and streaming."""

import pytest
from pyspark.sql import functions as F

from weft import sinks
from weft.api import Graph
from weft.plans.runtime import cut
from weft.plans.store import Store
from weft.sources import code, discovery, graph as tables, prose
from weft.streaming import feedback


def test_chunks_keep_lines_and_limits():
    text = "one\ntwo\n\n" + "x" * 30 + "\n\nlast"
    got = prose.chunks(text, most=20, overlap=5)
    assert got[0] == (1, "one\ntwo") and all(len(t) <= 26 for _, t in got)
    assert "".join(t for _, t in prose.chunks("a" * 50, most=20, overlap=0)).count("a") >= 50
    assert prose.chunks("") == []


def test_markdown_sections_links_and_fences():
    got = prose.markdown("d/a.md", "---\nstatus: done\n---\n# T\nsee [b](../b.md)\n```\n# no\n```\n## S ##\nx\n## S\ny")
    labels = [n["label"] for n in got["nodes"] if n["node_type"] == "section"]
    assert labels == ["T", "S", "S"] and len({n["id"] for n in got["nodes"]}) == len(got["nodes"])
    assert [e["target"] for e in got["edges"] if e["relation"] == "references"] == [prose.file_stem("b.md")]
    assert all(n["signature"] == "status=done" for n in got["nodes"])


def test_restructured_titles():
    got = prose.restructured("a.rst", "Top\n===\ntext\n\nSub\n---\nmore")
    assert [n["label"] for n in got["nodes"] if n["node_type"] == "section"] == ["Top", "Sub"]


def test_python_reader_finds_scopes_and_calls():
    got = code.python("m.py", "import os\nclass A(B):\n    def f(self):\n        self.g()\n        helper()\n        print(1)\ndef test_x():\n    pass\n")
    stem = prose.file_stem("m.py")
    edges = {(e["source"], e["relation"], e["target"]) for e in got["edges"]}
    assert (f"{stem}::A::f", "calls", f"{stem}::A::g") in edges and (f"{stem}::A::f", "calls", "helper") in edges
    assert (stem, "imports", "os") in edges and (f"{stem}::A", "inherits", "B") in edges
    assert not any(t == "print" for _, _, t in edges) and any(n["node_type"] == "test" for n in got["nodes"])


def test_broken_sources_are_partial():
    assert code.python("m.py", "def (")["status"] == "partial"


def test_profiles_and_languages():
    got = code.by_profile("go")("a.go", 'import "fmt"\ntype T struct {\n}\nfunc (t T) Run() {\n  work()\n}\nfunc work() {}\n')
    assert {n["label"] for n in got["nodes"]} >= {"T", "Run()", "work()"}
    assert code.language_of("x", "#!/usr/bin/env -S python3.12 -u") == "python" and code.language_of("a.tsx") == "javascript"


def test_manifests():
    got = code.manifest("package.json", '{"name": "n", "dependencies": {"a": "1"}}')
    assert ("package::n", "depends_on", "package::a") in {(e["source"], e["relation"], e["target"]) for e in got["edges"]}
    got = code.manifest(".mcp.json", '{"mcpServers": {"s": {"command": "c", "env": {"KEY": "hidden-value"}}}}')
    assert any(n["id"] == "env::KEY" for n in got["nodes"]) and "hidden-value" not in str(got)


def test_csv_becomes_a_table():
    assert prose.csv_table("a,b\n1,x|y\n") == "| a | b |\n| --- | --- |\n| 1 | x\\|y |"


def test_url_kinds(spark):
    want = {
        "https://example.com/x.com/1": "webpage", "https://www.x.com/a": "tweet", "https://arxiv.org/pdf/1": "arxiv_pdf", "https://arxiv.org/abs/1": "arxiv_abstract",
        "https://a.b/f.PDF?x=1": "pdf", "https://a.b/i.png#t": "image", "https://m.youtube.com/w": "media", "nonsense": "webpage",
    }
    rows = spark.createDataFrame([(u,) for u in want], "u string").select("u", tables.url_kind(F.col("u")).alias("k")).collect()
    assert {r["u"]: r["k"] for r in rows} == want


def test_tree_to_graph_store_and_exports(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "src").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "src" / "a.py").write_text("from b import helper\ndef go():\n    return helper()\n")
    (root / "src" / "b.py").write_text("# WHY: kept small\ndef helper():\n    return 1\n")
    (root / "src" / "__init__.py").write_text("")
    (root / "pyproject.toml").write_text('[project]\nname = "toolkit"\n')
    (root / "readme.md").write_text("# Toolkit\nUse toolkit now.\n")
    (root / "id_rsa").write_text("secret")
    (root / "node_modules" / "x.js").write_text("function x() {}")
    g = Graph.from_tree(spark, str(root))
    g = Graph(cut(g.nodes), cut(g.edges))
    edges = {(r["source"], r["relation"], r["target"], r["confidence"]) for r in g.edges.collect()}
    a, b = prose.file_stem("src/a.py"), prose.file_stem("src/b.py")
    assert (f"{a}::go", "calls", f"{b}::helper", "RESOLVED") in edges
    assert any(rel == "references" and t == "package::toolkit" for _, rel, t, _ in edges)
    assert g.stats().filter("what = 'dangling_edges'").first()["n"] == 0
    assert not g.nodes.filter("source_file LIKE '%node_modules%' OR source_file LIKE '%rsa%'").count()
    assert "helper" in g.query_text("helper", 400)
    assert [r["id"] for r in g.affected(f"{b}::helper").collect()] == [f"{a}::go"]
    store = Store(spark, str(tmp_path / "store"))
    first = store.publish({"nodes": g.nodes, "edges": g.edges})
    second = store.publish({"edges": g.edges.limit(1)})
    assert store.current() == second != first and store.read()["nodes"].count() == g.nodes.count()
    assert store.read(first)["edges"].count() == g.edges.count()
    xml = "\n".join(r["value"] for r in sinks.graphml_lines(g.nodes, g.edges).orderBy("part", "key").collect())
    import xml.etree.ElementTree as ET

    assert len(list(ET.fromstring(xml).iter())) > 10
    assert sinks.cypher_lines(g.nodes, g.edges).count() == g.nodes.count() + g.edges.count()
    assert "# Graph report" in g.report() and "index" in sinks.wiki(g.clustered().nodes, g.edges)
    files = discovery.read_tree(spark, str(root))
    manifest = cut(files.select(F.col("path").alias("file_path"), "content_hash"))
    (root / "src" / "a.py").write_text("x = 1\n")
    (root / "readme.md").unlink()
    status = {r["file_path"]: r["status"] for r in discovery.changes(manifest, discovery.read_tree(spark, str(root))).collect()}
    assert status["src/a.py"] == "changed" and status["readme.md"] == "removed" and status["src/b.py"] == "unchanged"


def test_missing_store_is_an_error(spark, tmp_path):
    import pytest

    with pytest.raises(FileNotFoundError):
        Store(spark, str(tmp_path / "none")).read()
    assert not (tmp_path / "none").exists()


def test_feedback_stream_counts_once(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "a", "b", "q"), (1, "2024-01-01 00:00:01", "a", "b", "q"), (2, "2024-01-01 00:01:00", "a", "b", "q")]
    df = spark.createDataFrame(rows, "event_id long, at string, source string, target string, question string").withColumn("at", F.to_timestamp("at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = feedback.drain(feedback.pair_counts(stream), "pairs", "complete", str(tmp_path / "c")).collect()
    assert [(r["source"], r["hits"]) for r in got] == [("a", 2)]


@pytest.mark.parametrize(("lines", "left_out", "kept"), [
    ("*.log\n!keep.log", ["a.log", "x/y.log"], ["keep.log", "x/keep.log", "a.logs"]), ("/top.py", ["top.py"], ["x/top.py"]), ("gen/", ["gen/a.py", "x/gen/b/c.py"], ["gen", "x/gen.py"]),
    ("doc/*.txt", ["doc/a.txt"], ["doc/x/a.txt", "x/doc/a.txt"]), ("**/tmp", ["tmp", "a/b/tmp/c"], ["tmpx"]), ("a/**", ["a/b", "a/b/c"], ["a", "b/a/c"]), ("a/**/b", ["a/b", "a/x/y/b"], ["ab"]),
    ("gen/\n!gen/keep.py", ["gen/keep.py"], []), ("# note\n\n\\#x\n[!ab]?.c", ["#x", "cd.c"], ["ad.c", "# note"]), ("sp\\ ", ["sp "], ["sp"]), ("/*\n!/src", ["x.py", "lib/x.py"], ["src/x.py"]),
])
def test_ignore_files(lines, left_out, kept):
    rules = discovery.ignore_rules(lines)
    assert [p for p in left_out if not discovery.is_ignored(p, rules)] == [] and [p for p in kept if discovery.is_ignored(p, rules)] == []


def test_trees_without_what_is_ignored(spark, tmp_path):
    for name, text in {".gitignore": "*.gen.py\nold/", "a.py": "x", "b.gen.py": "x", "old/c.py": "x", "sub/.gitignore": "d.py\n!e.gen.py", "sub/d.py": "x", "sub/e.gen.py": "x", "sub/f.py": "x", "d.py": "x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    assert sorted(r["path"] for r in discovery.read_tree(spark, str(tmp_path)).collect()) == ["a.py", "d.py", "sub/e.gen.py", "sub/f.py"]

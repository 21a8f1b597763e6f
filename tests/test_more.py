"""Office files, indexes, hubs, questions, verdicts and the command line."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from weft import cli, sinks
from weft.operators import analytics, communities, memory, retrieve, stages, traverse
from weft.sources import graph as tables, office
from tests.test_graph import graph


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", text)
    return out.getvalue()


def test_word_and_sheets():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>text</w:t></w:r></w:p></w:body></w:document>'
    got = office.docx("a.docx", archive(word__document=body))
    assert [n["label"] for n in got["nodes"] if n["node_type"] == "section"] == ["Top"] and got["language"] == "docx"
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    got = office.xlsx("a.xlsx", archive(xl__sharedStrings=f"<sst {s}><si><t>name</t></si></sst>", xl__worksheets__sheet1=f'<worksheet {s}><sheetData><row><c t="s"><v>0</v></c><c><v>2</v></c></row></sheetData></worksheet>'))
    assert any("name | 2" in (n["docstring"] or "") for n in got["nodes"])
    with pytest.raises(ValueError):
        office.docx("a.docx", archive(word__document="<!DOCTYPE x><x/>"))


def test_compiler_index():
    index = {"documents": [{"relative_path": "src/a.py", "symbols": [{"symbol": "m/A#", "relationships": [{"symbol": "m/B#", "is_implementation": True}]}], "occurrences": [{"symbol": "m/A#", "symbol_roles": 1, "range": [4, 0, 3]}]}]}
    got = office.scip("i.json", json.dumps(index))
    assert {(e["relation"], e["target"]) for e in got["edges"]} == {("scip_impl", "m/B#"), ("scip_def", "m/A#")}
    with pytest.raises(ValueError):
        office.scip("i.json", json.dumps({"documents": [{"relative_path": "../x"}]}))


def test_hubs_join_what_they_are_tied_to(spark):
    a, b = [f"a{k:02d}" for k in range(8)], [f"b{k:02d}" for k in range(8)]
    edges = [(x, y) for g in (a, b) for i, x in enumerate(g) for y in g[i + 1 :]] + [("hub", x) for x in a + b[:4]] + [(f"p{k}", f"q{k}") for k in range(60)]
    nodes, e = graph(spark, edges)
    assert [r["id"] for r in communities.hubs(communities.link_weights(e)).collect()] == ["hub"]
    found = {r["id"]: r["community"] for r in communities.detect_without_hubs(nodes, e).collect()}
    assert len(found) == nodes.count() and found["hub"] == found["a00"] != found["b00"] and len({found[x] for x in b}) == 1


def test_questions_and_texts(spark):
    nodes, e = graph(spark, [("a", "b"), ("a", "c")], [("a", "a", "code", "x.py", 0), ("b", "b", "code", "y.py", 1), ("c", "c", "code", "y.py", 1), ("z", "z", "code", "z.py", None)])
    asked = analytics.suggested_questions(nodes, e)
    assert asked[0].startswith("Why do 2") and any("z.py" in q for q in asked) and any("2 communities" in q for q in asked)
    named = nodes.withColumn("docstring", F.repeat(F.lit("é"), 30)).withColumn("signature", F.lit("s"))
    texts = [r["text"] for r in analytics.embedding_text(named, 20).collect()]
    assert all(len(t.encode()) <= 20 and "�" not in t and t.endswith("é") for t in texts)
    assert analytics.corpus_mode(nodes.withColumn("file_type", F.lit("document"))).first()["docs_majority"]


def test_results_are_saved_once(spark):
    nodes, e = graph(spark, [("a", "b")])
    outcomes = spark.createDataFrame([], "question string, outcome string, updated_at timestamp")
    for verdict in ("useful", "dead_end"):
        nodes, e, outcomes = memory.save_result(nodes, e, outcomes, "Why  A?", verdict, ["a", "missing"])
    assert [(r["question"], r["outcome"]) for r in outcomes.collect()] == [("why a?", "dead_end")]
    assert e.filter("relation = 'references'").count() == 1 and nodes.filter("id = 'memory::why_a'").count() == 1
    with pytest.raises(ValueError):
        memory.save_result(nodes, e, outcomes, "q", "great", [])


def test_names_resolve_or_say_why_not(spark):
    nodes = [("src_a::load", "load()", "code", "src/a.py", None), ("load", "load", "stub", "", None), ("x::run", "run()", "code", "src/x.py", None), ("y::run", "run()", "code", "src/y.py", None), ("src_a", "a.py", "code", "src/a.py", None)]
    n, _ = graph(spark, [], nodes)
    assert traverse.resolve_seed(n, "load") == "src_a::load" and traverse.resolve_seed(n, "x::run") == "x::run"
    assert traverse.resolve_seed(n, ".load()") == "src_a::load" and traverse.resolve_seed(n, "a.py") == "src_a" == traverse.resolve_seed(n, "src/a.py")
    for name in ("run()", "nothing", "run"):
        with pytest.raises(LookupError):
            traverse.resolve_seed(n, name)


def test_entries_and_confidence(spark):
    edges = [("app", m, "imports") for m in "abc"] + [("tests/t", m, "imports") for m in "abc"] + [("a", "app2", "imports")]
    nodes, e = graph(spark, edges, [("tests/t", "t", "code", "tests/t.py", None)])
    assert retrieve.asks_for_entry(spark, "Where are the entry points?") and not retrieve.asks_for_entry(spark, "domain files")
    assert [r["id"] for r in retrieve.entry_files(nodes, e).collect()] == ["app"]
    index = retrieve.lexical_index(graph(spark, [], [("h", "handle message", "code", "h.py", None), ("o", "other", "code", "o.py", None)])[0].withColumn("docstring", F.lit(None).cast("string")))
    freq = retrieve.document_frequency(index)
    assert not retrieve.confident(retrieve.score_nodes(index, freq, "zebra quagga okapi gnu handle"))
    assert retrieve.confident(retrieve.score_nodes(index, freq, "handle message"))


def test_page_heads(spark):
    page = "<title>A &amp; B</title><meta content='x' property='og:title'><meta name=\"description\" content=\"d\">"
    row = spark.range(1).select(tables.html_title(F.lit(page)).alias("t"), tables.html_meta(F.lit(page), "og:title").alias("o"), tables.html_meta(F.lit(page), "description").alias("d")).first()
    assert tuple(row) == ("A & B", "x", "d")


def test_pictures_and_notes(spark):
    nodes, e = graph(spark, [("a", "b"), ("b", "c/d")])
    assert sinks.svg(nodes, e).count("<circle") == 3
    notes = {r["name"]: r["text"] for r in sinks.vault(nodes, e).collect()}
    assert "[[a]]" in notes["b"] and "c_d" in notes


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.py").write_text("def f():\n    g()\ndef g():\n    pass\n")
    store = ["--store", str(tmp_path / "s")]
    assert cli.main([*store, "run", str(tmp_path / "t")]) == 0
    assert cli.main([*store, "stats"]) == 0 and cli.main([*store, "export", "cypher", str(tmp_path / "c")]) == 0
    cli.main([*store, "query", "f"])
    assert "self_loops" in capsys.readouterr().out and list((tmp_path / "c").glob("part-*"))


def test_queries_of_retrieval_take_all_rows(spark, tmp_path, monkeypatch):
    from weft import queries, queries_more

    docs = [(1, "rare words", "en", "s"), (2, "größe words", "de", "s"), (3, "words x1", None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    df = {r["stem"]: r["df"] for r in queries.QUERIES["idf_nodes"](spark, str(tmp_path)).collect()}
    assert df["word"] == 3 and df["rare"] == df["größe"] == df["x1"] == 1
    nodes = spark.createDataFrame([("n", "GERMANY", "nation"), ("c", "germny", "customer")], "id string, label string, source_file string")
    monkeypatch.setattr(queries_more.g, "entity_nodes", lambda *_: nodes)
    found = queries.QUERIES["did_you_mean"](spark, "").collect()
    assert [r["label"] for r in found] == ["germny", "GERMANY"]


def test_labels_of_communities_are_asked_for_once(spark):
    members = spark.createDataFrame([(f"n{k}", k // 4, f"name {k % 3}") for k in range(14)], "id string, community long, label string")
    none = spark.createDataFrame([], "community long, member_hash string, summary string, fingerprint string, source string, label string")
    asked = []
    answer = lambda summary: asked.append(summary) or (f"about {summary}" if len(asked) != 2 else "")
    first = stages.label_communities(members, none, "m1", answer)
    assert len(asked) == 3 and first.count() == 2  # the last community is too small, and one answer failed
    again = stages.label_communities(members, first, "m1", answer)
    assert len(asked) == 4 and again.count() == 3
    assert stages.label_requests(members, again, "m1").count() == 0 and stages.label_requests(members, again, "m2").count() == 3
    moved = members.filter("id <> 'n0'")
    assert [r["community"] for r in stages.label_requests(moved, again, "m1").collect()] == [0]
    assert stages.label_requests(members.limit(0), again, "m1").count() == 0


def test_deep_links_need_both_ends(spark):
    c = spark.createDataFrame([("c1", "x")], "id string, label string")
    s = spark.createDataFrame([("f", 1, "s1"), ("f", 2, "s2")], "source_file string, nth int, id string")
    proposed = spark.createDataFrame([("c1", "s1"), ("c1", "s1"), ("s2", "c1"), ("c1", "gone"), ("s1", "s1"), (None, "s1")], "source string, target string")
    got = stages.deep_links(c, s, proposed).collect()
    assert sorted((r["source"], r["target"], r["confidence"], r["confidence_score"], r["context"]) for r in got) == [("c1", "s1", "INFERRED", 0.5, "deep"), ("s2", "c1", "INFERRED", 0.5, "deep")]

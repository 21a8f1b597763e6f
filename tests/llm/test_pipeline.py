"""The stages on a small corpus, each against what its operator says of its own input."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from weft.llm.queries import QUERIES

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(12)
    words = {"en": "the of and thing with house river stone small great".split(), "de": "der und ding mit haus fluss stein klein groß über".split()}
    rows = []
    for k in range(60):
        lang = ("en", "de")[k % 2]
        text = "\n".join(" ".join(r.choice(words[lang]) for _ in range(30)) for _ in range(3))
        rows.append((k, text, lang if k % 5 else None, f"s{k % 3}", len(text)))
    rows += [(100, rows[0][1], "en", "s0", 1), (101, rows[1][1] + "\nnew words here", "de", "s1", 1), (102, "123 456", None, None, 7), (103, None, "en", "s1", None), (104, "", "en", "s1", 0)]
    return rows


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.createDataFrame(corpus(), DOC)
    out = [docs]
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, out[-1], None).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_are_in_order():
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "simhash", "mixing", "bpe"]


def test_language_rejects_what_has_no_letters(stages):
    assert set(ids(stages[0])) - set(ids(stages[1])) == {102, 103, 104}
    assert stages[1].filter("lang IS NULL").count() == 0 and stages[1].columns == list(cp.COLUMNS)


def test_language_rejects_what_is_in_no_learned_script(spark):
    rows = [*corpus(), (200, "漢字漢字 漢字", None, "s0", 7), (201, "漢字漢字 漢字", "en", "s0", 7)]
    kept = ids(cp.identify_language(spark, spark.createDataFrame(rows, DOC), None))
    assert not {200, 201} & set(kept) and len(kept) == len(rows) - 5


def test_line_dedup_takes_copies_apart(stages):
    assert set(ids(stages[1])) - set(ids(stages[2])) == {100}
    assert stages[2].filter("doc_id = 101").first()["text"] == "new words here"
    norm = [x.lower() for r in stages[2].collect() for x in r["text"].split("\n") if x.strip()]
    assert len(norm) == len(set(norm))


def test_later_stages(spark, stages):
    assert set(ids(stages[3])) <= set(ids(stages[2])) and len(ids(stages[3])) == len(set(ids(stages[3])))
    counts = stages[4].groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert counts <= 2 and set(ids(stages[4])) <= set(ids(stages[3]))
    last = stages[5]
    assert last.count() == stages[4].count()
    assert last.filter(F.sha2(F.encode("text", "UTF-8"), 256) != F.col("decoded_sha256")).count() == 0


def test_stages_begin_with_heaps_given_back(spark, stages):
    """In local mode the driver's collector is the executor's; the two other stages have the driver collected anyway."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans

    def full():
        return sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())

    for k in (0, 3, 4):
        before = full()
        cp.STAGES[k][1](spark, stages[k], None)
        assert full() > before, cp.STAGES[k][0]


def test_run_and_queries_are_registered(spark):
    import __spark_entry__

    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)]
    assert cp.ORACLE_SQL is None

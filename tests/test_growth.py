"""What queries hand on grows with their input, and results are those of plain Python."""

import random
from collections import Counter
from contextlib import contextmanager
from itertools import combinations

import pandas as pd
from pyspark.sql import functions as F

from weft.operators import analytics, communities, identity, memory, merge, traverse
from weft.sources import prose


def plan_of(df):
    """The operators that ran, after ``df`` was collected."""
    def walk(p):
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            yield from walk(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            yield from walk(p.plan())
        else:
            yield p
            for k in range(p.children().size()):
                yield from walk(p.children().apply(k))

    return list(walk(df._jdf.queryExecution().executedPlan()))


def most(df, metric):
    """The largest value of a metric of any operator of ``df``, which was collected."""
    found = [p.metrics().get(metric) for p in plan_of(df)]
    return max((m.get().value() for m in found if m.isDefined()), default=0)


@contextmanager
def by_shuffle(spark):
    """Joins of small tables as of large ones."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffled(df):
    """Rows that all shuffles of ``df`` wrote, after it was collected."""
    found = [p.metrics().get("shuffleRecordsWritten") for p in plan_of(df)]
    return sum(m.get().value() for m in found if m.isDefined())


EDGES = "source string, target string, relation string, confidence string, confidence_score double, source_file string"


def drawn_graph(spark, seed, nodes=40, edges=400):
    drawn = random.Random(seed)
    name = lambda: drawn.choice([None, *(f"n{k}" for k in range(nodes + 5))])
    n = [(None if k == 7 else f"n{k}", f"L{k}", "entity", "f", k % 3 if k % 5 else None) for k in range(nodes)]
    e = [(name(), name(), drawn.choice(["uses", "calls"]), "EXTRACTED", None, "f") for _ in range(edges)]
    return n, e, spark.createDataFrame(n, "id string, label string, file_type string, source_file string, community long"), spark.createDataFrame(e, EDGES)


def test_calls_meet_one_row_of_a_name(spark):
    rows = [("run", f"r{k % 3}", k) for k in range(300)] + [("one", "a", 1), ("one", "a", 1), ("two", "a", 1), ("two", "b", 2), ("null", None, 3), ("null", "a", None), ("null", "b", 4)]
    calls = [(s, r, n) for s, (n, r, _) in enumerate(rows)] + [(900, "b", "ONE"), (901, "c", "two"), (902, "b", "two"), (902, "a", "two"), (903, "c", "null")]
    df = merge.cross_repo_calls(spark.createDataFrame(calls, "source long, repo string, name string"), spark.createDataFrame(rows, "name string, repo string, id long"))
    got = sorted(tuple(r) for r in df.collect())
    ids = {}
    for s, repo, name in calls:
        found = {i for n, home, i in rows if n == name.lower() and None not in (home, repo, i) and home != repo}
        ids[s, name.lower()] = ids.get((s, name.lower()), set()) | found
    assert got == sorted((s, next(iter(found))) for (s, _), found in ids.items() if len(found) == 1) and (900, 1) in got
    assert most(df, "numOutputRows") <= len(calls) + len(rows)


def test_overlaps_shuffle_lists_not_pairs(spark):
    rows = [(k, s) for s in range(10) for k in range(200) if (k + s) % 9] + [(None, 1), (5, None), (3, 1), (3, 1)]
    df = memory.review_overlap(spark.createDataFrame(rows, "number long, symbol long"))
    got = {(r["first"], r["second"]): r["shared"] for r in df.collect()}
    want = {}
    for s in range(10):
        for pair in combinations(sorted({n for n, t in rows if t == s and n is not None}), 2):
            want[pair] = want.get(pair, 0) + 1
    assert got == want
    assert most(df, "shuffleRecordsWritten") <= len(rows) < len(got)


def test_overlaps_are_counted_by_tasks_of_limited_pairs(spark, monkeypatch):
    monkeypatch.setattr(memory, "TASK_PAIRS", 500)
    df = memory.review_overlap(spark.createDataFrame([(k, s) for s in range(2) for k in range(100)], "number long, symbol long"))
    assert df.rdd.getNumPartitions() == 20 and df.count() == 4950


def sweep(links, rounds=communities.ROUNDS):
    """Labels by rounds as they are defined, and the number of rounds."""
    near, whole = {}, rounds
    for a, b, w in links:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    label = {n: n for n in near}
    for k in range(rounds):
        new, pulled = dict(label), False
        for n, ends in near.items():
            tally = {}
            for m, w in ends:
                tally[label[m]] = tally.get(label[m], 0) + w
            best = min((-w, lead) for lead, w in tally.items())[1]
            pulled |= best != label[n]
            if best < label[n] or (best != label[n] and k % 2):
                new[n] = best
        label = new
        if not pulled:
            whole = k + 1
            break
    firsts = {}
    for n, lead in label.items():
        firsts[lead] = min(n, firsts.get(lead, n))
    return {n: firsts[lead] for n, lead in label.items()}, whole


#: Labels that never settle.
RESTLESS = [(0, 5, 1), (0, 7, 5), (0, 8, 2), (1, 2, 3), (1, 3, 3), (1, 8, 5), (1, 11, 2), (2, 4, 1), (2, 5, 1), (2, 9, 1), (3, 8, 2), (3, 10, 2), (4, 7, 2), (4, 8, 1), (4, 9, 5), (5, 7, 2), (6, 8, 3), (6, 10, 3), (6, 11, 1), (7, 10, 3), (9, 10, 2), (9, 11, 3), (10, 11, 1)]


def test_sweeps_end_when_labels_come_again(spark, monkeypatch):
    drawn = random.Random(5)
    loose = [(f"m{a:03d}", f"m{b:03d}", drawn.choice([1, 2, 3])) for a in range(80) for b in range(a + 1, 80) if drawn.random() < 0.04]
    links = [(f"n{a:02d}", f"n{b:02d}", w) for a, b, w in RESTLESS] + loose
    want, whole = sweep(links)
    assert whole == communities.ROUNDS and len(set(want.values())) > 5
    cuts, plain = [], communities.cut
    monkeypatch.setattr(communities, "cut", lambda df: cuts.append(1) or plain(df))
    got = {r["id"]: r["lead"] for r in communities._labels(spark.createDataFrame(links, "a string, b string, weight long")).collect()}
    assert got == want and len(cuts) < 40


def test_whole_components_are_swept_once(spark, monkeypatch):
    calls, plain = [], communities._labels
    monkeypatch.setattr(communities, "_labels", lambda *a: calls.append(1) or plain(*a))
    links = spark.createDataFrame([(f"n{a:02d}", f"n{b:02d}", 1) for a in range(12) for b in range(a + 1, 12)], "a string, b string, weight long")
    assert {r["lead"] for r in communities._rounds(links, 12).collect()} == {"n00"} and len(calls) == 1


def routes_of(hops, source, target):
    """(path, hops, weakest, routes) by all shortest routes, each listed."""
    layer, seen = [([source], 2.0)], {source}
    for k in range(33):
        found = [r for r in layer if r[0][-1] == target]
        if found:
            weakest, path = min((w, p) for p, w in found)
            return path, k, weakest if k else None, len(found)
        layer = [([*p, b], min(w, s)) for p, w in layer for (a, b), s in hops.items() if a == p[-1] and b not in seen]
        seen |= {p[-1] for p, _ in layer}
    return None


def test_shortest_paths_equal_listed_routes(spark):
    schema = "source string, target string, relation string, confidence string, confidence_score double, source_file string"
    for seed in range(3):
        drawn = random.Random(seed)
        rows = [(f"n{drawn.randrange(14)}", f"n{drawn.randrange(14)}", "calls", "INFERRED", drawn.choice([None, 0.2, 0.5, 0.9]), "") for _ in range(22)]
        edges = spark.createDataFrame(rows, schema)
        for directed in (False, True):
            hops = {}
            for a, b, _, _, s, _ in rows:
                for x, y in [(a, b)] if directed else [(a, b), (b, a)]:
                    if x != y:
                        hops[x, y] = max(hops.get((x, y), 0), 0.7 if s is None else s)
            for ends in (("n0", "n9"), ("n3", "n3"), ("n1", "n12")):
                got = [tuple(r) for r in traverse.shortest_path(edges, *ends, directed).collect()]
                want = routes_of(hops, *ends)
                assert got == ([] if want is None else [want])


def test_paths_do_not_spread_a_hub_that_the_other_end_goes_round(spark, monkeypatch):
    links = [("s", "hub"), ("s", "a"), ("a", "b"), ("b", "t")] + [(f"l{k}", "hub") for k in range(500)] + [(f"l{k}", f"m{k}") for k in range(500)]
    edges = spark.createDataFrame([(a, b, "calls", "EXTRACTED", None, "") for a, b in links], "source string, target string, relation string, confidence string, confidence_score double, source_file string")
    sizes, plain = [], traverse.cut
    monkeypatch.setattr(traverse, "cut", lambda df: (out := plain(df), sizes.append(out.count()))[0])
    assert [tuple(r) for r in traverse.shortest_path(edges, "s", "t").collect()] == [(["s", "a", "b", "t"], 3, 0.9, 1)]
    assert max(sizes) <= 4


def test_diffs_shuffle_each_row_once(spark):
    (n, e, ns, es), (m, f, ms, fs) = drawn_graph(spark, 1), drawn_graph(spark, 2, 30)
    with by_shuffle(spark):
        df = merge.diff_graphs(ns, es, ms, fs)
        got = {r["what"]: r["n"] for r in df.collect()}
        assert shuffled(df) <= len(n) + len(e) + len(m) + len(f) + 20
    want = {}
    for what, old, new in (("nodes", [r[:1] for r in n], [r[:1] for r in m]), ("edges", [r[:3] for r in e], [r[:3] for r in f])):
        for name, a, b in (("added", new, old), ("removed", old, new)):
            want[f"{what}_{name}"] = sum(None in r or r not in set(b) for r in set(a))
    assert got == want


def test_diagnoses_shuffle_edges_once(spark):
    n, e, ns, es = drawn_graph(spark, 3, 60)
    e += e[:9]
    es = spark.createDataFrame(e, EDGES)
    with by_shuffle(spark):
        df = analytics.diagnose(ns, es)
        got = {r["what"]: r["n"] for r in df.collect()}
        assert shuffled(df) <= len(e) + 30
    ids, ends = {r[0] for r in n} - {None}, {x for r in e for x in r[:2]} - {None}
    lost = sum(a not in ids or b not in ids for a, b, *_ in e)
    twice = sum(k > 1 for k in Counter(r[:3] for r in e).values())
    assert got == {"self_loops": sum(a == b is not None for a, b, *_ in e), "dangling_edges": lost, "duplicate_edges": twice, "unlinked_nodes": sum(r[0] not in ends for r in n), "type:entity": len(n)}


def test_surprising_connections_look_up_labels_of_what_is_shown(spark):
    n, e, ns, es = drawn_graph(spark, 4)
    with by_shuffle(spark):
        df = analytics.surprising_connections(ns, es, 5)
        got = [tuple(r) for r in df.collect()]
        assert shuffled(df) <= 20
    at, size = {r[0]: r for r in n if r[0] and r[4] is not None}, Counter(r[4] for r in n if r[4] is not None)
    met = [(a, b, r) for a, b, r, *_ in e if a in at and b in at and at[a][4] != at[b][4]]
    between = Counter(frozenset((at[a][4], at[b][4])) for a, b, _ in met)
    score = lambda a, b: min(size[at[a][4]], size[at[b][4]]) / between[frozenset((at[a][4], at[b][4]))]
    want = sorted(met, key=lambda t: (-score(t[0], t[1]), t))[:5]
    assert got == [(a, at[a][1], b, at[b][1], r, at[a][4], at[b][4], score(a, b)) for a, b, r in want]


def test_entities_that_can_meet_none_get_no_bands(spark, monkeypatch):
    @F.pandas_udf("array<long>")
    def bands(labels: pd.Series) -> pd.Series:
        assert not labels.str.contains("777").any()
        return labels.map(lambda s: [1])

    monkeypatch.setattr(identity, "band_keys", bands)
    labels = ["Acme Holdings 777", "Acme Holdings 12", "Acme Holding 12", "Blue Harbour", "Blue Harbor"]
    nodes = spark.createDataFrame([(f"n{k}", x, "entity", "f", 1) for k, x in enumerate(labels)], "id string, label string, file_type string, source_file string, community long")
    got = {(r["id"], r["survivor"]) for r in identity.merge_map(nodes).collect()}
    assert got == {("n1", "n2"), ("n3", "n4")}


def test_documents_are_handed_on_in_slices(spark):
    class Files:
        sparkSession = spark

        def select(self, *_):
            return self

        def mapInPandas(self, read, schema):
            return read

    texts = ["word " * (prose.SLICE // 20)] * 30
    read = prose.extract(Files())
    out = list(read(iter([pd.DataFrame({"path": [f"d{k}.md" for k in range(30)], "text": texts})])))
    assert [p for f in out for p in f["file_path"]] == [f"d{k}.md" for k in range(30)] and len(out) == 6


def test_merged_graphs_keep_what_has_nodes(spark):
    n, e, _, _ = drawn_graph(spark, 6)
    n = [r if k % 4 else (*r[:3], "", r[4]) for k, r in enumerate(n) if r[0]]
    ns, es = spark.createDataFrame(n, "id string, label string, file_type string, source_file string, community long"), spark.createDataFrame(e, EDGES)
    with by_shuffle(spark):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        nodes, edges = merge.merge_graphs([("a", ns, es), ("b", ns, es)])
        got = sorted(tuple(r) for r in edges.select("source", "target", "relation").collect())
        edges.collect()
        assert shuffled(edges) <= 2 * len(e)
    new = {(tag, i): f"{tag}::{i}" if file else f"stub::{label.lower()}" for i, label, _, file, _ in n for tag in "ab"}
    assert got == sorted({(new[t, a], new[t, b], r) for a, b, r, *_ in e for t in "ab" if (t, a) in new and (t, b) in new and a != b})
    assert sorted(r["id"] for r in nodes.collect()) == sorted(set(new.values()))

"""Mixing, sharding, URL filters and quality rules against plain Python."""

import collections
import glob
import hashlib
import math
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from weft.llm import mixing, quality, sharding, urls

DOC = "doc_id long, text string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame(rows, DOC)


def some_docs(n=240):
    rows = [(k, " ".join(["w"] * (k % 17)), ["a", "b", None, "ü", "hot", "hot", "hot"][k % 7]) for k in range(n)]
    return [*rows, (None, "x y", "a"), (5, None, "b"), (5, None, "b"), (6, "", "hot"), (7, "\u00a0nb sp\x0b", "b"), (8, "long " * 5000, "ü")]


def brute_targets(sizes, epochs=1.5):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, open_, target = epochs * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_mixing_matches_water_filling(spark):
    rows = some_docs()
    got = mixing.plan_mix(docs(spark, rows)).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = brute_targets(sizes)
    for r in got:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9) and 0 <= r["copies"] <= 2
    assert math.isclose(sum(want.values()), 1.5 * sum(sizes.values()))
    assert len(got) == len(rows)
    again = mixing.plan_mix(docs(spark, rows).repartition(7)).collect()
    key = lambda x: sorted((str(r["doc_id"]), str(r["text"]), r["copies"]) for r in x)
    assert key(again) == key(got)


def test_taken_words_come_near_targets(spark):
    rows = [(k, "w " * (1 + k % 9), f"s{k % 4}") for k in range(4000)]
    got = mixing.plan_mix(docs(spark, rows)).groupBy("source").agg(F.max("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("n")).collect()
    assert all(abs(r["n"] - r["t"]) < 0.06 * r["t"] for r in got)


def test_mix_emits_copies_and_keeps_columns(spark):
    d = docs(spark, some_docs()).select("*", *[F.lit("mine").alias(c) for c in ("size", "target", "rate", "copies", "source_size", "mix_key", "mix_copy", "mix_doc")])
    mixed = mixing.mix_sources(d)
    assert mixed.columns == d.columns and {tuple(r)[3:] for r in mixed.collect()} == {("mine",) * 8}
    assert mixed.count() == mixing.plan_mix(d).agg(F.sum("copies")).first()[0]
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    assert mixing.plan_mix(docs(spark, [(1, None, None)])).first()["target"] == 0.0


def test_fisher_yates_is_a_permutation_by_swaps(spark):
    got = spark.createDataFrame([(n, n * 3) for n in (1, 2, 7, 40)], "n int, bucket long").select("n", "bucket", sharding._fisher_yates(F.col("n"), F.col("bucket"), 11).alias("deck")).collect()
    for r in got:
        deck = list(range(r["n"]))
        for i in range(r["n"] - 1, 0, -1):
            j = spark.range(1).select(F.pmod(F.xxhash64(F.lit(12), F.lit(r["bucket"]).cast("long"), F.lit(i)), F.lit(i + 1).cast("long"))).first()[0]
            deck[i], deck[j] = deck[j], deck[i]
        assert r["deck"] == deck


@pytest.mark.parametrize("n", [0, 1, 39, 40, 1000])
def test_shards_are_even_and_gapless(spark, n):
    rows = [(k if k % 3 else 0, "é" * (k % 5) if k % 4 else None, None) for k in range(n)]
    d = sharding.record_digest(docs(spark, rows))
    out = sharding.shard_records(d, ["doc_id", "size", "text_crc32"], bucket_rows=16)
    got = out.collect()
    assert len(got) == n and {r["law"] for r in got} <= {"rows"}
    shards = collections.defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    counts = [len(shards.get(k, [])) for k in range(40)]
    assert max(counts) - min(counts) <= 1 and set(shards) <= set(range(40))
    want = collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    again = sharding.shard_records(d.repartition(5), ["doc_id", "size", "text_crc32"], bucket_rows=16).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)


def test_one_row_repeated_and_large_texts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "REPEATS", 1000)
    hot = spark.range(200_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    d = hot.unionByName(spark.createDataFrame([(1, "é" * 5_000_000), (2, None)], "doc_id long, text string"))
    got = sharding.shard_records(d, ["doc_id", "text"]).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m"), F.countDistinct("slot").alias("k")).collect()
    assert len(got) == 40 and {r["n"] for r in got} <= {5000, 5001} and all(r["m"] + 1 == r["n"] == r["k"] for r in got)
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 1 << 20)
    few = sharding.shuffle_records(d.filter("doc_id < 3"), ["doc_id", "text"])
    assert sorted(r["place"] for r in few.select("place").collect()) == [0, 1]


def test_shards_of_columns_of_any_name(spark):
    names = ["key", "bucket", "nth", "same", "n", "at", "cards", "deck", "pos", "card", "record", "block", "part"]
    d = docs(spark, some_docs(50)).select("*", *[F.lit(3).alias(c) for c in names])
    out = sharding.shard_records(d, d.columns, bucket_rows=8)
    assert out.columns == [*d.columns, "law", "shard", "slot"]
    plain = lambda x: sorted((str(r["doc_id"]), str(r["text"]), r["deck"]) for r in x.collect())
    assert plain(out) == plain(d)


def test_shards_are_written_in_order(spark, tmp_path):
    d = docs(spark, [(k, f"t{k}", "s") for k in range(90)])
    sharding.write_shards(d, str(tmp_path / "s"), 4, 16)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 90 and set(back.columns) == {"doc_id", "text", "source", "law", "slot", "shard"}
    order = [r["doc_id"] for r in back.orderBy("shard", "slot").collect()]
    assert order != sorted(order)


def test_sharding_query_writes_whole_records(spark, tmp_path):
    from weft.llm.queries import QUERIES
    from weft.plans.runtime import checkpoint_dir

    folders = lambda: set(glob.glob(checkpoint_dir(spark).removeprefix("file:") + "/shards-*"))
    for k, rows in enumerate((some_docs(100), [])):
        docs(spark, rows).write.parquet(str(tmp_path / str(k) / "documents.parquet"))
        before = folders()
        out = QUERIES["op6_sharding"](spark, str(tmp_path / str(k)))
        (made,) = folders() - before
        assert dict(out.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
        back = sharding.read_shards(docs(spark, []), made).collect()
        key = lambda x: sorted(map(repr, x))
        assert key((r["doc_id"], r["text"], r["source"]) for r in back) == key(rows)
        crc = lambda t: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
        want = [(r["doc_id"], *crc(r["text"]), "rows", r["shard"], r["slot"], None) for r in back]
        assert key(map(tuple, out.collect())) == key(want)
        assert len({(r["shard"], r["slot"]) for r in back}) == len(rows)


@pytest.mark.parametrize(("url", "host", "path", "rule", "verdict"), [
    ("http://A.Example.COM/en/70?x#y", "a.example.com", "/en/70", "example.com/en/7", "allow"), ("x://shop.com/en/1", "shop.com", "/en/1", "com/en/", "block"),
    ("http://notexample.net/de/8", "notexample.net", "/de/8", "net/de/", "allow"), ("http://example.net/de/81", "example.net", "/de/81", "example.net/de/8", "block"),
    ("http://org?/es/", "org", "", None, "allow"), ("no scheme/en/", "", "", None, "allow"), (None, "", "", None, "allow"), ("://com/en/#", "com", "/en/", "com/en/", "block"),
    ("http://a\nb.org/es/\nq", "a\nb.org", "/es/\nq", "org/es/", "block"), ("http://É.COM/en/", "É.com", "/en/", "com/en/", "block"),
])
def test_url_rules(spark, url, host, path, rule, verdict):
    r = urls.judge_urls(spark.createDataFrame([(1, url, "<p>")], "page_id long, url string, html string")).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def test_verdicts_spread_over_aliases(spark):
    link = lambda u: f"<LINK href='{u}' rel='x canonical'>"
    rows = [
        (1, "http://a.site/1", link("http://b.com/en/1")), (2, "http://c.site/2#frag", '<meta http-equiv="refresh" content="0; url=/3">'), (3, "HTTP://C.site/3", link("http://b.com/en/1")),
        (4, "http://d.site/4", link("http://b.com/en/2") + link("http://x.net/de/1")), (5, "http://b.com/en/2", ""), (6, "http://free.site/", None), (7, None, link("http://b.com/en/1")),
    ]
    d = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string").withColumn("rule", F.lit(1))
    got = urls.judge_urls(d)
    assert {r["page_id"]: r["verdict"] for r in got.collect()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "allow", 7: "allow"}
    assert got.count() == 8
    log = spark.createDataFrame([("http://free.site/", "http://b.com/en/9")], "src string, dst string")
    assert urls.judge_urls(d, redirects=log).filter("page_id = 6").first()["verdict"] == "block"
    assert urls.judge_urls(d.limit(0)).count() == 0


#: Of RFC 3986, section 5.4, with the base http://a/b/c/d;p?q.
RESOLVED = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y",
    "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", ";x": "http://a/b/c/;x", ".": "http://a/b/c/", "./": "http://a/b/c/",
    "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "/./g": "http://a/g",
    "/../g": "http://a/g", "g.": "http://a/b/c/g.", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/../h": "http://a/b/c/h", "g?y/../x": "http://a/b/c/g?y/../x",
}


def test_links_resolve_as_the_standard_says(spark):
    df = spark.createDataFrame(list(RESOLVED.items()), "link string, want string")
    got = df.withColumn("got", urls._absolute(F.col("link"), F.lit("http://a/b/c/d;p?q"))).collect()
    assert [(r["link"], r["got"]) for r in got] == [(r["link"], r["want"]) for r in got]


@pytest.mark.parametrize(("html", "link"), [
    ('<link rel="canonical" href="http://b.com/en/?a=1&amp;b=2">', "http://b.com/en/?a=1&b=2"), ("<link rel=canonical href=/x&#47;y&#x2F;z>", "http://p.q/x/y/z"),
    ('<link data-href="/no" href=\'/yes"\' rel="alternate canonical">', 'http://p.q/yes"'), ('<link href="/no" rel="canonicals">', None), ('<link data-rel="canonical" href="/no">', None),
    ('<meta content="5; URL=\'../up\'" http-equiv=Refresh>', "http://p.q/up"), ('<meta http-equiv="refresh" content="5">', None), ('<link rel="canonical" href="/&#xD800;&#0;&#;&copy;">', "http://p.q/&"), ("<link rel=canonical href=''>", None),
])
def test_links_of_pages(spark, html, link):
    page = spark.createDataFrame([("http://p.q/a/b?c", html)], "url string, html string")
    assert [r["dst"] for r in urls.alias_edges(page).collect()] == ([link] if link else [])


def test_verdicts_of_chains_match_brute_force(spark):
    """Pages with canonical links and refreshes in chains and rings, and columns of clashing names; by search over the graph."""
    import random

    r = random.Random(4)
    url = lambda k: f"http://{('a.site', 'b.com', 'example.com', 'c.net', 'd.org')[k % 5]}/{('x', 'en', 'de', 'es')[k % 4]}/{k}"
    edges, rows = collections.defaultdict(set), []
    for k in range(150):
        html, to = "", r.choice([None, None, k - 1, r.randrange(220)])
        if to is not None and to >= 0:
            html = r.choice(['<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">']).format(url(to))
            edges[url(k)].add(url(to))
            edges[url(to)].add(url(k))
        rows.append((k, url(k), html))

    def verdict(u):
        host, path = re.match(r"http://([^/]*)(.*)", u).groups()
        fit = [x for x in urls.RULES if (host == x[1] or host.endswith("." + x[1])) and path.startswith(x[2])]
        return max(fit, key=lambda x: len(x[1] + x[2]))[0] if fit else None

    def judged(u):
        seen, todo = {u}, [u]
        while todo:
            for v in edges[todo.pop()] - seen:
                seen.add(v)
                todo.append(v)
        votes = {verdict(v) for v in seen}
        return verdict(u) or ("allow" if "allow" in votes else "block" if "block" in votes else "allow")

    df = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit(1).alias(c) for c in ("own_key", "own_match", "url_node", "url_page", "spread_verdict", "verdict")])
    got = urls.judge_urls(df)
    assert got.columns == [*df.columns[:-1], "host", "path", "rule", "verdict"]
    assert {x["page_id"]: x["verdict"] for x in got.collect()} == {k: judged(u) for k, u, _ in rows}
    assert sum(judged(u) == "block" and verdict(u) is None for _, u, _ in rows) > 3


def brute_quality(text):
    words = WORD.findall(text or "")
    seen = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def texts():
    base = " ".join(f"wörd{k}" for k in range(60))
    return [None, "", " \n\t", "a b c a b c a b", base, base + "\n" + base, "l1\nl1\nl2\n\n\n l1", "# $ x|y <b> *", "z " * 400, base + " a b c d a b c", "a b c b c a b c", "x\u00a0y " * 60, base.upper() + "!!"]


def test_quality_features_and_ratio(spark):
    rows = [(k, t, "s") for k, t in enumerate(texts())] + [(4, texts()[4], "s")]
    targets = spark.createDataFrame([(4,), (4,), (9,), (None,), (77,)], "doc_id long")
    got = quality.judge_quality(docs(spark, rows).withColumn("words", F.lit(1)), targets, buckets=64, prior=2.0).collect()

    def bucket(*w):
        seed = 42
        for x in w:
            seed = xxhash.xxh64_intdigest(x.encode(), seed)
        return (seed - (1 << 64) if seed >= 1 << 63 else seed) % 64

    def grams(t):
        w = WORD.findall(t or "")
        return [bucket(x) for x in w] + [bucket(*p) for p in zip(w, w[1:], strict=False)]

    c, t = collections.Counter(), collections.Counter()
    for i, x, _ in rows:
        c.update(grams(x))
        if i in (4, 9):
            t.update(grams(x))
    q = sum(t.values()) / sum(c.values())
    assert len(got) == len(rows)
    for r in got:
        n, chars, symbols, dups, repeats, failed = brute_quality(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (n, chars, symbols, dups, repeats, failed), r["text"]
        g = grams(r["text"])
        llr = sum(math.log((t[b] + 2 * q) / (q * (c[b] + 2))) for b in g) / len(g) if g else 0.0
        assert abs(r["llr"] - llr) < 1e-5 and r["kept"] == (not failed and r["llr"] >= quality.THRESHOLD)


def test_quality_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert quality.judge_quality(docs(spark, []), none).count() == 0
    assert quality.judge_quality(docs(spark, [(1, texts()[4], None)]), none).first()["llr"] == 0.0


def test_hash_fraction_is_md5(spark):
    got = spark.range(1).select(mixing.hex_fraction(F.lit("7"), F.lit("12")).alias("f")).first()["f"]
    assert got == int(hashlib.md5(b"7|12").hexdigest()[:13], 16) / 16**13

"""Ranked retrieval: a lexical index, scores, seeds, and pages under a token budget."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from weft.functions.similarity import jaro_winkler
from weft.functions.text import is_test_path, salient, stem, tokens

#: Fixed values of the scores.
LABEL_EXACT, LABEL_FULL, LABEL_PART, DOC, CHUNK_DOC, PATH_PART, FUZZY, FUZZY_LEAST = 4.0, 2.0, 0.5, 0.35, 1.1, 0.55, 0.15, 0.9
ID_SCOPE, ID_PART, IDF_LEAST = 4.0, 1.0, 0.25


def lexical_index(nodes: DataFrame, doc_tokens: int = 400) -> DataFrame:
    """The token arrays that scores are made of, of label, docstring, id and path, and their stems without repeats."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    index = nodes.select(
        "id", "label", "file_type", "source_file",
        tokens(text("label")).alias("label_tokens"), F.slice(tokens(text("docstring")), 1, doc_tokens).alias("doc_tokens"),
        tokens(text("id")).alias("id_tokens"), tokens(text("source_file")).alias("path_tokens"),
    )
    kinds = ("label", "doc", "id", "path")
    return index.withColumns({f"{k}_stems": F.array_distinct(F.transform(f"{k}_tokens", stem)) for k in kinds})


def document_frequency(index: DataFrame) -> DataFrame:
    """(stem, df): nodes that have a stem in their label, docstring or id."""
    stems = F.array_distinct(F.concat("label_stems", "doc_stems", "id_stems"))
    return index.select(F.explode(stems).alias("stem")).groupBy("stem").agg(F.count("*").alias("df"))


def idf(df: Column, n: Column) -> Column:
    """How rare a stem is, from 0.25 to 1; 1 where no node has it."""
    rare = F.log(n / df) / F.greatest(F.log(n), F.lit(1.0))
    return F.when(df > 0, F.least(F.lit(1.0), F.greatest(F.lit(IDF_LEAST), rare))).otherwise(F.lit(1.0))


def question_terms(spark: SparkSession, question: str) -> list[str]:
    """The question's tokens that carry a signal, without repeats."""
    row = spark.createDataFrame([(question,)], "q string").select(F.array_distinct(salient(tokens(F.col("q")))).alias("t")).first()
    return row["t"]


def _has(kind: str, stemmed: str) -> Column:
    """1.0 where a word of that kind has the stem; an equal word has an equal stem."""
    return F.array_contains(f"{kind}_stems", stemmed).cast("double")


def _stem(term: str) -> str:
    n = len(term.encode())
    if n > 4 and term.endswith("ies"):
        return term[:-3]
    return term[:-1] if n > 3 and term.endswith("s") and not term.endswith("ss") else term


def score_nodes(index: DataFrame, frequencies: DataFrame, question: str) -> DataFrame:
    """(id, label, score) of the nodes that match any term of the question.

    For each term, the best of label and docstring, the id, the path, or else a fuzzy label count,
    weighed by the term's rarity. Sums shrink where few terms, or few of the rarest, are matched.
    Terms are few and known, so they are columns: one pass over the index, without a join. Two small
    reads, of the index's size and of the terms' frequencies, come before.
    """
    spark = index.sparkSession
    terms = question_terms(spark, question)
    if not terms:
        return index.select("id", "label", *[F.lit(0.0).alias(c) for c in ("score", "share", "rare")]).limit(0)
    n = index.count()
    known = {r["stem"]: r["df"] for r in frequencies.filter(F.col("stem").isin([_stem(t) for t in terms])).collect()}
    rarity = {t: 1.0 if not known.get(_stem(t)) else min(1.0, max(IDF_LEAST, math.log(n / known[_stem(t)]) / max(math.log(n), 1.0))) for t in terms}
    k = min(3, max(1, math.ceil(len(terms) / 4)))
    rarest = sorted(terms, key=lambda t: (-rarity[t], t))[:k]
    chunk = F.col("file_type") == "chunk"
    lowered = F.lower("label")
    parts, matched, rare_matched = [], [], []
    for term in terms:
        s = _stem(term)
        share = _has("label", s) / F.greatest(F.size("label_tokens"), F.lit(1))
        label = F.when(lowered == term, LABEL_EXACT).when(share >= 1, LABEL_FULL).when(chunk, 0.0).otherwise(LABEL_PART * share * share)
        doc = _has("doc", s) * F.when(chunk, CHUNK_DOC).otherwise(DOC)
        last = F.lower(F.element_at(F.split("id", "::"), -1))
        own = F.when(last == term, ID_SCOPE).otherwise(_has("id", s) * ID_PART / F.greatest(F.size("id_tokens"), F.lit(1)))
        path = _has("path", s) * PATH_PART
        plain = F.greatest(label, doc) + own + path
        # Beyond twice the other's length, no label is so similar.
        comparable = F.when(F.length(lowered).between(len(term) // 2, 2 * len(term)), lowered)
        close = F.when(plain > 0, 0.0).otherwise(F.when(jaro_winkler(comparable, F.lit(term)) > FUZZY_LEAST, FUZZY).otherwise(0.0)) if len(term) > 3 else F.lit(0.0)
        got = plain + close
        parts.append(got * rarity[term])
        matched.append((got > 0).cast("int"))
        if term in rarest:
            rare_matched.append((got > 0).cast("int"))
    total = sum(parts[1:], parts[0])
    share = sum(matched[1:], matched[0]) / F.lit(len(terms))
    rare = sum(rare_matched[1:], rare_matched[0]) / F.lit(k)
    prior = (
        F.when(F.col("file_type").isin("stub", "reference"), 0.05).when(F.col("file_type") == "test", 0.4)
        .when(chunk, 0.45).when(F.col("file_type") == "document", 0.55).when(F.col("file_type").isin("concept", "entity"), 0.55).otherwise(1.0)
    )
    scored = index.withColumn("score", total * (0.8 + 0.2 * share) * (0.6 + 0.4 * rare) * prior)
    scored = scored.withColumn("share", share).withColumn("rare", rare)
    return scored.filter("score > 0").select("id", "label", "score", "share", "rare")


def confident(scores: DataFrame) -> bool:
    """Whether any node has one of the rarest terms, or any has half of all terms; else hits are incidental words."""
    row = scores.agg(F.max("rare").alias("rare"), F.max("share").alias("share")).first()
    return bool(row["rare"]) or (row["share"] or 0) >= 0.5


#: Word sequences that ask for the file that execution starts from, and the imports it has at least.
ENTRY_PHRASES, ENTRY_IMPORTS = (("entry", "point"), ("entrypoint",), ("main", "file"), ("starting", "point")), 3


def asks_for_entry(spark: SparkSession, question: str) -> bool:
    words = [_stem(w) for w in spark.createDataFrame([(question,)], "q string").select(tokens(F.col("q")).alias("t")).first()["t"]]
    runs = lambda n: {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
    return any(tuple(_stem(w) for w in phrase) in runs(len(phrase)) for phrase in ENTRY_PHRASES)


def entry_files(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label, score) of files that import several modules and that nothing imports; tests aren't entries."""
    imports = edges.filter("relation = 'imports'")
    out = imports.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n")).filter(F.col("n") >= ENTRY_IMPORTS)
    free = out.join(imports.select(F.col("target").alias("id")), "id", "left_anti")
    located = nodes.filter((F.coalesce("source_file", F.lit("")) != "") & ~is_test_path(F.col("source_file")))
    return located.join(free, "id").select("id", "label", (LABEL_EXACT + F.log1p("n")).alias("score"))


def seeds(scores: DataFrame, semantic: DataFrame | None = None, k: int = 5) -> DataFrame:
    """The best ``k`` nodes; a node found by its vector counts with the better of both scores."""
    both = scores.select("id", "score")
    if semantic is not None:
        both = both.unionByName(semantic.select("id", "score"))
    return both.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def did_you_mean(nodes: DataFrame, question: str, k: int = 3, least: float = 0.6) -> DataFrame:
    """The labels nearest to any term of the question, by Jaro-Winkler similarity."""
    terms = question_terms(nodes.sparkSession, question)
    best = F.lit(0.0)
    for term in terms:
        best = F.greatest(best, jaro_winkler(F.lower("label"), F.lit(term)))
    return nodes.select("label", best.alias("similarity")).distinct().filter(F.col("similarity") > least).orderBy(F.desc("similarity"), "label").limit(k)


def interleave(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One sequence of two node records to an edge record: (position, kind, record) of (nth, record) frames."""
    n, e = nodes.count(), edges.count()
    a = nodes.select((F.col("nth") + F.least(F.floor(F.col("nth") / 2), F.lit(e))).cast("long").alias("position"), F.lit("node").alias("kind"), "record")
    b = edges.select((F.col("nth") + F.least(2 * (F.col("nth") + 1), F.lit(n))).cast("long").alias("position"), F.lit("edge").alias("kind"), "record")
    return a.unionByName(b)


def page(records: DataFrame, budget: int, cursor: int = 0, overhead: int = 24) -> DataFrame:
    """The whole records from ``cursor`` on that fit the budget of tokens (four bytes each), in order.

    The running sum is over the records after the cursor whose own size could fit, which are at most
    four times the budget in bytes: the window's input is bounded by the budget, not by the result.
    """
    later = records.filter(F.col("position") >= cursor).orderBy("position").limit(max(1, 4 * budget))
    order = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = F.sum(F.octet_length("record") + 1).over(order)
    fitting = later.withColumn("used", used).filter(F.ceil(F.col("used") / 4) + overhead <= budget)
    if fitting.isEmpty() and not later.isEmpty():
        raise ValueError("the budget holds no whole record")
    return fitting.drop("used")

"""Quality rules: counted features, and a hashed n-gram log-likelihood ratio of target over corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weft.llm.common import SPACES, let, words_of

#: Hash buckets of the two multinomials: the model is one array of so many floats, whatever the corpus.
#: The array (64 KB) passes by every document, so it stays small beside the texts' own cost.
BUCKETS = 1 << 14
#: Corpus occurrences with which a bucket's ratio is drawn towards 1.
PRIOR = 20.0
#: Documents whose mean log-likelihood ratio is lower are not kept. Learned from half of check_s's labels, this
#: keeps every good document of the other half, and 0.986 of what is kept there is good (-0.1: 0.966, 0: 0.998
#: of them, but only 0.83 of the good ones; with 2**17 buckets 0.999).
THRESHOLD = -0.05
#: Largest number of target ids sent to every executor (8 bytes each); above, the join shuffles.
BROADCAST_IDS = 4_000_000


def _repeat_words(words: Column, windows: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more; ``windows``: hashes of all windows.

    Windows are compared by 64-bit hashes. Only texts with a repeated hash are looked at closely:
    their windows are sorted by hash, neighbours of equal hash are repeats, and the union of the
    repeats is measured from one start to the next.
    """
    zero = F.lit(0).cast("long")

    def starts(s: Column) -> Column:
        def hit(x: Column, k: Column) -> Column:
            same = (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
            return F.when(F.coalesce(same, F.get(s, k - 1)["h"] == x["h"], F.get(s, k + 1)["h"] == x["h"]), x["i"])

        return F.sort_array(F.filter(F.transform(s, hit), lambda i: i.isNotNull()))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3))))
        return F.aggregate(steps, zero, lambda a, x: a + x)

    close = let(
        F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        lambda s: let(starts(s), covered),
    )
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), zero).otherwise(close)


def base_features(docs: DataFrame) -> DataFrame:
    """``docs`` with words (array) and the counted features of the whole text; see ``judge_quality``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.col("words")
    n = F.size(words)
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, SPACES, "") != "")
    windows = F.when(
        n >= 3,
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    out = docs.withColumn("words", words_of(F.col("text"))).withColumn("line_list", lines).withColumn("window_list", windows)
    out = (
        out.withColumn("n_words", n.cast("long"))
        .withColumn("word_chars", F.length(F.translate(text, SPACES, "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("line_list") - F.size(F.array_distinct("line_list"))).cast("long"))
        .withColumn("n_repeat_words", _repeat_words(words, F.col("window_list")))
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("line_list", "window_list")


def _grams(words: Column, buckets: int) -> Column:
    """Hash buckets of all words and of all pairs of adjacent words: a pair is hashed as two words, not as two hashes."""
    n = F.lit(buckets).cast("long")
    one = F.transform(words, lambda w: F.pmod(F.xxhash64(w), n).cast("int"))
    two = F.transform(
        words, lambda w, i: F.pmod(F.xxhash64(w, F.get(words, i + 1)), n).cast("int")
    )
    return F.concat(one, F.slice(two, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))))


def likelihood_model(docs: DataFrame, target_ids: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> DataFrame:
    """One row with ``model``, an array of ``buckets`` log-likelihood ratios of target over corpus.

    Counts are of all documents. With t and c of a bucket's occurrences in the target and the corpus,
    and q the target's share of all occurrences, the ratio is (t + prior q) / (q (c + prior)). The
    counts meet as at most ``buckets`` partial sums a task. Without target or corpus, all are 0.
    """
    ids = target_ids.select(F.col("doc_id").alias("target_id")).filter("target_id IS NOT NULL").distinct()
    if target_ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    flagged = docs.join(ids, docs["doc_id"] == ids["target_id"], "left").select(
        F.col("target_id").isNotNull().cast("long").alias("hit"), words_of(F.col("text")).alias("words")
    )
    counted = (
        flagged.select("hit", F.explode(_grams(F.col("words"), buckets)).alias("bucket"))
        .groupBy("bucket")
        .agg(F.sum("hit").alias("t"), F.count("*").alias("c"))
    )
    spark = docs.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(counted, "bucket", "left").fillna(0, ["t", "c"])
    packed = full.agg(
        F.sort_array(F.collect_list(F.struct("bucket", "t", "c"))).alias("cells"), F.sum("t").alias("ts"), F.sum("c").alias("cs")
    )
    q = F.col("ts") / F.col("cs")
    ratio = F.when(
        (F.col("ts") > 0) & (F.col("cs") > 0),
        F.transform("cells", lambda x: F.log((x["t"] + prior * q) / (q * (x["c"] + prior)))),
    ).otherwise(F.transform("cells", lambda x: F.lit(0.0)))
    return packed.select(ratio.cast("array<float>").alias("model"))


def judge_quality(
    docs: DataFrame, target_ids: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, prior: float = PRIOR
) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr and kept.

    llr is the mean, over all words and adjacent pairs of the whole text, of their buckets' log-
    likelihood ratios; a document is kept if the base rules don't fail it and llr >= threshold, the
    same for every document. Columns of the new names are replaced. A null or empty text has no words
    and so fails; repeated rows are judged alike and each counts in the corpus; a null doc_id is never
    in the target; an empty table gives an empty result. Nothing is shuffled but the buckets' counts
    (and the documents, only where more than BROADCAST_IDS ids are in the target).
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept", "words", "line_list", "window_list", "target_id", "hit", "gram_list", "llr_model"]
    docs = docs.drop(*new)
    model = likelihood_model(docs, target_ids, buckets, prior).scalar()
    rated = base_features(docs).withColumn("gram_list", _grams(F.col("words"), buckets)).withColumn("llr_model", model)
    total = F.aggregate(F.col("gram_list"), F.lit(0.0), lambda a, b: a + F.get(F.col("llr_model"), b))
    n = F.size("gram_list")
    rated = rated.withColumn("llr", F.when(n > 0, total / n).otherwise(F.lit(0.0))).drop("words", "gram_list", "llr_model")
    return rated.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))

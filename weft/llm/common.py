"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Fixed value: the characters that separate words, \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` has it inside lambda functions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of runs of non-space characters; null counts 0. Linear, without an array of the words."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), f"{WORD_CLASS}++", "x")
    return F.length(F.translate(marks, SPACES, "")).cast("long")


def words_of(text: Column) -> Column:
    """The words as an array, in order; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+")
    return F.filter(parts, lambda w: w != "")


def hex_fraction(*parts) -> Column:
    """A double in [0, 1) that depends on the parts alone: 13 hex digits of their MD5."""
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


#: Bits of the filter that finds wanted rows again; it only saves work.
FILTER_BITS = 1 << 22


def row_hash() -> Column:
    """What tells rows apart whose doc_id is null or the same: a hash of the id and the whole text."""
    return F.xxhash64(F.col("doc_id"), "text")


def marked(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, name: str, bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` with a boolean ``name``: false where the key isn't among the wanted keys; true where it is, or rarely else.

    What is false can be left out of a shuffle. A bitmap of hashes of at most bits / 64 rows is broadcast.
    """
    slot_of = lambda c: F.pmod(F.xxhash64(c), F.lit(bits).cast("long"))
    words = wanted.select(slot_of(wanted_key).alias("slot")).select(F.expr("slot div 64").alias("may_at"), F.expr("shiftleft(1L, cast(slot % 64 as int))").alias("bit"))
    words = words.groupBy("may_at").agg(F.bit_or("bit").alias("may_word"))
    slotted = rows.withColumn("may_slot", slot_of(key))
    met = slotted.join(F.broadcast(words), F.expr("may_slot div 64 = may_at"), "left")
    bit = F.expr("shiftrightunsigned(coalesce(may_word, 0L), cast(may_slot % 64 as int)) & 1L")
    return met.withColumn(name, bit == 1).drop("may_slot", "may_at", "may_word")


def breathe() -> None:
    """Give memory that is free in this worker back: workers stay, and others share the executor's limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def series_udf(work: Callable[[pd.Series], pd.Series], kind: str, done: Callable[[], None] | None = None):
    """A pandas UDF of one column that runs ``work`` on each batch; ``done`` drops what a task has kept, before its worker waits for the next."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for batch in batches:
                yield work(batch)
                breathe()
        finally:
            if done:
                done()
                breathe()

    return F.pandas_udf(run, kind)


def frame_udf(work: Callable[[pd.Series], pd.DataFrame], kind: str, done: Callable[[], None] | None = None):
    """As ``series_udf``, for a struct of columns."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        try:
            for batch in batches:
                yield work(batch)
                breathe()
        finally:
            if done:
                done()
                breathe()

    return F.pandas_udf(run, kind)

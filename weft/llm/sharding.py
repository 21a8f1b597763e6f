"""Sharding by a two-pass external shuffle: a seeded scatter, then Fisher-Yates in each bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from weft.llm.common import marked
from weft.plans.runtime import cut

#: Buckets whose counts are summed in one window; the prefix over such groups is the only single task.
GROUP = 4096
#: Bytes of records in a bucket, on average; repeats of a record that are numbered at once.
BUCKET_BYTES, REPEATS = 8 << 20, 4096
#: Buckets up to which their offsets (24 bytes each) are broadcast; above, records are shuffled once more for them.
BROADCAST_BUCKETS = 1 << 20


def record_digest(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, size, text_crc32, *more): the record's bytes plus 16, and the text's CRC-32; null text counts as empty."""
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    return docs.select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), *more)


def _record_bytes(rows: DataFrame, carry: list[str]) -> Column:
    """About the bytes of a record: of its texts and binaries, other values by their JSON, and 16 for each column."""
    total = F.lit(16 * len(carry)).cast("long")
    for name in carry:
        kind = rows.schema[name].dataType.typeName()
        if kind in ("string", "binary", "varchar", "char"):
            total = total + F.coalesce(F.octet_length(F.col(name)), F.lit(0))
        elif kind in ("array", "map", "struct", "variant"):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(name)))), F.lit(0))
    return total


def _scatter(rows: DataFrame, n_buckets: int, seed: int) -> DataFrame:
    """(record, key, bucket), a row for each record; repeats of a record are told apart by a number.

    Equal records are counted first, on the map side too, so that a record repeated without bound is
    dealt over all buckets like any other. Its numbers are made REPEATS at a time. Records whose hash
    no other has are not shuffled for this.
    """
    own = F.xxhash64("record")
    again = cut(rows.groupBy(own.alias("hash")).agg(F.count("*").alias("n")).filter("n > 1").select("hash"))
    met = marked(rows, own, again, F.col("hash"), "again")
    once = met.filter(~F.col("again")).select("record", F.lit(1).cast("long").alias("nth"))
    counted = met.filter("again").groupBy("record").agg(F.count("*").alias("same"))
    blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(same - 1) div {REPEATS}"))))
    first = F.col("block") * REPEATS
    each = blocks.withColumn("nth", F.explode(F.sequence(first + 1, F.least(first + REPEATS, F.col("same")))))
    key = F.xxhash64(F.lit(seed), "record", "nth")
    return once.unionByName(each.select("record", "nth")).select("record", key.alias("key"), F.pmod(key, F.lit(n_buckets).cast("long")).alias("bucket"))


def _fisher_yates(size: Column, bucket: Column, seed: int) -> Column:
    """The indices 0 to size-1 after swaps of i, from the last down to 1, with a seeded j <= i."""
    start = F.transform(F.sequence(F.lit(0), size - 1), lambda i: i)
    steps = F.when(size > 1, F.sequence(size - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))

    def swap(deck: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(F.lit(seed + 1), bucket, i), (i + 1).cast("long")).cast("int")
        # Both values are looked up once, not for each card.
        hand = F.array(F.struct(deck.alias("deck"), F.get(deck, i).alias("a"), F.get(deck, j).alias("b"), j.alias("j")))
        dealt = F.transform(
            hand,
            lambda h: F.concat(
                F.slice(h["deck"], F.lit(1), h["j"]),
                F.when(h["j"] < i, F.array(h["a"])).otherwise(F.array().cast("array<int>")),
                F.when(h["j"] < i, F.slice(h["deck"], h["j"] + 2, i - h["j"] - 1)).otherwise(F.array().cast("array<int>")),
                F.array(h["b"]),
                F.slice(h["deck"], i + 2, size - i - 1),
            ),
        )
        return F.get(dealt, F.lit(0))

    return F.aggregate(steps, start, swap)


def shuffle_records(rows: DataFrame, carry: list[str], bucket_rows: int = 256, seed: int = 11) -> DataFrame:
    """``carry`` of every row, and its place in a random order of all rows: long ``place``, gapless from 0.

    First pass: rows go to buckets of about ``bucket_rows``, or of BUCKET_BYTES if that is less, by a
    seeded hash, which is uniform whatever the keys are; a bucket is small enough for one task's
    memory and for one array. Columns of ``carry`` may have any names and hold nulls. Second pass: each
    bucket is put in order of its keys, which undoes what order the rows arrived in, and Fisher-Yates
    is run on it. A bucket's offset is the number of rows in the buckets before it, summed in two
    levels; buckets are counted by hashes alone. Records are shuffled once, by ranges of buckets, so
    that partitions have runs of places, in order. Reruns and any partitioning agree. An empty table
    gives an empty result.
    """
    total, n_bytes = rows.agg(F.count("*"), F.coalesce(F.sum(_record_bytes(rows, carry)), F.lit(0))).first()
    n_buckets = max(1, -(-total // bucket_rows), -(-n_bytes // BUCKET_BYTES))
    dealt = _scatter(rows.select(F.struct(*carry).alias("record")), n_buckets, seed)
    counts = cut(dealt.groupBy("bucket").agg(F.count("*").alias("n"))).withColumn("part", F.floor(F.col("bucket") / GROUP))
    packed = dealt.repartitionByRange("bucket").groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("key", "record"))).alias("cards"))
    packed = packed.withColumn("n", F.size("cards"))
    parts = counts.groupBy("part").agg(F.sum("n").alias("part_n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_n").over(ahead), F.lit(0)).alias("part_at"))
    within = Window.partitionBy("part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counts.withColumn("in_part", F.coalesce(F.sum("n").over(within), F.lit(0)))
        .join(parts, "part")
        .select("bucket", (F.col("in_part") + F.col("part_at")).alias("at"))
    )
    if n_buckets <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)
    shuffled = packed.join(offsets, "bucket").withColumn("deck", _fisher_yates(F.col("n"), F.col("bucket"), seed))
    out = shuffled.select("at", "cards", F.posexplode("deck").alias("pos", "card"))
    record = F.get(F.col("cards"), F.col("card"))["record"]
    return out.select(*[record[c].alias(c) for c in carry], (F.col("at") + F.col("pos")).cast("long").alias("place"))


def shard_records(rows: DataFrame, carry: list[str], n_shards: int = 40, bucket_rows: int = 256, seed: int = 11) -> DataFrame:
    """``shuffle_records`` cut into ``n_shards`` runs whose counts are at most one apart: shard, slot, law "rows".

    Shards are runs of the shuffled order, so a writer reads each bucket once and in sequence. Slots
    are gapless from 0 in each shard. With fewer rows than shards, the first shards have one row each.
    A row with a null id is dealt like any other. ``carry`` may not have place, law, shard or slot.
    """
    shuffled = shuffle_records(rows, carry, bucket_rows, seed)
    total = rows.count()
    base, longer = divmod(total, n_shards)
    place = F.col("place")
    edge = F.lit(longer * (base + 1)).cast("long")
    first = place < edge
    shard = F.when(first, F.floor(place / (base + 1))).otherwise(longer + F.floor((place - edge) / max(base, 1)))
    slot = F.when(first, F.pmod(place, F.lit(base + 1).cast("long"))).otherwise(
        F.pmod(place - edge, F.lit(max(base, 1)).cast("long"))
    )
    return shuffled.select(
        *carry, F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot")
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, bucket_rows: int = 256, seed: int = 11) -> None:
    """Write the records of ``docs`` as Parquet, a folder per shard, rows in order of their slots.

    All columns of ``docs`` take part, so they must be of types that can be grouped. Tasks have runs of
    places, so a shard's files are in order, too.
    """
    placed = shard_records(docs, docs.columns, n_shards, bucket_rows, seed)
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shards(docs: DataFrame, path: str) -> DataFrame:
    """What ``write_shards`` wrote of ``docs``: its columns, law, slot and shard; also where it had no rows."""
    added = [T.StructField("law", T.StringType()), T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())]
    kinds = T.StructType([*docs.schema.fields, *added])
    return docs.sparkSession.read.schema(kinds).parquet(path)

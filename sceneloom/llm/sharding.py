"""Shards in random order: a two-pass external shuffle.

Pass one scatters the records uniformly into buckets of bounded size by a seeded hash.
Pass two holds one bucket at a time, puts it into a random order by a Fisher-Yates shuffle
and deals it out. A record's place in the whole order is the records of earlier buckets
plus its place in its own, so shards can be dealt in turn: their counts differ by one at
most, and the slots of a shard have no gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.llm.common import bounded, kept, packed

#: Bytes of text that a bucket holds on average; its record structs are a small multiple of that.
BUCKET_BYTES, BUCKET_ROWS = 8_000_000, 20_000
#: Buckets up to which each has its own task; beyond, tasks take several in turn.
MOST_TASKS = 50_000
#: Copies made at a time of a record that repeats.
_COPIES = 10_000


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text and 8 for its record; 8 for a null text."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def shards(docs: DataFrame, n: int = 24, seed: int = 7, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(shard, slot, record) for every row: ``record`` is the whole row as a struct.

    Law ``rows``: the counts of the ``n`` shards differ by one at most. The order depends
    on the seed and the records only, never on how the input is dealt: rows are scattered
    by a hash of all their columns, and records whose equal copies would take up an eighth
    of a bucket are counted and scattered by the number of the copy as well. Null texts and
    doc_ids are records like others, rows equal in all columns are so many records, columns
    of any type but maps are allowed, and an empty table gives no row.
    """
    total = docs.agg(F.sum(text_size(F.col("text"))).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    buckets = int(max((total.bytes or 0) // bucket_bytes, total.rows // bucket_rows)) + 1
    rows = packed(docs, key=F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in docs.columns)), size=text_size(F.col("text")))
    copies = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("most"))
    # at most eight keys for each bucket
    many = bounded(kept(copies.filter((F.col("n") > 1) & ((F.col("n") * 8 > bucket_rows) | (F.col("n") * F.col("most") * 8 > bucket_bytes))).select("key")))
    # equal copies are made anew from their count, so that no task numbers them all
    again = rows.join(many, "key", "left_semi").groupBy("key", "size", "_row").agg(F.count(F.lit(1)).alias("n"))
    again = again.select("key", "size", "_row", "n", F.explode(F.expr(f"sequence(0, (n - 1) div {_COPIES})")).alias("_b")).repartition("key", "_b")
    again = again.select("key", "size", "_row", F.explode(F.expr(f"sequence(_b * {_COPIES}, least((_b + 1) * {_COPIES}, n) - 1)")).alias("copy"))
    rows = rows.join(many, "key", "left_anti").withColumn("copy", F.lit(0).cast("long")).unionByName(again)
    rows = rows.select("_row", F.pmod(F.xxhash64(F.lit(seed), "key", "copy"), F.lit(buckets)).cast("int").alias("bucket"),
                       *(F.xxhash64(F.lit(seed + 1 + i), "key", "copy").alias(f"o{i}") for i in range(2)))
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
    # running sums over stretches of buckets, and over one row for each stretch
    counts = counts.select("bucket", "rows", F.expr("bucket div 4096").alias("_s"))
    stretch = counts.groupBy("_s").agg(F.sum("rows").alias("_all"))
    stretch = stretch.select("_s", (F.sum("_all").over(Window.orderBy("_s")) - F.col("_all")).alias("_before"))
    inside = F.sum("rows").over(Window.partitionBy("_s").orderBy("bucket")) - F.col("rows")
    first = counts.withColumn("_inside", inside).join(stretch, "_s").select("bucket", (F.col("_before") + F.col("_inside")).alias("_first"))
    # whole buckets to a task, in order: a task that is run again shuffles alike
    held = rows.repartition(min(buckets, MOST_TASKS), "bucket").groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("o0", "o1", F.col("_row").alias("record")))).alias("_all")).sortWithinPartitions("bucket")
    mixed = held.select("bucket", F.shuffle("_all", seed).alias("_all"))
    dealt = mixed.join(first, "bucket").select("_first", F.posexplode("_all").alias("_at", "_one"))
    place = F.col("_first") + F.col("_at")
    return dealt.select((place % n).cast("int").alias("shard"), F.expr(f"(_first + _at) div {n}").alias("slot"), F.col("_one.record").alias("record"))


def write_shards(docs: DataFrame, path: str, n: int = 24, seed: int = 7) -> None:
    """One folder for each shard, its rows in the order of their slots."""
    out = shards(docs, n, seed).select("shard", "slot", "record.*")
    out.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

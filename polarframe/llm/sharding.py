"""Two-pass external shuffle into shards.

Pass one scatters the records with a seeded hash into buckets that fit in memory; Spark's shuffle files are the
external store. Pass two puts every bucket into the order of a seeded Fisher-Yates permutation (Spark's ``shuffle``),
numbers the records through all buckets, and writes contiguous ranges of that numbering as shards. The law is
``rows``: the shards' row counts differ by at most one, whatever the sizes or contents.

The hash covers the record's place in its input file split, not its content, so equal records, null ids and hot
sources scatter like any others. An empty table gives no records and no files. Null texts have no bytes. Columns of
the input named like the results (``shard``, ``slot``, ``bytes``) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polarframe.llm.shared import BROADCAST_IDS, stored

#: Bytes of records in a bucket: a few of them fit in an executor beside everything else.
BUCKET_BYTES = 24 << 20


def record_bytes(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 8).cast("bigint")


def _spread(docs: DataFrame, seed: int, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(buckets)).cast("int")


def bucket_count(docs: DataFrame, text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> int:
    return int((docs.agg(F.sum(record_bytes(F.col(text)))).first()[0] or 0) // bucket_bytes) + 1


def shuffled(docs: DataFrame, buckets: int, seed: int = 17) -> DataFrame:
    """(bucket, place, record): every record with its place in its bucket's random order."""
    scattered = docs.select(_spread(docs, seed, buckets).alias("bucket"), F.struct(*docs.columns).alias("record"))
    # The group is a bucket: about ``bucket_bytes`` by construction, because the hash is uniform.
    filled = scattered.groupBy("bucket").agg(F.collect_list("record").alias("records"))
    return filled.select("bucket", F.posexplode(F.shuffle("records", F.lit(seed))).alias("place", "record"))


def write_shards(
    docs: DataFrame, path: str, shards: int = 24, text: str = "text", seed: int = 17, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """Write ``docs`` as Parquet under ``path/shard=k`` and return them with shard and slot.

    ``slot`` counts from 0 without gaps in every shard. The two passes run once: their result is stored with bucket
    and place, the rows per bucket (one row each) give the offsets, and the shards are cut from the stored table.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("shard", "slot", "bytes")]
    buckets = bucket_count(docs, text, bucket_bytes)
    passed = shuffled(docs.select(*kept), buckets, seed)
    counted = passed.select("bucket", "place", record_bytes(F.col(f"record.{text}")).alias("bytes"), *[F.col(f"record.{c}").alias(f"record_{c}") for c in kept])
    filled = stored(counted, "buckets")
    sizes = filled.groupBy("bucket").agg(F.count("*").alias("n"))
    # One row a bucket; they are broadcast up to a million buckets, which is some 24 TB.
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy()).alias("total"))
    least, rest = F.floor(F.col("total") / shards), F.col("total") % shards
    long_end = rest * (least + 1)
    at = F.col("offset") + F.col("place")
    shard = F.when(at < long_end, F.floor(at / (least + 1))).otherwise(rest + F.floor((at - long_end) / F.greatest(least, F.lit(1))))
    start = F.col("shard") * least + F.least(F.col("shard"), rest)
    near = F.broadcast(offsets) if buckets <= BROADCAST_IDS else offsets
    placed = filled.join(near, "bucket").withColumn("shard", shard.cast("int"))
    placed = placed.withColumn("slot", (at - start).cast("bigint"))
    out = placed.select("shard", "slot", "bytes", *[F.col(f"record_{c}").alias(c) for c in kept])
    out.write.partitionBy("shard").parquet(path)
    return spark.read.schema(out.schema).parquet(path)

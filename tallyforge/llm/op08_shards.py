"""Shuffles a corpus into shards in two passes: scatter into buckets that fit in memory, then shuffle each bucket."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallyforge.llm.common import hashable, named, plain, scratch_path, stored, table

SEED = 20240229
#: Bytes of records that one task shuffles in memory.
BUCKET_BYTES = 32 << 20
SHARDS = 24
#: Equal records that may meet in one bucket.
COPIES = 1000


def record_size(text) -> F.Column:
    """UTF-8 bytes of the text plus 8 for the id. Null has no bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def _copies(records: DataFrame, most: int) -> DataFrame:
    """records with ``order``, a hash of the whole record, and ``copy``, 0, or where there are over ``most`` equal records a number for each.

    Equal records are interchangeable: where there are many, they are counted as they lie, and that many are made again of one, so
    that none of them meets the others in one task.
    """
    mixed = records.withColumn("order", F.xxhash64(*hashable(records)))
    # a row for each `most` records at most
    many = stored(mixed.groupBy("order").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("order"))
    once = F.lit(0).cast("long").alias("copy")
    if many.isEmpty():
        return mixed.select("*", once)
    counted = mixed.join(F.broadcast(many), "order", "left_semi").groupBy(*mixed.columns).agg(F.count("*").alias("n"))
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / most).cast("long"))
    parts = counted.withColumn("chunk", F.explode(chunks)).repartition("order", "chunk")
    again = F.explode(F.sequence(F.col("chunk") * most, F.least(F.col("n"), (F.col("chunk") + 1) * most) - 1)).alias("copy")
    few = mixed.join(F.broadcast(many), "order", "left_anti").select("*", once)
    return few.unionByName(parts.select(*mixed.columns, again))


def external_shuffle(records: DataFrame, n_shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, size: str = "size", most: int = COPIES) -> DataFrame:
    """Adds shard (0 to n_shards - 1) and slot (gapless from 0) to records in an order that depends on the seed and the records alone.

    First pass: a seeded hash of the whole record scatters records uniformly into buckets of about ``bucket_bytes``. Second
    pass: each bucket is sorted, so the order in which it came does not matter, and Fisher-Yates shuffled with a generator
    seeded by the bucket. The buckets, one after the other, are cut into shards whose counts are at most one apart.
    Columns shard and slot are replaced where they exist; all others but maps pass through, whatever their names. Nulls hash like any
    value. Records that are equal in every column are interchangeable; where there are over ``most`` of them, they are numbered and
    scattered by number. An empty table gives an empty result.
    """
    records = records.select(*(named(c) for c in records.columns if c.lower() not in ("shard", "slot")))
    kept, names, n_bytes = records.columns, [f"c{i}" for i in range(len(records.columns))], F.coalesce(F.sum(named(size)), F.lit(0))
    n_rows, n_bytes = records.agg(F.count("*"), n_bytes).first()
    n_buckets = max(1, -(-n_bytes // bucket_bytes))
    mixed = _copies(plain(records), most)
    mixed = mixed.withColumn("order", F.xxhash64(F.lit(seed), "order", "copy")).drop("copy")
    mixed = mixed.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "order"), F.lit(n_buckets)))
    counts = mixed.groupBy("bucket").agg(F.count("*").alias("n"))
    # a row a bucket, so 24 bytes for each bucket_bytes of records: 40 MB for 100 TB
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = stored(counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin")))

    def shuffled(t: pa.Table) -> pa.Table:
        t = t.sort_by([("order", "ascending")])
        # Fisher-Yates: row i of the sorted bucket moves to place i of the permutation
        places = np.random.Generator(np.random.PCG64([seed, t.column("bucket")[0].as_py()])).permutation(t.num_rows)
        back = np.empty(t.num_rows, dtype=np.int64)
        back[places] = np.arange(t.num_rows)
        return t.take(pa.array(back)).append_column("place", pa.array(np.arange(t.num_rows), type=pa.int64()))

    placed = mixed.groupBy("bucket").applyInArrow(shuffled, StructType([*mixed.schema.fields, StructField("place", LongType())]))
    placed = placed.join(F.broadcast(begins), "bucket").withColumn("at", F.col("begin") + F.col("place"))
    n = max(1, n_rows)
    # decimals: a place times the number of shards may not fit a long
    placed = placed.withColumn("shard", F.expr(f"cast(cast(at as decimal(20,0)) * {n_shards} div {n} as int)"))
    first = F.expr(f"cast((cast(shard as decimal(20,0)) * {n} + {n_shards - 1}) div {n_shards} as bigint)")
    return placed.select(*names, "shard", (F.col("at") - first).alias("slot")).toDF(*kept, "shard", "slot")


def write_shards(records: DataFrame, path: str, **options) -> DataFrame:
    """Writes the records as Parquet, a folder a shard, and reads them back. Buckets are written by the task that shuffled them; in each file
    rows are in the order of their slots."""
    out = external_shuffle(records, **options)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return records.sparkSession.read.schema(out.schema).parquet(path)


def op8_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = write_shards(docs.withColumn("size", record_size(F.col("text"))), scratch_path(spark))
    text_crc32 = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "size", text_crc32.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

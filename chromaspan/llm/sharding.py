"""Sharding: two-pass external shuffle of a corpus.

Pass one scatters records uniformly with seeded hashes: a rendezvous hash of the key picks the
shard, a second seeded hash, of key and text, picks a memory-sized bucket within it. Pass two brings
each bucket together in one task, puts it into a fixed order, applies Fisher-Yates (Spark's
``shuffle``), numbers the rows and writes them. One shuffle takes some thousand buckets; where there
are more, pass one writes the records in groups of so many buckets, and pass two goes through the
groups one after the other. A bucket and a task grow with neither the corpus nor a frequent key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, fresh, materialise, scratch

#: Buckets of one shuffle, each a partition; so many offsets (24 bytes each) are broadcast.
GROUP_BUCKETS = 8192


def rendezvous(key: Column, shards: int, seed: int) -> Column:
    """The shard with the largest seeded hash of (shard, key): one more shard only draws rows to itself."""
    scores = [F.struct(F.xxhash64(F.lit(seed), F.lit(s), key), F.lit(s)) for s in range(shards)]
    return F.greatest(*scores)["col2"] if shards > 1 else F.lit(0)


def _dealt(buckets_a_shard: int, shards: int, seed: int, key: str, text: str, salt: str) -> Column:
    """The bucket of each row, by its key, its text and its salt."""
    within = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key), F.col(text), F.col(salt)), F.lit(buckets_a_shard))
    return (rendezvous(F.col(key), shards, seed) * buckets_a_shard + within).cast("int")


def write_shards(docs: DataFrame, path: str | None = None, shards: int = 24, seed: int = 17, bucket_bytes: int = 8 << 20, key: str = "doc_id", text: str = "text", group_buckets: int = GROUP_BUCKETS) -> str:
    """Writes all rows and columns of ``docs`` in shuffled order, one folder ``shard=k`` a shard and one file a bucket; gives the folder.

    Adds ``slot`` (long, gapless from 0 in each shard, the shuffled place; a file holds a run of
    slots in order) and ``grown_shard`` (the shard if there were one shard more). The law is "by
    key": the key and the number of shards decide. A null key is a key like any other; null texts
    count no bytes; very long texts make larger buckets; an empty table gives an empty folder.
    Repeated rows share a shard and get a slot each; of those that are equal in key and text, each
    takes one of many buckets by its place in a written table. So a repeated task, or a run over the
    same files, gives the same slots. Columns named like the new ones are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot", "grown_shard")
    path = path or scratch(spark, "shards")
    total = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 8)).first()[0] or 0
    per_shard = max(1, math.ceil(total / shards / bucket_bytes))
    bucket, salt, row, pos, b, first, place = fresh(docs, "bucket_", "salt_", "row_", "pos_", "b_", "first_", "part_")
    columns = docs.columns

    docs = _salted(docs, salt, bucket_bytes, key, text)
    docs = docs.withColumn(bucket, _dealt(per_shard, shards, seed, key, text, salt))
    buckets = per_shard * shards
    groups = math.ceil(buckets / group_buckets)
    if groups > 1:
        written = scratch(spark, "bucket-groups")
        (g,) = fresh(docs, "group_")
        docs.withColumn(g, F.floor(F.col(bucket) / group_buckets).cast("int")).write.partitionBy(g).parquet(written)
        docs = spark.read.schema(docs.withColumn(g, F.lit(0)).schema).parquet(written)
    # Offsets: rows of each bucket, then a running sum by shard over the sums of its buckets.
    counts = materialise(docs.groupBy(bucket).count(), "bucket-counts")
    before = Window.partitionBy(F.floor(F.col(bucket) / per_shard)).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(counts.select(F.col(bucket).alias(b), F.coalesce(F.sum("count").over(before), F.lit(0)).alias(first)), "bucket-offsets")
    for k in range(groups):
        low, high = k * group_buckets, min(buckets, (k + 1) * group_buckets)
        part = docs.where(F.col(g) == k).drop(g) if groups > 1 else docs
        # A partition holds one bucket in a fixed order, so that a recomputed task shuffles alike.
        dealt = part.withColumn(place, (F.col(bucket) - low).cast("int")).repartitionById(high - low, F.col(place)).sortWithinPartitions(bucket, F.xxhash64(F.lit(seed + 2), F.col(key)), F.xxhash64(F.col(text)), salt)
        held = dealt.select(place, bucket, F.struct(*[F.col(f"`{c}`") for c in columns]).alias(row)).groupBy(place, bucket).agg(F.collect_list(row).alias(row))
        mixed = held.select(bucket, F.posexplode(F.shuffle(row, seed)).alias(pos, row))
        own = F.broadcast(offsets.where((F.col(b) >= low) & (F.col(b) < high)))  # group_buckets rows at most
        numbered = mixed.join(own, F.col(bucket) == F.col(b)).select(f"{row}.*", (F.col(first) + F.col(pos)).cast("long").alias("slot"), rendezvous(F.col(row)[key], shards + 1, seed).cast("int").alias("grown_shard"), F.floor(F.col(bucket) / per_shard).cast("int").alias("shard"))
        numbered.sortWithinPartitions("shard", "slot").write.mode("append").partitionBy("shard").parquet(path)
    return path


def _salted(docs: DataFrame, salt: str, bucket_bytes: int, key: str, text: str) -> DataFrame:
    """``docs`` with a number that is 0 unless rows of the same key and text take more than half a bucket; then it tells these apart.

    A key with many different texts is spread by its texts.
    """
    k, h, n = fresh(docs, "key_", "texthash_", "many_")
    size = F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 8)
    hot = docs.groupBy(F.col(key).alias(k), F.xxhash64(text).alias(h)).agg(size.alias(n), F.count("*").alias("c")).where((F.col(n) > bucket_bytes / 2) & (F.col("c") > 1)).drop("c")
    hot = materialise(hot, "hot-rows")
    if not hot.count():
        return docs.withColumn(salt, F.lit(0).cast("long"))
    # One hot pair takes half a bucket at least, so these are few: the bytes of the corpus by those of half a bucket at most.
    joined = docs.join(bounded(hot, 60), F.col(key).eqNullSafe(F.col(k)) & (F.xxhash64(text) == F.col(h)), "left")
    return materialise(joined.withColumn(salt, F.when(F.col(n).isNotNull(), F.monotonically_increasing_id()).otherwise(F.lit(0))).drop(k, h, n), "salted-rows")


def read_shards(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a folder of ``write_shards``; ``schema`` gives their columns, for a folder may be empty."""
    return spark.read.schema(f"{schema}, slot long, grown_shard int, shard int").parquet(path)


def shuffle_into_shards(docs: DataFrame, shards: int = 24, seed: int = 17, bucket_bytes: int = 8 << 20, key: str = "doc_id", text: str = "text", group_buckets: int = GROUP_BUCKETS) -> DataFrame:
    """All rows and columns of ``docs`` plus ``shard``, ``slot`` and ``grown_shard``, read back from the shards that ``write_shards`` writes."""
    docs = docs.drop("shard", "slot", "grown_shard")
    path = write_shards(docs, None, shards, seed, bucket_bytes, key, text, group_buckets)
    out = read_shards(docs.sparkSession, path, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "shard", "slot", "grown_shard")


def op9_sharding(docs: DataFrame) -> DataFrame:
    out = shuffle_into_shards(docs.select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")

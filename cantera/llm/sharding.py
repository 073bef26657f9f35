"""Two-pass external shuffle into shards.

Pass one scatters records by seeded hashes: a rendezvous hash of the key names the shard, a
hash of key and text the bucket within it, with as many buckets as keep one in memory. Pass two
brings each bucket to one task, shuffles it by Fisher-Yates (Spark's seeded `shuffle` of an
array) and writes it. A shard is its buckets one after another. Nothing is drawn while rows are
moved, so a task that runs again deals its rows as before, and the result is the same however
the input is partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantera.session import new_path

# Text and overhead of one bucket: small against an executor's memory.
BUCKET_BYTES = 16 << 20
OVERHEAD = 16
# Hashes of up to this many often repeated records, some MB, are broadcast.
BROADCAST_REPEATS = 100_000


def rendezvous(key: Column, shards: int, seed: int) -> Column:
    """The shard whose hash with the key is largest: one more shard takes keys only into itself."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    scores = [F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("h"), F.lit(s).alias("s")) for s in range(shards)]
    return (F.greatest(*scores) if shards > 1 else scores[0]).getField("s")


def spread_repeats(rows: DataFrame, often: DataFrame) -> DataFrame:
    """`rows` (record, key, same, number), equal records of the hashes `often` numbered from 0.

    So a record that is there very many times goes to many buckets. Equal records are counted,
    not sorted or collected, and the counts are written out again as rows.
    """
    often = often.select(F.col("same").alias("often")).checkpoint()
    count = often.count()
    if not count:
        return rows
    often = F.broadcast(often) if count <= BROADCAST_REPEATS else often
    hot = F.col("same") == F.col("often")
    counted = rows.join(often, hot, "left_semi").groupBy("record", "key", "same").count()
    numbered = counted.select("record", "key", "same", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("number"))
    return rows.join(often, hot, "left_anti").unionByName(numbered)


def write_shards(
    records: DataFrame,
    path: str,
    shards: int = 40,
    key: str = "doc_id",
    text: str = "text",
    seed: int = 42,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Write `records` to `path`, shuffled, in one folder per shard; the written table.

    The table has every column of `records` but those of the same names as `shard` (int, a
    function of key and shard count alone), `grown_shard` (int, the shard if there were one
    more), `bucket` and `place` (its place within its bucket, from 0). Null keys share a shard
    like any other key. Rows that repeat a record are numbered where they would be much of a
    bucket, and so spread over the buckets of their shard. One record is never split, whatever
    its size. Records hold no map. The same records give the same places in any partitioning of
    the input. An empty input gives an empty table.
    """
    spark = records.sparkSession
    added = ("shard", "grown_shard", "bucket", "place")
    own = [c for c in records.columns if c.lower() not in added]
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + OVERHEAD
    same = F.xxhash64(F.lit(seed), F.col(f"`{key}`"), F.col(f"`{text}`"))
    total = records.agg(F.sum(size.cast("long")).alias("n")).first().n or 0
    depth = max(1, -(-total // (shards * bucket_bytes)))
    whole = F.struct(*[F.col(f"`{c}`") for c in own])
    rows = records.select(whole.alias("record"), F.col(f"`{key}`").alias("key"), same.alias("same"), F.lit(0).cast("long").alias("number"))
    if depth > 1:
        sizes = records.groupBy(same.alias("same")).agg(F.sum(size.cast("long")).alias("bytes"), F.count(F.lit(1)).alias("n"))
        rows = spread_repeats(rows, sizes.where((F.col("n") > 1) & (F.col("bytes") * 8 > bucket_bytes)))
    placed = rows.select(
        "record",
        rendezvous(F.col("key"), shards, seed).alias("shard"),
        rendezvous(F.col("key"), shards + 1, seed).alias("grown_shard"),
        F.pmod(F.xxhash64(F.lit(seed + 1), "same", "number"), F.lit(depth)).cast("int").alias("draw"),
        F.xxhash64(F.lit(seed), "same", "number").alias("tie"),
        # Records of one key and text that differ elsewhere.
        F.xxhash64("record").alias("last"),
    ).withColumn("bucket", F.col("shard") * F.lit(depth) + F.col("draw"))
    # One bucket to a partition. A fixed order before the shuffle makes the result depend on the
    # seed, not on arrival.
    scattered = placed.repartitionById(min(shards * depth, 1 << 20), F.col("bucket")).sortWithinPartitions("bucket", "tie", "last")
    shuffled = (
        scattered.groupBy("bucket", "shard")
        .agg(F.collect_list(F.struct("record", "grown_shard")).alias("items"))
        .select("bucket", "shard", F.shuffle("items", F.lit(seed)).alias("items"))
        .select("bucket", "shard", F.posexplode("items").alias("place", "item"))
    )
    table = shuffled.select(
        "item.record.*", "shard", F.col("item.grown_shard").alias("grown_shard"), "bucket", F.col("place").cast("long").alias("place")
    )
    table.write.partitionBy("shard").parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def slots(written: DataFrame) -> DataFrame:
    """The written table with `slot` (long): its place within its shard, without a gap from 0.

    Only the sizes of buckets are added up, a few numbers for each shard.
    """
    sizes = written.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(
        F.col("shard").alias("s"),
        F.col("bucket").alias("b"),
        F.expr("sum(n) OVER (PARTITION BY shard ORDER BY bucket) - n").cast("long").alias("before"),
    ).checkpoint()
    columns = [c for c in written.columns if c.lower() != "slot"]
    same = (written["shard"] == before["s"]) & (written["bucket"] == before["b"])
    return written.join(before, same).select(*[written[f"`{c}`"] for c in columns], (before["before"] + written["place"]).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 40, **options) -> DataFrame:
    """`docs` shuffled and written in the shared folder, with `shard`, `grown_shard` and `slot`."""
    return slots(write_shards(docs, new_path(docs.sparkSession, "shards"), shards, **options))

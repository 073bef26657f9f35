"""Incremental publishing of catalogue rows to the point table.

The table is a log: every micro-batch appends its points under its own folder, and the
newest version of a song counts. Publishing costs what the batch holds, not what the table
holds. `compact` folds the log into a base; publishing then goes on into a new log with the
same checkpoint, and a reader gives both. Reading shuffles the log only: songs of the base
stay in place, less those that the log replaces. A batch that is repeated after a failure
overwrites its own folder, and the checkpoint records it only after the write.

A song's two vectors may come from two streams, in any order and far apart: `publish_pairs`
keeps the half that came first in the state store until the other one arrives. Every batch
can leave its counts beside the log (`published_counts`), and `counters.RunCounters` says how
many rows have arrived while a stream runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cantera.operators.relational import absent, first_per_key
from cantera.session import exists, new_path
from cantera.sources.points import of_widths, to_points
from cantera.streaming.counters import counted
from cantera.tables import SCHEMAS

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
COUNTS = "processed BIGINT, published BIGINT, rejected BIGINT"

LOG_SCHEMA = (
    f"{SCHEMAS['points']}, version BIGINT, reason STRING, published_at TIMESTAMP, rejected BOOLEAN, run STRING, batch BIGINT"
)


def publish_stream(
    spark: SparkSession,
    source: str,
    schema: str,
    target: str,
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    max_files: int = 1000,
    widths: dict[str, int] | None = None,
    version: str | None = None,
    counts: str | None = None,
) -> StreamingQuery:
    """Publish the Parquet files at `source` that were not published yet, then stop.

    `prepare` turns source rows into catalogue rows with both vectors. Vectors of another
    width than the point table's are rejected: `widths`, or else those of what is published,
    or else the widths that most songs of the first batch have. The row with the largest
    `version`, a whole number of the source, is a song's newest; without one, later runs
    replace earlier ones, and within a batch the row that sorts last by its title and lyric.
    `counts` is the folder for the batches' counts.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    append = _appender(spark, target, checkpoint, widths, version, counts)
    return _started(rows, lambda batch, number: append(prepare(batch) if prepare else batch, number), checkpoint)


def publish_pairs(
    lyrics: DataFrame,
    tracks: DataFrame,
    target: str,
    checkpoint: str,
    widths: dict[str, int] | None = None,
    version: str | None = None,
    track_version: str | None = None,
    counts: str | None = None,
    wait: str | None = None,
    arrived: str = "arrived_at",
) -> StreamingQuery:
    """Publish songs whose vectors come in two streams, each when its second vector is there; then stop.

    `lyrics` has catalogue columns with `letra_vec`, `tracks` has `id` and `track_vector`; a
    row without its vector is no arrival yet. Either may be first, by any number of batches or
    runs with the same `checkpoint`: the half that waits is in the state store, on disk and in
    the checkpoint. A vector that comes again makes a new point; of a song's points the one
    with the newest lyric counts, then the newest track, by the whole numbers (of 31 bits)
    `version` and `track_version`. State holds every arrival. With `wait` (such as "30 days")
    it is cleared of those whose column `arrived` of both streams is that much behind, and a
    partner that comes later than that is not met.
    """
    spark = lyrics.sparkSession

    def number(name: str | None) -> Column:
        return F.coalesce(F.col(name).cast("long"), F.lit(0)) if name else F.lit(0)

    left = lyrics.filter("letra_vec IS NOT NULL").withColumn("_lyric", number(version))
    right = tracks.filter("track_vector IS NOT NULL").select(
        F.col("id").alias("_id"), "track_vector", number(track_version).alias("_track"), *([F.col(arrived).alias("_at")] if wait else [])
    )
    same = F.col("id") == F.col("_id")
    if wait:
        left, right = left.withWatermark(arrived, wait), right.withWatermark("_at", wait)
        same = same & F.expr(f"_at BETWEEN `{arrived}` - INTERVAL {wait} AND `{arrived}` + INTERVAL {wait}")
    pairs = left.drop("track_vector").join(right, same).withColumn("_version", F.col("_lyric") * F.lit(1 << 31) + F.col("_track"))
    append = _appender(spark, target, checkpoint, widths, "_version", counts)
    # Vectors that wait are kept on the executors' disks, not in their heaps.
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return _started(pairs, append, checkpoint)
    finally:
        spark.conf.set(STATE_STORE, before)


def waiting(lyrics: DataFrame, tracks: DataFrame) -> DataFrame:
    """(id, lacks): the songs of which one vector has arrived and the other has not, from what the sources hold."""
    said = lyrics.filter("letra_vec IS NOT NULL").select("id", F.lit(1).alias("lyric"), F.lit(0).alias("track"))
    heard = tracks.filter("track_vector IS NOT NULL").select("id", F.lit(0).alias("lyric"), F.lit(1).alias("track"))
    halves = said.unionByName(heard).groupBy("id").agg(F.max("lyric").alias("lyric"), F.max("track").alias("track"))
    lacks = F.when(F.col("lyric") == 0, "lyrics_vector").otherwise("track_vector")
    return halves.filter("lyric + track = 1").select("id", lacks.alias("lacks"))


def _started(rows: DataFrame, append: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return counted(rows).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _appender(
    spark: SparkSession, target: str, checkpoint: str, widths: dict[str, int] | None, version: str | None, counts: str | None
) -> Callable[[DataFrame, int], None]:
    """What a batch of catalogue rows and its number become: a folder of the log, and its counts."""
    settled = dict(widths or {})
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def append(songs: DataFrame, number: int) -> None:
        points = to_points(songs, None, version)
        if not settled:
            known = widths_of(published(spark, target))
            if not known:
                # The first batch decides. It is written before it is looked at: its vectors are made once.
                first = new_path(spark, "first-batch")
                points.write.parquet(first)
                points = spark.read.schema(points.schema).parquet(first)
                known = widths_of(points)
            settled.update(known)
        stamped = of_widths(points, settled).withColumns(
            {"published_at": F.current_timestamp(), "rejected": F.col("reason").isNotNull()}
        )
        seen = Observation()
        stamped = stamped.observe(seen, F.count(F.lit(1)).alias("processed"), F.count_if("rejected").alias("rejected"))
        folder = f"{target}/run={run}/batch={number}"
        # Sorted by id, a file lets a search fetch single songs by page.
        stamped.sortWithinPartitions("rejected", "id").write.mode("overwrite").partitionBy("rejected").parquet(folder)
        if counts:
            row = (seen.get["processed"], seen.get["processed"] - seen.get["rejected"], seen.get["rejected"])
            spark.createDataFrame([row], COUNTS).coalesce(1).write.mode("overwrite").parquet(f"{counts}/run={run}/batch={number}")

    return append


def published_counts(spark: SparkSession, counts: str) -> DataFrame:
    """(run, batch, processed, published, rejected) of every batch that left its counts at `counts`."""
    return _written(spark, counts, f"{COUNTS}, run STRING, batch BIGINT").select("run", "batch", "processed", "published", "rejected")


def widths_of(points: DataFrame) -> dict[str, int]:
    """The width of most vectors of each kind; empty if there is no usable point."""
    names = ("track_vector", "lyrics_vector")
    usable = points.filter("reason IS NULL") if "reason" in points.columns else points
    found = usable.agg(*[F.expr(f"mode(size({n})) FILTER (WHERE size({n}) > 0)").alias(n) for n in names]).first()
    return {n: found[n] for n in names if found[n] is not None}


def publish_available(*args, **options) -> None:
    """`publish_stream`, waited for."""
    publish_stream(*args, **options).awaitTermination()


def _log(spark: SparkSession, target: str) -> DataFrame:
    return _written(spark, target, LOG_SCHEMA)


def _written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def published(spark: SparkSession, target: str, base: str | None = None) -> DataFrame:
    """The newest point of every song in the log `target`, and of `base` where the log has none."""
    accepted = _log(spark, target).filter(~F.col("rejected"))
    newest = first_per_key(
        accepted, ["id"], [F.desc("version"), F.desc("published_at"), F.desc("batch"), F.desc("payload")]
    )
    newest = newest.drop("version", "reason", "rejected", "run", "batch", "published_at")
    if base is None:
        return newest
    kept = absent(spark.read.schema(SCHEMAS["points"]).parquet(base), accepted, ["id"], unique=True)
    return kept.unionByName(newest)


def rejected(spark: SparkSession, target: str) -> DataFrame:
    """(id, reason) of rows that could not be published."""
    return _log(spark, target).filter("rejected").select("id", "reason", "batch")


def compact(spark: SparkSession, target: str, into: str, base: str | None = None) -> None:
    """Write the newest points to the new folder `into`, each file a range of ids in order."""
    newest = published(spark, target, base)
    newest.repartitionByRange("id").sortWithinPartitions("id").write.mode("errorifexists").parquet(into)

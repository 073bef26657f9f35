"""The newest progress of each stage, from a batch or a stream of updates."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Fields that an update always overwrites; total_items keeps its last non-null value.
OVERWRITTEN = ("current_offset", "last_processed_id", "status", "error_message", "updated_at")


def _states(updates: DataFrame, order: Sequence[str]) -> DataFrame:
    """Each update as a state: its fields and total, each with the place that decides."""
    place = F.struct(*order)
    fields = [F.coalesce(c, F.lit("running")).alias(c) if c == "status" else F.col(c) for c in OVERWRITTEN]
    return updates.select(
        "task_type",
        F.struct(*fields).alias("fields"),
        place.alias("place"),
        "total_items",
        F.when(F.col("total_items").isNotNull(), place).alias("total_place"),
    )


def _newest(states: DataFrame) -> DataFrame:
    """One state per stage. States of states give the same, so batches reduce on their own."""
    newest = lambda value, by: F.max_by(value, by).alias(value)
    return states.groupBy("task_type").agg(
        newest("fields", "place"),
        F.max("place").alias("place"),
        newest("total_items", "total_place"),
        F.max("total_place").alias("total_place"),
    )


def _progress(states: DataFrame) -> DataFrame:
    return _newest(states).select("task_type", *[F.col(f"fields.{c}") for c in OVERWRITTEN], "total_items")


def latest_progress(updates: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per stage after applying all updates in `order`, a list of columns."""
    return _progress(_states(updates, order))


def read_progress(progress: DataFrame, stages: DataFrame) -> DataFrame:
    """Progress of every stage of `stages` (one column, task_type), with defaults where it has none."""
    known = progress.withColumn("_known", F.lit(True))
    rows = stages.select("task_type").join(known, "task_type", "left")

    def default(name: str, value: Column) -> Column:
        return F.when(F.col("_known"), F.col(name)).otherwise(value).alias(name)

    return rows.select(
        "task_type",
        default("current_offset", F.lit(0)),
        default("total_items", F.lit(0)),
        "last_processed_id",
        default("status", F.lit("running")),
        "error_message",
    )


def progress_stream(
    updates: DataFrame, order: Sequence[str], target: str, checkpoint: str
) -> StreamingQuery:
    """Reduce each micro-batch of a stream of updates to one state per stage, under its own folder.

    A folder belongs to one checkpoint and batch: streams that share a target add up, and a
    repeated batch replaces only itself.
    """
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def reduce(batch: DataFrame, number: int) -> None:
        _newest(_states(batch, order)).write.mode("overwrite").parquet(f"{target}/run={run}/batch={number}")

    return (
        updates.writeStream.foreachBatch(reduce)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def streamed_progress(spark: SparkSession, target: str, updates: DataFrame, order: Sequence[str]) -> DataFrame:
    """The progress that all reduced batches add up to; empty if nothing was written yet.

    `updates` gives the schema only; it may be the stream itself.
    """
    schema = _newest(_states(spark.createDataFrame([], updates.schema), order)).schema
    try:
        states = spark.read.schema(schema).parquet(target)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        states = spark.createDataFrame([], schema)
    return _progress(states)

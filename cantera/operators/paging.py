"""Resuming an ordered pass over a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantera.session import shared_folder

WHOLE = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)
FRACTIONAL = (T.DoubleType, T.FloatType)
# Size of the sketch, and the share of the keys on either side of its guess: many times its error.
SKETCH_K = 2000
SIDE = 0.01
# So many keys are sorted; a larger bracket is narrowed again.
SORTED = 100_000


def resume_by_key(df: DataFrame, key: str, last: int | None, *then: str) -> DataFrame:
    """Rows from `last` on, that one included, in order of `key` and `then`."""
    rest = df if last is None else df.filter(F.col(key) >= last)
    return rest.orderBy(key, *then)


def resume_by_position(df: DataFrame, key: str, done: int) -> DataFrame:
    """The rows after the first `done` in order of the unique `key`, which is not null.

    Finds the key at that position and filters by it, so the rows are read with a pushed-down
    predicate. `OFFSET` alone would bring every row to one task.
    """
    if done <= 0:
        return df
    boundary = key_at(df.select(key), key, done)
    return df.filter(F.lit(False)) if boundary is None else df.filter(F.col(key) > boundary)


def key_at(keys: DataFrame, key: str, position: int):
    """The key at a 1-based position, None when there are fewer; null keys don't count.

    A number is found by selection: a quantile sketch says about where it is, the keys below
    are counted, and only a bracket of few keys is sorted. Every step is an aggregate over the
    key column, so keys are neither exchanged nor written. Other keys are sorted.
    """
    kind = keys.schema[key].dataType
    present = keys.filter(F.col(key).isNotNull())
    if isinstance(kind, WHOLE):
        return _selected(present.select(F.col(key).cast("long").alias("k")), "bigint", position)
    if isinstance(kind, FRACTIONAL):
        return _selected(present.select(F.col(key).cast("double").alias("k")), "double", position)
    return sorted_key_at(present, key, position)


def _selected(keys: DataFrame, kind: str, position: int):
    sketch = getattr(F, f"kll_sketch_agg_{kind}")
    quantile = getattr(F, f"kll_sketch_get_quantile_{kind}")
    below, inside = 0, keys
    while True:
        wanted = position - below
        told = inside.agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("low"), F.max("k").alias("high"), sketch("k", F.lit(SKETCH_K)).alias("s")).first()
        if wanted > told.n:
            return None
        if told.n <= SORTED:
            return inside.orderBy("k").offset(wanted - 1).limit(1).first().k
        if told.low == told.high:
            return told.low
        # The sketch, some kilobytes, says about which keys are on either side of the position.
        ranks = [min(1.0, max(0.0, wanted / told.n + side)) for side in (-SIDE, SIDE)]
        summary = keys.sparkSession.createDataFrame([(told.s,)], "s binary")
        guess = summary.select(*[quantile("s", F.lit(rank)).alias(name) for name, rank in zip("ab", ranks)]).first()
        counts = inside.agg(F.count_if(F.col("k") < guess.a).alias("less"), F.count_if(F.col("k") <= guess.b).alias("upto")).first()
        low, high = guess.a, guess.b
        if wanted <= counts.less:
            # The sketch was wrong by more than its bracket: it lies below, or else above.
            inside = inside.filter(F.col("k") < low)
        elif wanted > counts.upto:
            below, inside = below + counts.upto, inside.filter(F.col("k") > high)
        elif low == high:
            return low
        else:
            below, inside = below + counts.less, inside.filter(F.col("k").between(low, high))
            if (low, high) == (told.low, told.high):
                # Few different keys fill the bracket: the ends themselves are taken off.
                ends = inside.agg(F.count_if(F.col("k") == low).alias("first"), F.count_if(F.col("k") < high).alias("before")).first()
                if position - below <= ends.first:
                    return low
                if position - below > ends.before:
                    return high
                below, inside = below + ends.first, inside.filter((F.col("k") > low) & (F.col("k") < high))


def sorted_key_at(keys: DataFrame, key: str, position: int):
    """The same by sorting.

    The keys are range-partitioned and sorted within partitions; the size of each partition
    tells which one holds the position. Only those sizes and the one key reach the driver.
    The sorted keys are checkpointed, so both steps see the same partition bounds.
    """
    shared_folder(keys.sparkSession)
    number = F.monotonically_increasing_id()
    ordered = keys.repartitionByRange(key).sortWithinPartitions(key).withColumn("_row", number)
    ordered = ordered.checkpoint()
    # The number's upper bits are the partition, its lower 33 bits the row in it.
    sizes = ordered.groupBy(F.shiftright("_row", 33).alias("part")).count().orderBy("part").collect()
    for part, size in sizes:
        if position <= size:
            wanted = (part << 33) + position - 1
            return ordered.filter(F.col("_row") == wanted).first()[key]
        position -= size
    return None

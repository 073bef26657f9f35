"""Vector expressions for single rows; searching is in `operators.knn`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    squares = lambda total, x: total + x.cast("double") * x.cast("double")
    return F.sqrt(F.aggregate(vector, F.lit(0.0), squares))


def normalise(vector: Column) -> Column:
    """Unit length, null for a zero vector."""
    lengths = F.array_repeat(norm(vector), F.size(vector))
    unit = F.zip_with(vector, lengths, lambda x, length: x.cast("double") / F.nullif(length, F.lit(0.0)))
    return F.when(~F.exists(unit, lambda x: x.isNull()), unit)


def cosine(left: Column, right: Column) -> Column:
    """Null when either side is a zero vector, so that no NaN can be ranked."""
    lengths = norm(left) * norm(right)
    return F.when(lengths > 0, dot(left, right) / lengths)


def is_rectangular(patches: Column) -> Column:
    """At least one patch, and all of one width."""
    widths = F.array_distinct(F.transform(patches, lambda p: F.size(p)))
    return F.coalesce((F.size(widths) == 1) & (F.size(F.get(patches, F.lit(0))) > 0), F.lit(False))


def mean_of_patches(patches: Column) -> Column:
    """Element-wise mean of the patches of one row, null when they are ragged or absent."""
    zero = F.transform(F.get(patches, F.lit(0)), lambda _: F.lit(0.0))
    total = F.aggregate(
        patches, zero, lambda acc, patch: F.zip_with(acc, patch, lambda a, x: a + x.cast("double"))
    )
    mean = F.transform(total, lambda x: x / F.size(patches))
    return F.when(is_rectangular(patches), mean)

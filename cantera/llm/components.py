"""Connected components by alternating large and small stars, in rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantera.operators.relational import reshuffled


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first())


def _each(*pairs: tuple[str, str]) -> Column:
    """Columns (u, v), one row for each pair of columns."""
    return F.inline(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs]))


def connected(links: DataFrame) -> DataFrame:
    """(`node`, `component`) of every node of `links` (two columns of one integer type).

    The component is its smallest node. Every round joins each link with the smallest
    neighbour of one end; minima are taken before rows are shuffled, and a node with very many
    links is a hot key of plain joins, which adaptive execution splits. Rounds are logarithmic
    in the size of a component, and each is checkpointed.
    """
    a, b = links.columns
    edges = (
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct().checkpoint()
    )
    state = _state(edges)
    while state[0]:
        # Large star: greater neighbours of a node move to the smallest one around it.
        both = edges.select(_each(("u", "v"), ("v", "u")))
        lowest = both.groupBy(F.col("u").alias("hub")).agg(F.min("v").alias("low"))
        # `reshuffled`, for a hub with very many links to be split at run time.
        large = both.where("v > u").join(reshuffled(lowest, ["hub"]), F.col("u") == F.col("hub"))
        large = large.select(F.col("v").alias("u"), F.least("low", "hub").alias("v")).distinct().checkpoint()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        lowest = large.groupBy(F.col("u").alias("hub")).agg(F.min("v").alias("low"))
        small = large.join(reshuffled(lowest, ["hub"]), F.col("u") == F.col("hub")).select(_each(("u", "low"), ("v", "low")))
        edges = small.where("u <> v").distinct().checkpoint()
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select(_each(("u", "v"), ("v", "v"))).select(F.col("u").alias("node"), F.col("v").alias("component")).distinct()

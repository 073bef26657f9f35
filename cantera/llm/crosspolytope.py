"""Nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

Fast Hadamard rotations with random signs turn a unit vector, and its nearest signed axis is
its cell. Every table has rotations of its own. A query looks into the cells of its nearest
axes in every table, as many as hold some number of vectors, and whatever it meets there is
ranked by exact products. What angles cannot say is met by all queries: long vectors, and
everything for a query that found too little.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = 6
# Share of a table's cells that a query looks into: with 64 dimensions, 20 of 128.
PROBES = 0.16
# Points and queries that meet in one task.
POINTS_AT_ONCE, QUERIES_AT_ONCE = 4096, 1024
PRODUCTS_AT_ONCE = 1 << 21
# Lengths that differ less than this are one length.
SAME_NORM = 1e-4
# A query looks into cells that hold about so many different vectors in each table, if there are as many.
EXACT_CLASSES = 4096
# Where lengths differ, the share of the longest vectors that every query meets.
LONGEST_SHARE = 0.12
# The spot of vectors that all meet.
EVERYWHERE = -1


def rotated(vectors: np.ndarray, table: int, seed: int) -> np.ndarray:
    """Three rounds of random signs and a fast Hadamard transform; the width is a power of two."""
    width = vectors.shape[1]
    signs = np.random.default_rng([seed, table, width]).choice([-1.0, 1.0], (3, width))
    for sign in signs:
        vectors, step = vectors * sign, 1
        while step < width:
            halves = vectors.reshape(len(vectors), -1, 2, step)
            vectors = np.stack([halves[:, :, 0] + halves[:, :, 1], halves[:, :, 0] - halves[:, :, 1]], axis=2).reshape(len(vectors), width)
            step *= 2
        vectors = vectors / np.sqrt(width)
    return vectors


def width_of(size: int) -> int:
    return 1 << max(0, (size - 1).bit_length())


def cells(vectors: np.ndarray, query: bool, tables: int, probes: float, seed: int) -> np.ndarray:
    """The cells of every vector in each table, as numbers that differ between tables. Length has no effect."""
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    width = width_of(unit.shape[1])
    unit = np.pad(unit, ((0, 0), (0, width - unit.shape[1])))
    wanted = max(1, round(probes * 2 * width)) if query else 1
    found = []
    for table in range(tables):
        turned = rotated(unit, table, seed)
        signed = np.stack([turned, -turned], axis=2).reshape(len(turned), 2 * width)
        best = np.argpartition(-signed, wanted - 1, axis=1)[:, :wanted] if wanted < 2 * width else np.tile(np.arange(2 * width), (len(turned), 1))
        found.append(best + 2 * width * table)
    return np.concatenate(found, axis=1) if found else np.zeros((len(vectors), 0), int)


def usable(vector: str) -> Column:
    """Not null, not empty, all components finite and some of them not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _spotted(vectors: DataFrame, query: bool, tables: int, seed: int) -> DataFrame:
    """`vectors` (class, size, vector, and `reach`, the share of the cells that a query of this size looks into) with one row per cell, `spot`."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                matrix = part.column("vector").flatten().to_numpy().astype(float).reshape(-1, int(size))
                spots = cells(matrix, query, tables, part.column("reach")[0].as_py(), seed)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(spots) + 1) * spots.shape[1], pa.int32()), pa.array(spots.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("class", "size", "vector")), flat], names=["class", "size", "vector", "spots"])

    rows = vectors.select("class", "size", "vector", "reach")
    schema = T.StructType([*rows.drop("reach").schema, T.StructField("spots", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(place, schema).select("class", "size", "vector", F.explode("spots").alias("spot"))


def _everywhere(vectors: DataFrame) -> DataFrame:
    """All in one place, which is then met in parts: every query with every point."""
    return vectors.select("class", "size", "vector", F.lit(EVERYWHERE).alias("spot"))


def _met(points: DataFrame, seekers: DataFrame, most: int) -> DataFrame:
    """The `most` best points of each query of those it shares a spot with, by exact inner product.

    `points` and `seekers` are (class, size, vector, spot). Spots with many of either are met
    in parts, so what a task holds is bounded.
    """
    kind = points.schema["class"].dataType["id"].dataType.simpleString()
    at = ["size", "spot"]
    room = points.groupBy(*at).agg(F.count(F.lit(1)).alias("n_points"))
    load = seekers.groupBy(*at).agg(F.count(F.lit(1)).alias("n_seekers"))
    shape = room.join(load, at).select(
        F.col("size").alias("of"),
        F.col("spot").alias("cell"),
        F.ceil(F.col("n_points") / POINTS_AT_ONCE).cast("int").alias("parts"),
        F.ceil(F.col("n_seekers") / QUERIES_AT_ONCE).cast("int").alias("shares"),
    ).checkpoint()
    here = (F.col("size") == F.col("of")) & (F.col("spot") == F.col("cell"))

    def dealt(rows: DataFrame, mine: str, mine_of: str, other: str, other_of: str) -> DataFrame:
        return rows.join(shape, here).select(
            "size",
            "spot",
            F.pmod(F.xxhash64("class.hash"), F.col(mine_of)).cast("int").alias(mine),
            F.explode(F.sequence(F.lit(0), F.col(other_of) - 1)).alias(other),
            F.col("class.id").alias("id"),
            F.col("class.hash").alias("hash"),
            "vector",
        )

    group = ["size", "spot", "part", "share"]

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        chosen = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        if left.num_rows and right.num_rows:
            asking = left.column("vector").combine_chunks().flatten().to_numpy().astype(float).reshape(left.num_rows, -1)
            # In order of the class, which decides ties.
            right = right.sort_by([("id", "ascending"), ("hash", "ascending")])
            there = right.column("vector").combine_chunks().flatten().to_numpy().astype(float).reshape(right.num_rows, -1)
            # Products by matrix differ from those in a fixed order in their last places: all that may be among the best.
            product = asking @ there.T
            many = min(most, len(there))
            least = np.partition(product, len(there) - many, axis=1)[:, len(there) - many]
            slack = 1e-12 * np.linalg.norm(asking, axis=1) * np.linalg.norm(there, axis=1).max()
            q, p = np.nonzero(product >= (least - slack)[:, None])
            # One fixed order of summation, whatever the size of the group.
            step = max(1, PRODUCTS_AT_ONCE // there.shape[1])
            score = np.concatenate([np.einsum("ij,ij->i", asking[q[i : i + step]], there[p[i : i + step]]) for i in range(0, len(q), step)])
            order = np.lexsort((p, -score, q))
            q, p, score = q[order], p[order], score[order]
            kept = np.arange(len(q)) - np.searchsorted(q, q) < many
            chosen.append((q[kept], p[kept], score[kept]))
        q, p, score = (np.concatenate(x) for x in zip(*chosen))
        pick = lambda table, column, rows: table.column(column).take(pa.array(rows))
        return pa.table(
            {
                "query": pick(left, "id", q),
                "query_hash": pick(left, "hash", q),
                "point": pick(right, "id", p),
                "point_hash": pick(right, "hash", p),
                "score": pa.array(score),
            }
        )

    return (
        dealt(seekers, "share", "shares", "part", "parts")
        .groupBy(*group)
        .cogroup(dealt(points, "part", "parts", "share", "shares").groupBy(*group))
        .applyInArrow(rank, f"query {kind}, query_hash long, point {kind}, point_hash long, score double")
    )


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = 20,
    id: str = "vec_id",
    vector: str = "embedding",
    tables: int = TABLES,
    probes: float = PROBES,
    seed: int = 42,
    exact_classes: int = EXACT_CLASSES,
) -> DataFrame:
    """(`query_id`, `rank`, `vec_id`, `score`): the `k` nearest found of every row where `queries` holds.

    Nearest is the largest inner product in double precision, ties to the smaller id; a query
    is no neighbour of itself, which means the id. Rows with a null id and vectors that are
    null, empty, zero or not finite take no part, and vectors of different sizes don't meet.
    Rows that repeat an id and its vector are one; an id with several vectors is a candidate
    with each. Equal vectors are one class with its smallest ids, so a vector with very many
    copies is hashed and ranked once. Cells with many points or queries are met in parts.
    Other columns, whatever their names, have no effect. An empty table gives an empty one.

    In every table a query looks into the share `probes` of the cells, or into the larger share
    that holds about `exact_classes` different vectors. So the fewer vectors there are, the more
    cells are looked into, in one rule for every number of them, and up to `exact_classes` all
    are met. Two things are exact beside the tables: where lengths differ, the longest tenth of
    the vectors is met by every query, since angles say little about their products; and a
    query that found fewer than it could is ranked again against everything.
    """
    own = vectors.select(F.col(f"`{id}`").alias("id"), F.col(f"`{vector}`").alias("vector"), queries.alias("asks"))
    own = own.where(usable("vector") & F.col("id").isNotNull())
    own = own.withColumn("vector", F.transform("vector", lambda x: x + 0)).groupBy("id", "vector").agg(F.max(F.coalesce("asks", F.lit(False))).alias("asks")).checkpoint()
    # Of one vector as many ids as may count: k, and those that an id takes from itself.
    twice = own.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first().n or 1
    most = k + twice
    ranked = own.select("vector", "id", F.expr("row_number() OVER (PARTITION BY vector ORDER BY id)").alias("n")).where(f"n <= {most}")
    classes = ranked.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double")))
    classes = classes.select("vector", "ids", F.xxhash64("vector").alias("hash"), F.size("vector").alias("size"), norm.alias("norm"))
    # Classes are numbered by a smallest id of theirs; repeated ids leave more than one with it.
    classes = classes.withColumn("class", F.struct(F.get("ids", F.lit(0)).alias("id"), "hash")).checkpoint()
    scale = classes.groupBy(F.col("size").alias("of")).agg(
        F.count(F.lit(1)).alias("classes"), F.expr(f"percentile_approx(norm, {1 - LONGEST_SHARE}, 1000)").alias("bound"), F.min("norm").alias("smallest")
    )
    rows_of = own.groupBy(F.size("vector").alias("of_rows")).agg(F.count(F.lit(1)).alias("rows"))
    known = classes.join(scale, F.col("size") == F.col("of")).withColumn("reach", F.least(F.lit(1.0), F.greatest(F.lit(float(probes)), exact_classes / F.col("classes"))))
    asked = own.where("asks").select("vector").distinct().withColumnRenamed("vector", "asked")
    searching = known.join(asked, F.col("vector") == F.col("asked"), "left_semi").checkpoint()
    # Lengths that are all alike make no vector long.
    long = (F.col("norm") > F.col("bound") * (1 + SAME_NORM)) | ((F.col("norm") >= F.col("bound")) & (F.col("bound") > F.col("smallest") * (1 + SAME_NORM)))
    points = _spotted(known, False, tables, seed).unionByName(_everywhere(known.where(long)))
    seekers = _spotted(searching, True, tables, seed).unionByName(_everywhere(searching)).checkpoint()

    def lists(met: DataFrame) -> DataFrame:
        """The `most` best rows of each class of queries, in order."""
        # Tables find the same pairs; a class of points holds at least one neighbour besides the query.
        pairs = met.groupBy("query", "query_hash", "point", "point_hash").agg(F.max("score").alias("score"))
        order = "PARTITION BY query, query_hash ORDER BY score DESC, point, point_hash"
        pairs = pairs.withColumn("n", F.expr(f"row_number() OVER ({order})")).where(f"n <= {most}").drop("n")
        named = classes.select(F.col("class.id").alias("point"), F.col("class.hash").alias("point_hash"), "ids")
        rows = pairs.join(named, ["point", "point_hash"]).select("query", "query_hash", "score", F.explode("ids").alias("vec_id"))
        rows = rows.withColumn("n", F.expr("row_number() OVER (PARTITION BY query, query_hash ORDER BY score DESC, vec_id)"))
        return rows.where(f"n <= {most}").groupBy("query", "query_hash").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found"))

    owner = searching.select(F.col("class.id").alias("query"), F.col("class.hash").alias("query_hash"), F.col("vector").alias("of_class"), "class", "size")
    answered = owner.join(lists(_met(points, seekers, most)), ["query", "query_hash"], "left").checkpoint()
    lacking = F.coalesce(F.size("found"), F.lit(0)) < F.least(F.lit(most), F.col("rows"))
    short = answered.join(F.broadcast(rows_of), F.col("size") == F.col("of_rows")).where(lacking).select("class", "size", F.col("of_class").alias("vector")).checkpoint()
    if not short.isEmpty():
        again = lists(_met(_everywhere(known), _everywhere(short), most)).select("query", "query_hash", F.col("found").alias("all_found"))
        answered = answered.join(again, ["query", "query_hash"], "left").withColumn("found", F.coalesce("all_found", "found"))
    others = F.slice(F.filter("found", lambda x: x.vec_id != F.col("id")), 1, k)
    return (
        own.where("asks")
        .join(answered.select("of_class", "found"), F.col("vector") == F.col("of_class"))
        .select(F.col("id").alias("query_id"), F.posexplode(others).alias("place", "one"))
        .select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("one.vec_id").alias("vec_id"), F.col("one.score").alias("score"))
    )

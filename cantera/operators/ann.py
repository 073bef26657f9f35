"""Approximate neighbours: coarse cells around k-means centres, a few of them searched.

Opt-in. Exact search is the default, and `recall` says what the cells cost.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cantera.operators import knn as K


# Points that centres are fitted to: those whose hashed vectors are smallest.
SAMPLE = 50_000
# Bits that a hash is shifted to get its range: one of 4,096.
RANGE_BITS = 52


def smallest_hashes(points: DataFrame, vector: str, sample: int, seed: int) -> DataFrame:
    """(`vector`, `hash`) of the ranges of hashes that hold the `sample` smallest, so that little more than these is put in order."""
    hashed = points.filter(F.col(vector).isNotNull()).select(vector, F.xxhash64(F.lit(seed), vector).alias("hash"))
    part = F.shiftright("hash", RANGE_BITS)
    held = 0
    for row in sorted(hashed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):
        held += row.n
        if held >= sample:
            return hashed.filter(part <= row.part)
    return hashed


def fit_cells(points: DataFrame, vector: str, cells: int, seed: int = 7, iterations: int = 10, sample: int = SAMPLE) -> np.ndarray:
    """Centres of `cells` clusters of the unit vectors of up to `sample` points."""
    drawn = smallest_hashes(points, vector, sample, seed).orderBy("hash").limit(sample)
    features = drawn.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=iterations, distanceMeasure="cosine").fit(features)
    return np.array(model.clusterCenters())


def fixed_cells(points: DataFrame, vector: str, cells: int, id: str = "id") -> np.ndarray:
    """Centres that are points themselves, those with the smallest ids: a rule that SQL can follow."""
    few = points.filter(F.col(vector).isNotNull()).select(id, vector).orderBy(id).limit(cells).toArrow()
    return K._matrix(few.column(vector))


def nearest_cells(df: DataFrame, vector: str, centres: np.ndarray, probes: int, into: str = "cells") -> DataFrame:
    """Add the `probes` cells whose centres are nearest by cosine, nearest first."""
    unit = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    shared = df.sparkSession.sparkContext.broadcast(unit)

    @F.arrow_udf("array<int>")
    def assign(vectors: pa.Array) -> pa.Array:
        matrix = K._matrix(vectors)
        if not len(matrix):
            return pa.array([], pa.list_(pa.int32()))
        cosine = matrix @ shared.value.T / np.maximum(K._norms(matrix), 1e-300)[:, None]
        # Centres whose cosines differ by rounding only are taken in their order.
        order = np.argsort(-np.round(cosine, 9), axis=1, kind="stable")[:, :probes]
        width = order.shape[1]
        offsets = np.arange(0, order.size + 1, width, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(order.ravel().astype(np.int32)))

    return df.filter(F.col(vector).isNotNull()).withColumn(into, assign(vector))


def assign_cells(points: DataFrame, vector: str, centres: np.ndarray) -> DataFrame:
    """Points with their `cell`. Written out partitioned by it, a search reads probed cells only."""
    found = nearest_cells(points, vector, centres, 1, "_cells")
    return found.withColumn("cell", F.get("_cells", F.lit(0))).drop("_cells")


def write_cells(points: DataFrame, vector: str, centres: np.ndarray, path: str) -> DataFrame:
    """Write the points in one folder per cell and give the written table; a search reads the cells it names."""
    celled = assign_cells(points, vector, centres)
    celled.write.partitionBy("cell").parquet(path)
    return points.sparkSession.read.schema(celled.schema).parquet(path)


def ann_knn(
    queries: DataFrame,
    points: DataFrame,
    vector: str,
    k: int,
    centres: np.ndarray,
    probes: int,
    filters: Sequence[str] = (),
) -> DataFrame:
    """(qid, id, score, position) of the best k points within each query's `probes` cells.

    A cell is one more filter of the exact search: a query asks once per cell it probes.
    Points of a cell are never paired up or gathered, so a large cell is no hot spot.
    """
    asked = nearest_cells(queries, "vector", centres, probes).withColumn("cell", F.explode("cells"))
    per_cell = K.knn(asked, points, vector, k, (*filters, "cell"))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("id"))
    return per_cell.withColumn("position", F.row_number().over(best)).filter(F.col("position") <= k)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that were found."""
    found = exact.select("qid", "id").join(approximate.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return found.agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))

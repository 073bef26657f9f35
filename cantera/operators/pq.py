"""Approximate neighbours from an inverted index of product-quantised residuals.

A unit vector is the centre of its cell plus a residual, and the residual's parts are numbers
of code words: one byte for each part instead of four for each coordinate. A query looks into
the cells of its nearest centres. The product with a point is the one with its centre plus, for
each part, a look-up in a table of the query's products with the code words; that ranks the
codes without reading a vector. Only the vectors of a short list are read and scored exactly.

Building the index reads every point. Codes lie sorted by cell, vectors by id, so that a search
with few queries skips most of both.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantera.operators import knn as K

# The fit sees at most so many points, those whose hashed ids are smallest, on the driver.
SAMPLE = 20_000
# Code words of a part: a number of theirs is a byte.
WORDS = 256
PARTS = 16
MAX_CELLS = 4096
ROUNDS = 8
# Points and queries of a cell that meet in one task.
POINTS_AT_ONCE, QUERIES_AT_ONCE = 1 << 16, 1024
CHUNK = 4096


@dataclass
class Codebook:
    """Unit centres (cells × width) and code words of each part of a residual (parts × words × width of a part)."""

    centres: np.ndarray
    words: np.ndarray

    @property
    def width(self) -> int:
        return self.centres.shape[1]

    def parts(self, residual: np.ndarray) -> np.ndarray:
        """Rows cut into parts, the last one filled up with zeros: parts × rows × width of a part."""
        parts, _, wide = self.words.shape
        padded = np.pad(residual, ((0, 0), (0, parts * wide - residual.shape[1])))
        return padded.reshape(len(residual), parts, wide).transpose(1, 0, 2)

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, codes) of unit vectors; the smaller number wins a tie."""
        cell = _first_best(unit @ self.centres.T)
        codes = np.empty((len(unit), len(self.words)), np.uint8)
        for j, part in enumerate(self.parts(unit - self.centres[cell])):
            words = self.words[j]
            codes[:, j] = _first_best(2 * part @ words.T - (words * words).sum(axis=1))
        return cell, codes

    def tables(self, unit: np.ndarray) -> np.ndarray:
        """Products of queries with all code words: parts × queries × words."""
        return np.einsum("jqw,jcw->jqc", self.parts(unit), self.words)


def _first_best(score: np.ndarray) -> np.ndarray:
    """The first place of the largest value of each row, values that differ by rounding being equal."""
    return np.argmax(np.round(score, 9), axis=1)


def _clusters(rows: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Centres of up to `count` clusters by Lloyd's rounds, from distinct rows drawn by `seed`."""
    distinct = np.unique(rows, axis=0)
    pick = np.random.default_rng(seed)
    centres = distinct[pick.choice(len(distinct), min(count, len(distinct)), replace=False)]
    for _ in range(ROUNDS):
        nearest = np.concatenate([
            np.argmax(2 * part @ centres.T - (centres * centres).sum(axis=1), axis=1) for part in np.array_split(rows, -(-len(rows) // CHUNK))
        ])
        n = np.bincount(nearest, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, nearest, rows)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def usual_cells(points: int) -> int:
    """The square root of the number of points, at most `MAX_CELLS`."""
    return int(max(1, min(MAX_CELLS, round(points**0.5))))


def _unit(table: pa.Table) -> np.ndarray:
    matrix = K._matrix(table.column("_vector"))
    norms = K._norms(matrix) if len(matrix) else np.zeros(0)
    return matrix[norms > 0] / norms[norms > 0][:, None]


def _codebook(unit: np.ndarray, cells: int, parts: int, cluster) -> Codebook:
    centres = cluster(unit, cells)
    centres = centres / np.maximum(K._norms(centres), 1e-12)[:, None]
    wide = -(-unit.shape[1] // parts)
    book = Codebook(centres, np.zeros((parts, 1, wide)))
    residual = unit - centres[_first_best(unit @ centres.T)]
    words = np.zeros((parts, WORDS, wide))
    for j, part in enumerate(book.parts(residual)):
        found = cluster(part, WORDS)
        words[j] = found[np.arange(WORDS) % len(found)]
    return Codebook(centres, words)


def fit(points: DataFrame, vector: str, id: str = "id", cells: int | None = None, parts: int = PARTS, sample: int = SAMPLE, seed: int = 7) -> Codebook:
    """Cells and code words learned from the `sample` points whose hashed ids are smallest; None without any.

    The number of cells follows the number of all points, unless it is given. Null and zero
    vectors teach nothing.
    """
    known = points.filter(F.col(vector).isNotNull())
    drawn = known.select(F.col(id).alias("_id"), F.col(vector).alias("_vector")).orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(sample)
    unit = _unit(drawn.toArrow())
    if not len(unit):
        return None
    count = cells or min(usual_cells(known.count()), len(unit))
    return _codebook(unit, count, parts, lambda rows, n: _clusters(rows, n, seed))


def fixed(points: DataFrame, vector: str, id: str = "id", cells: int = 16, parts: int = PARTS) -> Codebook:
    """Cells and code words that are points themselves, those with the smallest ids: a rule that SQL can follow."""
    few = points.filter(F.col(vector).isNotNull()).select(F.col(id).alias("_id"), F.col(vector).alias("_vector")).orderBy("_id").limit(max(cells, WORDS))
    return _codebook(_unit(few.toArrow()), cells, parts, lambda rows, n: rows[:n])


@dataclass
class Index:
    """Stored codes (`id`, `cell`, `codes`) and vectors (`id`, `vector`), the codebook and the size of each cell."""

    codes: DataFrame
    vectors: DataFrame
    book: Codebook
    sizes: np.ndarray


def build(points: DataFrame, vector: str, book: Codebook, path: str, id: str = "id") -> Index:
    """Write the index of all points under `path`. Points without a usable vector are not in it."""
    spark = points.sparkSession
    shared = spark.sparkContext.broadcast(book)
    narrow = points.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vector")).filter("vector IS NOT NULL")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                matrix = K._matrix(part.column("vector"))
                norms = K._norms(matrix)
                kept = np.flatnonzero(norms > 0)
                cell, codes = shared.value.encode(matrix[kept] / norms[kept][:, None])
                flat = pa.py_buffer(np.ascontiguousarray(codes).tobytes())
                offsets = pa.py_buffer((np.arange(len(kept) + 1) * codes.shape[1]).astype(np.int32))
                binary = pa.Array.from_buffers(pa.binary(), len(kept), [None, offsets, flat])
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(kept)), pa.array(cell, pa.int32()), binary], names=["id", "cell", "codes"])

    kinds = "id long, cell int, codes binary"
    narrow.mapInArrow(encode, kinds).repartitionByRange("cell", "id").sortWithinPartitions("cell").write.parquet(f"{path}/codes")
    narrow.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{path}/vectors")
    return read(spark, path, book, narrow.schema)


def read(spark: SparkSession, path: str, book: Codebook, schema: T.StructType) -> Index:
    codes = spark.read.schema("id long, cell int, codes binary").parquet(f"{path}/codes")
    sizes = np.zeros(len(book.centres), np.int64)
    for row in codes.groupBy("cell").count().collect():
        sizes[row.cell] = row["count"]
    return Index(codes, spark.read.schema(schema).parquet(f"{path}/vectors"), book, sizes)


def probed(queries: DataFrame, index: Index, probes: int, qid: str = "qid", vector: str = "vector") -> DataFrame:
    """(`qid`, `vector`, `cells`): the queries with the `probes` cells whose centres are nearest, nearest first.

    Null and zero vectors ask nothing.
    """
    shared = queries.sparkSession.sparkContext.broadcast(index.book.centres)
    rows = queries.select(qid, F.col(vector).alias("vector")).filter("vector IS NOT NULL")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            matrix = K._matrix(batch.column("vector"))
            norms = K._norms(matrix) if len(matrix) else np.zeros(0)
            kept = np.flatnonzero(norms > 0)
            score = matrix[kept] @ centres.T / norms[kept][:, None] if len(kept) else np.zeros((0, len(centres)))
            cells = np.argsort(-np.round(score, 9), axis=1, kind="stable")[:, :probes].astype(np.int32)
            offsets = np.arange(len(kept) + 1, dtype=np.int32) * cells.shape[1]
            part = batch.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(cells.ravel()))], names=[qid, "vector", "cells"])

    return rows.mapInArrow(place, T.StructType([*rows.schema, T.StructField("cells", T.ArrayType(T.IntegerType()))]))


def shortlist(asked: DataFrame, index: Index, length: int, qid: str = "qid") -> DataFrame:
    """(`qid`, `id`, `near`): for each of the `probed` queries the `length` points of its cells with the best codes.

    Codes and queries of a cell meet in a task, in parts where the cell has many of either;
    each gives its best `length` of a query. `near` is rounded, ties go to the smaller id.
    """
    spark = asked.sparkSession
    shared = spark.sparkContext.broadcast(index.book)
    parts = -(-index.sizes // POINTS_AT_ONCE)
    spread = asked.select(qid, "vector", F.explode("cells").alias("cell"))
    load = {row.cell: row["count"] for row in spread.groupBy("cell").count().collect()}
    shape = [(int(cell), int(parts[cell]), -(-n // QUERIES_AT_ONCE)) for cell, n in load.items() if parts[cell]]
    schema = T.StructType([asked.schema[qid], T.StructField("id", T.LongType()), T.StructField("near", T.DoubleType())])
    if not shape:
        return spark.createDataFrame([], schema)
    tiles = F.broadcast(spark.createDataFrame(shape, "cell int, parts int, shares int"))

    def dealt(frame: DataFrame, key: str, own: str, own_of: str, other: str, other_of: str) -> DataFrame:
        met = frame.join(tiles, "cell").withColumn(own, F.pmod(F.xxhash64(key), F.col(own_of)).cast("int"))
        return met.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_of) - 1))).drop("parts", "shares")

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, ids, near = [], [], []
        if left.num_rows and right.num_rows:
            book = shared.value
            matrix = K._matrix(left.column("vector"))
            unit = matrix / K._norms(matrix)[:, None]
            base = unit @ book.centres[left.column("cell")[0].as_py()]
            tables = book.tables(unit)
            order = np.argsort(right.column("id").to_numpy(), kind="stable")
            own = right.take(pa.array(order))
            codes = np.frombuffer(b"".join(own.column("codes").to_pylist()), np.uint8).reshape(len(own), -1)
            step = max(1, (1 << 24) // len(own))
            for at in range(0, len(unit), step):
                score = np.repeat(base[at : at + step, None], len(own), axis=1)
                for j in range(codes.shape[1]):
                    score += tables[j, at : at + step][:, codes[:, j]]
                score = np.round(score, 9)
                best = np.argsort(-score, axis=1, kind="stable")[:, :length]
                query = np.repeat(np.arange(len(score)), best.shape[1])
                keys.append(query + at)
                ids.append(best.ravel())
                near.append(score[query, best.ravel()])
            keys, ids, near = (np.concatenate(x) for x in (keys, ids, near))
            return pa.table([left.column(qid).take(pa.array(keys)), own.column("id").take(pa.array(ids)), pa.array(near)], names=[qid, "id", "near"])
        return pa.table([left.column(qid).slice(0, 0), pa.array([], pa.int64()), pa.array([], pa.float64())], names=[qid, "id", "near"])

    tile = ["cell", "part", "share"]
    left = dealt(spread, qid, "share", "shares", "part", "parts")
    right = dealt(index.codes, "id", "part", "parts", "share", "shares")
    met = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(rank, schema)
    best = Window.partitionBy(qid).orderBy(F.desc("near"), F.asc("id"))
    return met.withColumn("_place", F.row_number().over(best)).filter(F.col("_place") <= length).drop("_place")


def search(
    queries: DataFrame, index: Index, k: int, probes: int, length: int, qid: str = "qid", vector: str = "vector", found: DataFrame | None = None
) -> DataFrame:
    """(`qid`, `id`, `score`, `position`): the best `k` by exact cosine of each query's short list of `length` points.

    `found` is a short list that is there already.
    """
    asked = probed(queries, index, probes, qid, vector)
    listed = found if found is not None else shortlist(asked.checkpoint(), index, length, qid)
    rows = listed.select(qid, "id").join(index.vectors.withColumnRenamed("vector", "_point"), "id").join(asked.select(qid, "vector"), qid)
    rows = rows.select(qid, "id", "vector", "_point")
    schema = T.StructType([rows.schema[qid], T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                a, b = K._matrix(part.column("vector")), K._matrix(part.column("_point"))
                cosine = (a * b).sum(axis=1) / (K._norms(a) * K._norms(b))
                yield pa.RecordBatch.from_arrays([part.column(qid), part.column("id"), pa.array(cosine)], names=[qid, "id", "score"])

    best = Window.partitionBy(qid).orderBy(F.desc("score"), F.asc("id"))
    scored = rows.mapInArrow(score, schema)
    return scored.withColumn("position", F.row_number().over(best)).filter(F.col("position") <= k)


def reading(queries: DataFrame, index: Index, exact: DataFrame, k: int, probes: int, length: int, qid: str = "qid", vector: str = "vector") -> DataFrame:
    """One row per query: neighbours `found` of those `wanted`, and how many `codes` and `vectors` of the `points` it read."""
    asked = probed(queries, index, probes, qid, vector).checkpoint()
    listed = shortlist(asked, index, length, qid).checkpoint()
    hits = search(queries, index, k, probes, length, qid, vector, listed)
    sizes = F.array(*[F.lit(int(n)) for n in index.sizes])
    read_codes = F.aggregate("cells", F.lit(0).cast("long"), lambda total, cell: total + F.get(sizes, cell))
    wanted = exact.groupBy(qid).agg(F.count(F.lit(1)).alias("wanted"))
    got = hits.join(exact.select(qid, "id"), [qid, "id"], "left_semi").groupBy(qid).agg(F.count(F.lit(1)).alias("found"))
    vectors = listed.groupBy(qid).agg(F.count(F.lit(1)).alias("vectors"))
    rows = asked.select(qid, read_codes.alias("codes")).join(wanted, qid).join(got, qid, "left").join(vectors, qid, "left")
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return rows.select(qid, zero("found"), "wanted", "codes", zero("vectors"), F.lit(int(index.sizes.sum())).cast("long").alias("points"))

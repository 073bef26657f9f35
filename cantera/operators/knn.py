"""Exact cosine top-k of many queries against a table of vectors.

Points never shuffle while the queries fit a checked bound: the query matrix is broadcast,
each task multiplies it with its Arrow batches, keeps the best k per query, and only those
few rows are ranked across tasks. More queries than that meet the points in tiles
(`_in_tiles`), so neither side has to fit anywhere as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Queries that may be broadcast, and the bytes their vectors may take.
MAX_QUERIES = 4096
MAX_QUERY_BYTES = 128 << 20
# Results per query that these bounds are meant for; more of them lower the number of queries.
TOP = 5
# Points multiplied at once, numbers of their vectors, and numbers held at once while candidates are scored exactly.
CHUNK = 2048
POINT_NUMBERS = 1 << 20
SCORING = 1 << 20
# Beyond the bounds: cells that points lie in, points that a first bound comes from, bytes of a tile's points.
CELLS = 64
SAMPLE = 2048
TILE_BYTES = 32 << 20


def _matrix(column: pa.Array) -> np.ndarray:
    """List column to a 2-D array of doubles; every vector must have the same width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    widths = pc.list_value_length(column)
    width = widths[0].as_py()
    if pc.any(pc.not_equal(widths, width)).as_py():
        raise ValueError("vectors of one column differ in width")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _norms(matrix: np.ndarray) -> np.ndarray:
    return np.sqrt((matrix * matrix).sum(axis=1))


def _codes(column: pa.Array, values: list) -> np.ndarray:
    """Position of each entry in `values`, -1 for anything else, so filters compare integers."""
    kind = pa.float64() if pa.types.is_floating(column.type) else column.type
    found = pc.index_in(column.cast(kind), pa.array(values, kind))
    return pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)


@dataclass
class Queries:
    """Query vectors without zero rows, and the filter values of each."""

    keys: pa.Array
    vectors: np.ndarray
    filters: list[list]
    norms: np.ndarray = field(init=False)
    unit: np.ndarray = field(init=False)
    values: list[list] = field(init=False)
    groups: dict[tuple, np.ndarray] = field(init=False)

    def __post_init__(self):
        norms = _norms(self.vectors)
        alive = np.flatnonzero(norms > 0)
        self.keys = self.keys.take(pa.array(alive, pa.int64()))
        self.vectors, self.norms = self.vectors[alive], norms[alive]
        self.unit = (self.vectors / self.norms[:, None]).astype(np.float32)
        # Per filter column its distinct values; per combination of them its queries.
        columns = [[column[i] for i in alive] for column in self.filters]
        self.values = [sorted({v for v in column if v is not None}) for column in columns]
        places = [{v: i for i, v in enumerate(values)} for values in self.values]
        groups: dict[tuple, list[int]] = {}
        for row in range(len(alive)):
            wanted = tuple(
                None if column[row] is None else place[column[row]] for column, place in zip(columns, places)
            )
            groups.setdefault(wanted, []).append(row)
        self.groups = {wanted: np.array(rows) for wanted, rows in groups.items()}

    @classmethod
    def of(cls, table: pa.Table, key: str, vector: str, filters: Sequence[str]) -> "Queries":
        keys = table.column(key)
        keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
        return cls(keys, _matrix(table.column(vector)), [table.column(name).to_pylist() for name in filters])


class Best:
    """The k best points per query among those seen so far; ties go to the smaller id."""

    def __init__(self, queries: Queries, k: int):
        self.queries, self.k = queries, k
        self.query = np.zeros(0, np.int64)
        self.score = np.zeros(0)
        self.id = np.zeros(0, np.int64)
        self.floor = np.full(len(queries.vectors), -np.inf)

    def see(self, ids: np.ndarray, vectors: np.ndarray, attributes: list[pa.Array]) -> None:
        if not len(self.queries.vectors) or not len(ids):
            return
        if vectors.shape[1] != self.queries.vectors.shape[1]:
            raise ValueError("query and point vectors differ in width")
        codes = [_codes(column, values) for column, values in zip(attributes, self.queries.values)]
        for start in range(0, len(ids), CHUNK):
            part = slice(start, start + CHUNK)
            self._chunk(ids[part], vectors[part], [code[part] for code in codes])

    def _chunk(self, ids: np.ndarray, vectors: np.ndarray, codes: list[np.ndarray]) -> None:
        norms = _norms(vectors)
        kept = np.flatnonzero(norms > 0)
        kept = kept[self._needed(ids[kept], vectors[kept], [code[kept] for code in codes])]
        ids, vectors, norms, codes = ids[kept], vectors[kept], norms[kept], [code[kept] for code in codes]
        unit = (vectors / norms[:, None]).astype(np.float32)
        # Twice the largest rounding error a dot product of unit float32 vectors can have.
        margin = 2 * (vectors.shape[1] + 8) * 2.0**-24
        found = []
        for wanted, rows in self.queries.groups.items():
            allowed = np.ones(len(ids), bool)
            for code, value in zip(codes, wanted):
                if value is not None:
                    allowed &= code == value
            at = np.flatnonzero(allowed)
            if not len(at):
                continue
            rough = self.queries.unit[rows] @ unit[at].T
            floor = self.floor[rows]
            if len(at) > self.k:
                kth = np.partition(rough, len(at) - self.k, axis=1)[:, len(at) - self.k]
                floor = np.maximum(floor, kth - margin)
            near = rough >= (floor - margin)[:, None]
            if near.sum() > 4 * near.shape[0] * self.k and self._whole(vectors):
                # Many candidates tie, most at zero. Sums of products of whole numbers are
                # exact in any order, so one product of doubles scores and ranks them all.
                found.append(self._product(rows, at, ids, vectors, norms))
                continue
            q, p = np.nonzero(near)
            found.append(self._exact(rows[q], at[p], ids, vectors, norms))
        if found:
            self._merge(*(np.concatenate(parts) for parts in zip(*found)))

    def _whole(self, vectors: np.ndarray) -> bool:
        bound = 2.0**26 / vectors.shape[1] ** 0.5
        return all(np.abs(m).max(initial=0) < bound and (m == np.rint(m)).all() for m in (vectors, self.queries.vectors))

    def _product(self, rows, at, ids, vectors, norms):
        """The k best points of `at` for each of the queries `rows`, all scores exact; ties to smaller ids."""
        score = (self.queries.vectors[rows] @ vectors[at].T) / (self.queries.norms[rows][:, None] * norms[at])
        order = np.argsort(ids[at], kind="stable")
        score = score[:, order]
        best = np.argsort(-score, axis=1, kind="stable")[:, : self.k]
        q = np.repeat(np.arange(len(rows)), best.shape[1])
        kept = score[q, best.ravel()] >= self.floor[rows[q]]
        q, p = q[kept], best.ravel()[kept]
        return rows[q], score[q, p], ids[at][order][p]

    def _needed(self, ids: np.ndarray, vectors: np.ndarray, codes: list[np.ndarray]) -> np.ndarray:
        """Leave out copies that cannot rank: of equal vectors only the k smallest ids can."""
        salt = np.random.default_rng(7).standard_normal(vectors.shape[1])
        mark = (vectors * salt).sum(axis=1)
        order = np.lexsort((ids, *codes, mark))
        same = np.zeros(len(order), bool)
        near = np.flatnonzero(mark[order][1:] == mark[order][:-1]) + 1
        same[near] = (vectors[order[near]] == vectors[order[near - 1]]).all(axis=1)
        for code in codes:
            same[near] &= code[order[near]] == code[order[near - 1]]
        at = np.arange(len(order))
        run = np.maximum.accumulate(np.where(same, 0, at)) if len(order) else at
        return np.sort(order[at - run < self.k])

    def _exact(self, q, p, ids, vectors, norms):
        """Scores in double, summed in one order, so equal vectors score equally."""
        score = np.empty(len(q))
        step = max(1, SCORING // vectors.shape[1])
        for start in range(0, len(q), step):
            part = slice(start, start + step)
            score[part] = (self.queries.vectors[q[part]] * vectors[p[part]]).sum(axis=1)
        return q, score / (self.queries.norms[q] * norms[p]), ids[p]

    def _merge(self, query, score, id):
        query = np.concatenate([self.query, query])
        score = np.concatenate([self.score, score])
        id = np.concatenate([self.id, id])
        order = np.lexsort((id, -score, query))
        query, score, id = query[order], score[order], id[order]
        starts = np.searchsorted(query, query)
        place = np.arange(len(query)) - starts
        kept = place < self.k
        full = place == self.k - 1
        self.floor[query[full]] = score[full]
        self.query, self.score, self.id = query[kept], score[kept], id[kept]

    def rows(self) -> tuple[pa.Array, pa.Array, pa.Array]:
        return self.queries.keys.take(pa.array(self.query)), pa.array(self.id), pa.array(self.score)


@dataclass
class SearchList:
    """One list of neighbours: `queries` against column `vector` of the points."""

    name: str
    queries: DataFrame
    vector: str
    query_vector: str = "vector"


def knn(
    queries: DataFrame,
    points: DataFrame,
    vector: str,
    k: int,
    filters: Sequence[str] = (),
    qid: str = "qid",
    id: str = "id",
    query_vector: str = "vector",
    max_queries: int = MAX_QUERIES,
) -> DataFrame:
    """(qid, id, score, position) of the k best points per query.

    `filters` names columns of both sides; a null on the query side is no constraint.
    """
    lists = [SearchList("", queries, vector, query_vector)]
    return search_lists(lists, points, k, filters, qid, id, max_queries).drop("list")


def search_lists(
    lists: Sequence[SearchList],
    points: DataFrame,
    k: int,
    filters: Sequence[str] = (),
    qid: str = "qid",
    id: str = "id",
    max_queries: int = MAX_QUERIES,
) -> DataFrame:
    """(list, qid, id, score, position): all lists that fit are served by one scan of the points."""
    spark = points.sparkSession
    small: list[tuple[str, str, Queries]] = []
    parts: list[DataFrame] = []
    for item in lists:
        queries = item.queries.select(qid, item.query_vector, *filters).filter(F.col(item.query_vector).isNotNull())
        # Number and size are looked at before any vector is fetched.
        elements = F.sum(F.size(item.query_vector).cast("long"))
        size = queries.limit(max_queries + 1).agg(F.count(F.lit(1)).alias("n"), elements.alias("elements")).first()
        if size.n <= max_queries and (size.elements or 0) * 8 <= MAX_QUERY_BYTES:
            small.append((item.name, item.vector, Queries.of(queries.toArrow(), qid, item.query_vector, filters)))
        else:
            parts.append(_in_tiles(item, queries, points, k, filters, qid, id, max_queries))
    key_type = lists[0].queries.schema[qid].dataType
    if small:
        parts.insert(0, _broadcasted(spark, small, points, k, filters, qid, id, key_type))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    best = Window.partitionBy("list", qid).orderBy(F.desc("score"), F.asc(id))
    return found.withColumn("position", F.row_number().over(best)).filter(F.col("position") <= k)


def _hit_schema(qid: str, id: str, key_type: T.DataType) -> T.StructType:
    return (
        T.StructType()
        .add("list", T.StringType())
        .add(qid, key_type)
        .add(id, T.LongType())
        .add("score", T.DoubleType())
    )


def _hits(name: str, best: Best, qid: str, id: str) -> pa.RecordBatch:
    keys, ids, scores = best.rows()
    return pa.RecordBatch.from_arrays(
        [pa.array([name] * len(ids), pa.string()), keys, ids, scores], names=["list", qid, id, "score"]
    )


def _broadcasted(spark, small, points, k, filters, qid, id, key_type) -> DataFrame:
    # A list without queries needs no column of the points.
    small = [item for item in small if len(item[2].vectors)] or small[:1]
    shared = spark.sparkContext.broadcast(small)
    vectors = sorted({vector for _, vector, _ in small})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [(name, vector, Best(queries, k)) for name, vector, queries in shared.value]
        for batch in batches:
            for _, vector, best in lists:
                # A few points at a time become doubles, whatever the size of the batch.
                step = max(64, min(CHUNK, POINT_NUMBERS // max(1, best.queries.vectors.shape[1])))
                for first in range(0, batch.num_rows, step):
                    some = batch.slice(first, step)
                    part = some.filter(pc.is_valid(some.column(vector)))
                    ids = part.column(id).to_numpy(zero_copy_only=False)
                    best.see(ids, _matrix(part.column(vector)), [part.column(name) for name in filters])
        for name, _, best in lists:
            yield _hits(name, best, qid, id)

    narrow = points.select(F.col(id).cast("long"), *vectors, *filters)
    for at, column in enumerate(filters):
        if all(wanted[at] is not None for _, _, queries in small for wanted in queries.groups):
            # Every query constrains the column, so the scan need not read other rows.
            values = sorted({value for _, _, queries in small for value in queries.values[at]})
            narrow = narrow.filter(F.col(column).isin(values))
    return narrow.mapInArrow(scan, _hit_schema(qid, id, key_type))


def _in_tiles(item: SearchList, queries, points, k, filters, qid, id, max_queries) -> DataFrame:
    """More queries than may be broadcast: queries and points meet in tiles, wherever Spark puts them.

    Points lie in cells around a few centres. By the triangle inequality no point of a cell is
    nearer to a query than their angles to the centre differ, and the k-th best of a small
    sample of the points is a score that the k-th best of all must reach; a query goes only to
    the cells that can. Cells with many points are split into parts, their queries into shares.
    The points are read twice, to count the cells and to be searched, however many queries
    there are, and no query comes to the driver.
    """
    spark = points.sparkSession
    key_type = queries.schema[qid].dataType
    schema = _hit_schema(qid, id, key_type)
    mine, there = queries.withColumnRenamed(item.query_vector, "_vector"), item.vector
    narrow = points.select(F.col(id).cast("long").alias("_id"), F.col(there).alias("_vector"), *filters).filter("_vector IS NOT NULL")
    sample = narrow.limit(SAMPLE).toArrow().combine_chunks()
    few = _matrix(sample.column("_vector"))
    alive = np.flatnonzero(_norms(few) > 0)
    if not len(alive):
        return spark.createDataFrame([], schema)
    # Cells of a small table would be emptier than they are worth.
    centres = _spread_out(few[alive] / _norms(few[alive])[:, None], CELLS if len(few) == SAMPLE else 1 + len(few) // 256)
    shared = spark.sparkContext.broadcast((centres, sample))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, _ = shared.value
        for batch in batches:
            matrix = _matrix(batch.column("_vector"))
            kept = np.flatnonzero(_norms(matrix) > 0) if len(matrix) else np.zeros(0, np.int64)
            away = _angles(matrix[kept], centres) if len(kept) else np.zeros((0, 1))
            cell = away.argmin(axis=1)
            part = batch.take(pa.array(kept))
            columns = [*part.columns, pa.array(cell, pa.int32()), pa.array(away[np.arange(len(kept)), cell])]
            yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "_cell", "_angle"])

    celled = narrow.mapInArrow(place, _wider(narrow, _cell=T.IntegerType(), _angle=T.DoubleType()))
    cells = celled.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.min("_angle").alias("low"), F.max("_angle").alias("high")).collect()
    rings = spark.sparkContext.broadcast([(row["_cell"], row.low, row.high) for row in cells])

    def admit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, sample = shared.value
        for batch in batches:
            table = pa.Table.from_batches([batch])
            asked = Queries.of(table.append_column("_row", pa.array(np.arange(batch.num_rows))), "_row", "_vector", filters)
            best = Best(asked, k)
            best.see(sample.column("_id").to_numpy(), _matrix(sample.column("_vector")), [sample.column(name) for name in filters])
            away = _angles(asked.vectors, centres) if len(asked.vectors) else np.zeros((0, len(centres)))
            open_to = []
            for cell, low, high in rings.value:
                least = np.maximum(0, np.maximum(away[:, cell] - high, low - away[:, cell]) - 1e-6)
                open_to.append(np.cos(least) >= best.floor - 1e-9)
            numbers = np.array([cell for cell, _, _ in rings.value], np.int32)
            allowed = np.array(open_to, bool).reshape(len(numbers), len(asked.vectors)).T
            lists = pa.ListArray.from_arrays(
                pa.array(np.r_[0, np.cumsum(allowed.sum(axis=1))].astype(np.int32)), pa.array(numbers[np.nonzero(allowed)[1]])
            )
            kept = batch.take(asked.keys)
            yield pa.RecordBatch.from_arrays([*kept.columns, lists], names=[*kept.schema.names, "_cells"])

    asked = mine.mapInArrow(admit, _wider(mine, _cells=T.ArrayType(T.IntegerType()))).checkpoint()
    load = asked.select(F.explode("_cells").alias("_cell")).groupBy("_cell").agg(F.count(F.lit(1)).alias("queries")).collect()
    rows = max(256, TILE_BYTES // (8 * centres.shape[1]))
    wanted = {row["_cell"]: -(-row.queries // max_queries) for row in load}
    shape = [(row["_cell"], -(-row.n // rows), wanted[row["_cell"]]) for row in cells if row["_cell"] in wanted]
    if not shape:
        return spark.createDataFrame([], schema)
    tiles = F.broadcast(spark.createDataFrame(shape, "_cell int, _parts int, _shares int"))

    def dealt(frame: DataFrame, key: str, own: str, own_of: str, other: str, other_of: str) -> DataFrame:
        met = frame.join(tiles, "_cell")
        met = met.withColumn(own, F.pmod(F.xxhash64(key), F.col(own_of)).cast("int"))
        return met.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_of) - 1))).drop("_parts", "_shares")

    left = dealt(asked.withColumn("_cell", F.explode("_cells")).drop("_cells"), qid, "_share", "_shares", "_part", "_parts")
    right = dealt(celled.drop("_angle"), "_id", "_part", "_parts", "_share", "_shares")
    name = item.name

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        best = Best(Queries.of(left, qid, "_vector", filters), k)
        if left.num_rows and right.num_rows:
            best.see(right.column("_id").to_numpy(), _matrix(right.column("_vector")), [right.column(c).combine_chunks() for c in filters])
        return pa.Table.from_batches([_hits(name, best, qid, id)])

    tile = ["_cell", "_part", "_share"]
    return left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(rank, schema)


def _wider(frame: DataFrame, **more: T.DataType) -> T.StructType:
    return T.StructType([*frame.schema, *(T.StructField(name, kind) for name, kind in more.items())])


def _angles(matrix: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Angles between the rows and the unit vectors `centres`."""
    return np.arccos(np.clip(matrix @ centres.T / _norms(matrix)[:, None], -1, 1))


def _spread_out(unit: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` of the unit vectors, each the one farthest from those before."""
    chosen = [0]
    near = unit @ unit[0]
    while len(chosen) < min(most, len(unit)):
        far = int(near.argmin())
        if near[far] > 1 - 1e-9:
            break
        chosen.append(far)
        near = np.maximum(near, unit @ unit[far])
    return unit[chosen]

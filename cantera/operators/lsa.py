"""A text embedding learned from the lyrics themselves: TF-IDF weights and a truncated SVD.

A text is its words, each weighing (1 + ln of how often it is there) times the logarithm of how
few texts have it, to length one. The right singular vectors of that matrix bring words that
come together near each other. They are found by subspace iteration: a round is one pass over
the texts, each task multiplying its rows with the current basis, and what is summed has the
size of the vocabulary times the rank, whatever the number of texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantera.functions.batches import slices

# Words that most texts have, down to so many; with the rank they bound the model: some 20 MB.
VOCABULARY = 16_384
RANK, EXTRA = 64, 16
# Rounds end when no singular value moves by more than this share, or after so many.
TOLERANCE, ROUNDS = 1e-4, 12
# Words whose sums travel together, and texts that are multiplied at once.
BLOCK_WORDS, TEXTS_AT_ONCE = 64, 2048
WORDS_AT_ONCE = 1 << 16


@dataclass
class Model:
    """Words in order, the weight of each for its rarity, their vectors (words × rank) and the singular values."""

    words: list[str]
    rarity: np.ndarray
    vectors: np.ndarray
    values: np.ndarray

    def encoder(self) -> Callable[[list[str]], np.ndarray]:
        """Texts of space-separated words to vectors; one without a known word is zero."""
        known = pa.array(self.words, pa.string())

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), self.vectors.shape[1]), np.float32)
            for at in range(0, len(texts), TEXTS_AT_ONCE):
                row, word, weight = weights(pa.array(texts[at : at + TEXTS_AT_ONCE], pa.string()), known, self.rarity)
                np.add.at(out, at + row, (weight[:, None] * self.vectors[word]).astype(np.float32))
            return out

        return encode


def weights(texts: pa.Array, known: pa.Array, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, weight) of every known word of every text, in order; the weights of a row have length one."""
    parts = pc.split_pattern(pc.fill_null(texts, ""), " ")
    coded = parts.flatten().dictionary_encode()
    place = pc.fill_null(pc.index_in(coded.dictionary, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    word = place[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
    row = pc.list_parent_indices(parts).to_numpy()
    pair, times = np.unique(row[word >= 0] * max(1, len(known)) + word[word >= 0], return_counts=True)
    row, word = pair // max(1, len(known)), pair % max(1, len(known))
    weight = (1 + np.log(times)) * rarity[word]
    length = np.sqrt(np.bincount(row, weight * weight, minlength=len(texts)))
    kept = length[row] > 0
    return row[kept], word[kept], weight[kept] / length[row[kept]]


def vocabulary(df: DataFrame, words: str, most: int = VOCABULARY, least: int = 2) -> tuple[DataFrame, int]:
    """(`word`, `texts`, `place`) of up to `most` words that `least` texts have, most frequent first; and the number of texts."""
    texts = df.filter(F.col(words).isNotNull()).select(F.split(words, " ").alias("words"))
    held = texts.select(F.explode(F.array_distinct("words")).alias("word")).filter("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("texts"))
    common = held.filter(F.col("texts") >= least).orderBy(F.desc("texts"), "word").limit(most)
    number = F.expr("row_number() OVER (ORDER BY texts DESC, word)")
    return common.withColumn("place", number), texts.count()


def rarities(texts: np.ndarray, of: int) -> np.ndarray:
    return np.log((1 + of) / (1 + texts)) + 1


def tfidf(df: DataFrame, id: str, words: str, most: int = VOCABULARY, least: int = 2) -> DataFrame:
    """(`id`, `word`, `weight`): the weighted words of every text, in columns."""
    known, of = vocabulary(df, words, most, least)
    rare = (F.log((1 + F.lit(of)) / (1 + F.col("texts"))) + 1).alias("rarity")
    rows = df.select(id, F.explode(F.split(words, " ")).alias("word")).groupBy(id, "word").agg(F.count(F.lit(1)).alias("times"))
    weighed = rows.join(F.broadcast(known.select("word", rare)), "word").select(id, "word", ((1 + F.log("times")) * F.col("rarity")).alias("weight"))
    length = F.expr(f"sqrt(sum(weight * weight) OVER (PARTITION BY `{id}`))")
    return weighed.withColumn("weight", F.col("weight") / length)


def fit(
    df: DataFrame, words: str, rank: int = RANK, most: int = VOCABULARY, least: int = 2, rounds: int = ROUNDS, tolerance: float = TOLERANCE, seed: int = 7
) -> Model:
    """The model of the texts in column `words`, which holds space-separated words; null texts teach nothing.

    A vocabulary smaller than the rank gives as many values as it has words.
    """
    spark = df.sparkSession
    common, of = vocabulary(df, words, most, least)
    table = common.orderBy("place").toArrow()
    known = table.column("word").combine_chunks()
    rarity = rarities(table.column("texts").to_numpy(), of)
    V = len(known)
    if not V:
        return Model([], rarity, np.zeros((0, 0)), np.zeros(0))
    shared = spark.sparkContext.broadcast((known, rarity))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rarity = shared.value
        for batch in batches:
            for texts in slices(batch.column(0), most_texts=TEXTS_AT_ONCE):
                row, word, weight = weights(texts, known, rarity)
                offsets = np.r_[0, np.cumsum(np.bincount(row, minlength=len(texts)))].astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (word.astype(np.int32), weight)]
                yield pa.RecordBatch.from_arrays(lists, names=["word", "weight"])

    rows = df.filter(F.col(words).isNotNull()).select(words).mapInArrow(weigh, "word array<int>, weight array<double>").checkpoint()
    wide = min(V, rank + EXTRA)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((V, wide)))[0]
    before = np.zeros(min(rank, wide))
    for _ in range(rounds):
        product = _gram(rows, basis)
        value, turn = np.linalg.eigh(basis.T @ product)
        order = np.argsort(-value)[: min(rank, wide)]
        values = np.sqrt(np.maximum(value[order], 0))
        vectors = basis @ turn[:, order]
        settled = (np.abs(values - before) <= tolerance * np.maximum(values, 1e-12)).all()
        before = values
        if settled or wide == V:
            break
        basis = np.linalg.qr(product)[0]
    # One sign for each vector: its largest entry is positive.
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return Model(known.to_pylist(), rarity, vectors, values)


def _gram(rows: DataFrame, basis: np.ndarray) -> np.ndarray:
    """The matrix's product with itself, transposed, times `basis`: words × columns, summed over all tasks."""
    shared = rows.sparkSession.sparkContext.broadcast(basis)
    wide = basis.shape[1]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis = shared.value
        total = np.zeros_like(basis)
        for batch in batches:
            words, weights = batch.column("word"), batch.column("weight")
            ends = np.r_[0, np.cumsum(pc.list_value_length(words).to_numpy())]
            first = 0
            while first < batch.num_rows:
                # Whole texts, as many as have some number of words; one has at most the vocabulary.
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + WORDS_AT_ONCE, "right")) - 1)
                some = slice(first, last)
                w, x = words[some].flatten().to_numpy(), weights[some].flatten().to_numpy()
                r = np.repeat(np.arange(last - first), np.diff(ends[first : last + 1]))
                first = last
                if not len(w):
                    continue
                begins = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                own = np.add.reduceat(x[:, None] * basis[w], begins, axis=0)
                own = np.repeat(own, np.diff(np.r_[begins, len(r)]), axis=0)
                order = np.argsort(w, kind="stable")
                firsts = np.flatnonzero(np.r_[True, np.diff(w[order]) != 0])
                total[w[order][firsts]] += np.add.reduceat((x[:, None] * own)[order], firsts, axis=0)
        for block in range(0, len(total), BLOCK_WORDS):
            values = total[block : block + BLOCK_WORDS]
            if values.any():
                lists = pa.ListArray.from_arrays(pa.array([0, values.size], pa.int32()), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), lists], names=["block", "sums"])

    parts = rows.mapInArrow(multiply, "block int, sums array<double>")
    summed = parts.groupBy("block").agg(Summarizer.sum(array_to_vector("sums")).alias("sums")).select("block", vector_to_array("sums").alias("sums"))
    out = np.zeros_like(basis)
    for row in summed.toArrow().to_pylist():
        out[row["block"] : row["block"] + BLOCK_WORDS] = np.array(row["sums"]).reshape(-1, wide)
    return out


def save(spark: SparkSession, model: Model, path: str) -> None:
    """Write the model as a table of words and one of values."""
    rows = pa.table({"place": np.arange(len(model.words)), "word": pa.array(model.words, pa.string()), "rarity": model.rarity, "vector": pa.array(list(model.vectors), pa.list_(pa.float64()))})
    spark.createDataFrame(rows).coalesce(1).write.parquet(f"{path}/words")
    spark.createDataFrame(pa.table({"place": np.arange(len(model.values)), "value": model.values})).coalesce(1).write.parquet(f"{path}/values")


def load(spark: SparkSession, path: str) -> Model:
    table = spark.read.parquet(f"{path}/words").orderBy("place").toArrow()
    values = spark.read.parquet(f"{path}/values").orderBy("place").toArrow().column("value").to_numpy()
    vectors = np.array(table.column("vector").to_pylist(), float).reshape(len(table), len(values))
    return Model(table.column("word").to_pylist(), table.column("rarity").to_numpy(), vectors, values)


_encoders: dict[str, Callable] = {}


def hook(spark: SparkSession, model: Model) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """The model in the form `embedding.embed` takes: sent to each machine once, made ready once per worker."""
    shared, name = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def encoder() -> Callable[[list[str]], np.ndarray]:
        from cantera.operators.lsa import _encoders

        if name not in _encoders:
            _encoders.clear()
            _encoders[name] = shared.value.encoder()
        return _encoders[name]

    return encoder

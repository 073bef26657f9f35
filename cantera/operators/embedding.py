"""Text to vectors, and patch vectors to one vector per song."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantera.functions import vectors as V
from cantera.functions.batches import slices

WIDTH = 1024
# Texts turned into a dense block at once: 256 x 1024 doubles are 2 MB. Words whose hashes a task keeps.
BLOCK, KNOWN_WORDS = 256, 1 << 16


def _hashed(width: int):
    """Signed feature hashing of space-separated words, as Arrow batches.

    A block's words are dictionary-encoded, so each distinct word is hashed once. A block is
    given on before the next one is made.
    """

    def words_to_vectors(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, int] = {}
        for batch in texts:
            for some in slices(batch, most_texts=BLOCK):
                yield _block(some, width, known)
                if len(known) > KNOWN_WORDS:
                    known.clear()

    return F.arrow_udf(words_to_vectors, "array<float>")


def _block(texts: pa.Array, width: int, known: dict[str, int]) -> pa.Array:
    words = pc.split_pattern(texts, " ")
    parents = pc.list_parent_indices(words).to_numpy()
    encoded = pc.dictionary_encode(words.flatten())
    hashes = np.array([_word_hash(word, known) for word in encoded.dictionary.to_pylist()], np.int64)
    codes = encoded.indices.to_numpy()
    used = hashes[codes] >= 0 if len(codes) else np.zeros(0, bool)
    values, rows = hashes[codes[used]] if len(codes) else np.zeros(0, np.int64), parents[used]
    signs = np.where((values // width) % 2 == 0, 1.0, -1.0)
    dense = np.bincount(rows * width + values % width, weights=signs, minlength=len(texts) * width)
    offsets = np.arange(0, len(texts) * width + 1, width, dtype=np.int32)
    flat = pa.array(dense.astype(np.float32))
    nulls = pc.is_null(texts)
    return pa.ListArray.from_arrays(pa.array(offsets), flat, mask=nulls)


def _word_hash(word: str, known: dict[str, int]) -> int:
    """The first 32 bits of the MD5 of the word, -1 for an empty one."""
    if word not in known:
        known[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) if word else -1
    return known[word]


def _modelled(model: Callable[[], Callable[[list[str]], np.ndarray]]):
    """`model()` is called once per task and returns the encoder of a list of texts."""

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = model()
        for texts in (some for batch in batches for some in slices(batch)):
            filled = texts.drop_null().to_pylist()
            vectors = np.asarray(encoder(filled) if filled else np.zeros((0, 0)), np.float32)
            nulls = pc.is_null(texts)
            widths = np.where(nulls.to_numpy(zero_copy_only=False), 0, vectors.shape[1])
            offsets = pa.array(np.r_[0, np.cumsum(widths)].astype(np.int32))
            yield pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()), mask=nulls)

    return F.arrow_udf(encode, "array<float>")


def embed(
    df: DataFrame,
    text: str,
    width: int = WIDTH,
    model: Callable[[], Callable[[list[str]], np.ndarray]] | None = None,
    into: str = "vector",
) -> DataFrame:
    """Add the vector of column `text`, which holds cleaned words; null text gives null.

    Without a `model` the vector counts signed word hashes: the entries are whole numbers,
    so cosines of it are exact, and a text without words is a zero vector.
    """
    encode = _modelled(model) if model else _hashed(width)
    # Keeps the optimizer from copying the encoder into filters that it pushes down.
    encode = encode.asNondeterministic()
    return df.withColumn(into, encode(F.col(text)))


def mean_pool(patches: DataFrame, id: str, vector: str, into: str = "vector") -> DataFrame:
    """(id, mean of its vectors, number of vectors), for one row per patch.

    The aggregate keeps one running mean per id, so a song with very many patches is reduced
    before the shuffle.
    """
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    pooled = patches.filter(F.col(vector).isNotNull()).groupBy(id)
    return pooled.agg(mean.alias("mean"), F.count(F.lit(1)).alias("patches")).select(
        id, vector_to_array("mean").alias(into), "patches"
    )


def pool_nested(df: DataFrame, vector: str, into: str = "vector") -> DataFrame:
    """Replace a list of patches by its mean; a flat vector passes through.

    Ragged and empty lists give null, which callers send to the rejected rows.
    """
    nested = df.schema[vector].dataType.elementType.typeName() == "array"
    flat = F.col(vector).cast("array<double>") if not nested else V.mean_of_patches(F.col(vector))
    return df.withColumn(into, flat.cast("array<float>"))


def vector_dims(points: DataFrame, *names: str) -> DataFrame:
    """(vector, width, narrowest, widest, points); width is null when the widths differ."""
    sizes = []
    for name in names:
        size = F.size(name)
        sizes += [F.min(size), F.max(size), F.count(name)]
    totals = points.agg(*[size.alias(f"s{i}") for i, size in enumerate(sizes)])
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("vector"),
                F.when(F.col(f"s{3 * i}") == F.col(f"s{3 * i + 1}"), F.col(f"s{3 * i}")).alias("width"),
                F.col(f"s{3 * i}").alias("narrowest"),
                F.col(f"s{3 * i + 1}").alias("widest"),
                F.col(f"s{3 * i + 2}").alias("points"),
            )
            for i, name in enumerate(names)
        ]
    )
    return totals.select(F.inline(rows))


def normalise_vectors(df: DataFrame, vector: str, into: str = "unit") -> DataFrame:
    """Add the unit-length vector; rows with a null or zero vector are left out."""
    return df.withColumn(into, V.normalise(F.col(vector))).filter(F.col(into).isNotNull())

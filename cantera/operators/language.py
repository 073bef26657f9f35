"""Languages learned from labelled texts: character trigrams that tell them apart, and their stop words.

A language is its counts of hashed trigrams; a text belongs to the language under which its
trigrams are most likely. Counting is one pass with sums before the shuffle, the model a small
table that can be stored as Parquet. Stop words are the words that most texts of a language
have, so every labelled language gets a list of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cantera.functions import text as X

# Hash of a trigram: three code points as digits to `BASE`, modulo a prime.
BASE, BUCKETS = 1_000_003, 65_521
# What a trigram that a language never had counts.
UNSEEN = 0.1
# Languages of one model: a number for each bucket of each, 250 MB. More are refused.
MOST_LANGUAGES = 500
LANGUAGES_AT_ONCE = 32
BYTES_AT_ONCE = 1 << 20


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of all three neighbouring characters of lower-case texts, a space before and after each."""
    padded = pc.binary_join_element_wise(" ", pc.utf8_lower(pc.fill_null(texts, "")), " ", "")
    rows = np.repeat(np.arange(len(padded)), pc.utf8_length(padded).to_numpy())
    points = np.frombuffer(_bytes(padded).decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    bucket = ((points[:-2] * BASE + points[1:-1]) * BASE + points[2:]) % BUCKETS
    within = rows[2:] == rows[:-2]
    return bucket[within], rows[:-2][within]


def _bytes(texts: pa.Array) -> bytes:
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return (texts.buffers()[2] or pa.py_buffer(b""))[int(offsets[0]) : int(offsets[-1])].to_pybytes()


def _slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Parts of about `BYTES_AT_ONCE`, with the place where they begin; a text is never cut."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    first = 0
    while first < len(texts):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + BYTES_AT_ONCE, "right")))
        yield first, texts.slice(first, last - first)
        first = last


def count_trigrams(labelled: DataFrame, text: str, lang: str) -> DataFrame:
    """The model: (`lang`, `bucket`, `n`) over all texts that have a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for one, counts in held.items():
                at = np.flatnonzero(counts)
                columns = [pa.repeat(pa.scalar(one), len(at)), pa.array(at, pa.int32()), pa.array(counts[at])]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "n"])
            held.clear()

        for batch in batches:
            for first, texts in _slices(batch.column("text")):
                langs = batch.column("lang").slice(first, len(texts)).dictionary_encode()
                bucket, row = trigrams(texts)
                of = langs.indices.to_numpy()[row]
                for place, one in enumerate(langs.dictionary.to_pylist()):
                    mine = np.bincount(bucket[of == place], minlength=BUCKETS)
                    held[one] = held[one] + mine if one in held else mine
                    if len(held) > LANGUAGES_AT_ONCE:
                        yield from told()
        yield from told()

    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Languages in order, and the logarithm of each bucket's probability under each (buckets × languages)."""

    languages: list[str]
    weights: np.ndarray


def load(counts: DataFrame) -> Model:
    """The model of counts, fresh or stored; the number of languages is looked at first."""
    if counts.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    table = counts.toArrow()
    languages = sorted(set(table.column("lang").to_pylist()))
    n = np.zeros((BUCKETS, len(languages)))
    n[table.column("bucket").to_numpy(), pc.index_in(table.column("lang"), pa.array(languages, pa.string())).to_numpy()] = table.column("n").to_numpy()
    return Model(languages, np.log((n + UNSEEN) / (n.sum(axis=0) + UNSEEN * BUCKETS)))


def detect(df: DataFrame, text: str, model: Model, into: str = "language") -> DataFrame:
    """Add the most likely language; null for a null or empty text, ties go to the one that sorts first."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def tell(texts: pa.Array) -> pa.Array:
        model = shared.value
        names = pa.array([*model.languages, None], pa.string())
        best = np.full(len(texts), len(model.languages))
        for first, part in _slices(texts):
            bucket, row = trigrams(part)
            total = np.zeros((len(part), len(model.languages)))
            for place in range(len(model.languages)):
                total[:, place] = np.bincount(row, model.weights[bucket, place], minlength=len(part))
            told = np.bincount(row, minlength=len(part)) > 0
            if len(model.languages):
                best[first : first + len(part)][told] = np.argmax(total, axis=1)[told]
        return names.take(pa.array(best))

    return df.withColumn(into, tell(F.col(text)))


def stop_words(labelled: DataFrame, text: str, lang: str, share: float = 0.2, most: int = 100) -> DataFrame:
    """(`lang`, `word`, `texts`, `place`): up to `most` words that at least `share` of a language's texts have.

    The most frequent first, ties in order of the word. A text counts a word once.
    """
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), X.words_of(F.col(text)).alias("words"))
    held = rows.select("lang", F.explode(F.array_distinct("words")).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("texts"))
    every = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("of"))
    common = held.join(F.broadcast(every), "lang").filter(F.col("texts") >= share * F.col("of"))
    best = Window.partitionBy("lang").orderBy(F.desc("texts"), F.asc("word"))
    return common.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= most).select("lang", "word", "texts", "place")


def listed(words: DataFrame) -> dict[str, list[str]]:
    """The lists of `stop_words`, which bounds their length."""
    lists: dict[str, list[str]] = {}
    for row in words.select("lang", "word").collect():
        lists.setdefault(row.lang, []).append(row.word)
    return lists


def without(df: DataFrame, text: str, language: str, lists: dict[str, list[str]], into: str = "words") -> DataFrame:
    """Add the words of a cleaned text that its language's list does not have; one without a list keeps all."""
    shared = df.sparkSession.sparkContext.broadcast(lists)

    @F.arrow_udf("string")
    def remove(texts: pa.Array, languages: pa.Array) -> pa.Array:
        parts = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        row = pc.list_parent_indices(parts).to_numpy()
        words = parts.flatten().dictionary_encode()
        codes = words.indices.to_numpy()
        keep = pc.not_equal(words.dictionary, "").to_numpy(zero_copy_only=False)[codes]
        named = languages.dictionary_encode()
        of = pc.fill_null(named.indices, -1).to_numpy()[row]
        for place, one in enumerate(named.dictionary.to_pylist()):
            stop = pc.is_in(words.dictionary, pa.array(shared.value.get(one, []), words.dictionary.type))
            keep &= ~((of == place) & stop.to_numpy(zero_copy_only=False)[codes])
        offsets = np.r_[0, np.cumsum(np.bincount(row[keep], minlength=len(texts)))].astype(np.int32)
        left = pa.ListArray.from_arrays(pa.array(offsets), words.dictionary.take(pa.array(codes[keep])))
        return pc.if_else(pc.is_null(texts), pa.scalar(None, pa.string()), pc.binary_join(left, " "))

    return df.withColumn(into, remove(F.col(text), F.col(language)))

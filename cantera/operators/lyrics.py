"""Lyric texts to the words that are embedded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantera.functions import stopwords
from cantera.functions import text as X


def clean_lyrics(df: DataFrame, text: str, into: str = "cleaned") -> DataFrame:
    return df.withColumn(into, X.clean(F.col(text)))


def detect_language(
    df: DataFrame, text: str, into: str = "language", detector: Column | None = None
) -> DataFrame:
    """Add the language of a cleaned text.

    The default is the stop-word vote; `detector` takes any other column expression, such as
    a UDF around a language model.
    """
    return df.withColumn(into, stopwords.vote(text) if detector is None else detector)


def drop_stopwords(df: DataFrame, text: str, language: str, into: str = "words") -> DataFrame:
    """Add the words of a cleaned text that are not stop words of its language."""
    return df.withColumn(into, stopwords.remove(text, language))


def prepare_lyrics(df: DataFrame, text: str, into: str = "words") -> DataFrame:
    """Clean, detect, filter in one pass: the text that is embedded, null for a null lyric.

    Trimming lines changes no word, so that step is left out.
    """
    return df.withColumn(into, stopwords.vote_and_remove(F.lower(X.cut_at_marker(F.col(text)))))

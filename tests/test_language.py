"""Learned languages and stop words against counting by hand."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cantera.operators import language
from cantera.plans import text_queries
from cantera.session import new_path


def grams(text):
    padded = f" {text.lower()} "
    return [((ord(a) * language.BASE + ord(b)) * language.BASE + ord(c)) % language.BUCKETS for a, b, c in zip(padded, padded[1:], padded[2:])]


def test_trigrams_of_any_text():
    texts = ["", None, "a", "Ab é🙂", "\x00\n", "日本語 text", "x" * 5000]
    bucket, row = language.trigrams(pa.array(texts))
    for i, text in enumerate(texts):
        assert bucket[row == i].tolist() == grams(text or "")
    assert [a.tolist() for a in language.trigrams(pa.array([], pa.string()))] == [[], []]
    sliced = pa.array(["left out", *texts, "too"]).slice(1, len(texts))
    assert language.trigrams(sliced)[0].tolist() == bucket.tolist()


@pytest.mark.parametrize("at_once", [30, 1 << 20])
def test_likelihood_against_counting(spark, monkeypatch, at_once):
    monkeypatch.setattr(language, "BYTES_AT_ONCE", at_once)
    monkeypatch.setattr(language, "LANGUAGES_AT_ONCE", 2)
    pick = random.Random(2)
    rows = [(i, "".join(pick.choices("abc dé" if i % 3 else "xyz dé", k=pick.randint(0, 30))), f"l{i % 5}") for i in range(60)]
    rows += [(60, None, "l1"), (61, "abc", None), (62, "", "l0")]
    docs = spark.createDataFrame(rows, "id INT, text STRING, lang STRING").repartition(3)
    path = new_path(spark, "model")
    language.count_trigrams(docs, "text", "lang").write.parquet(path)
    model = language.load(spark.read.parquet(path))
    counts = {}
    for _, text, lang in rows:
        if text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(grams(text))
    assert model.languages == sorted(counts)
    told = {r.id: r.language for r in language.detect(docs, "text", model).collect()}
    for i, text, _ in rows:
        likely = {
            lang: sum(math.log((c[g] + 0.1) / (sum(c.values()) + 0.1 * language.BUCKETS)) for g in grams(text or "")) for lang, c in counts.items()
        }
        best = max(sorted(likely), key=lambda lang: round(likely[lang], 9))
        assert told[i] == (best if text else None)


def test_nothing_learned(spark, monkeypatch):
    docs = spark.createDataFrame([("abc", None)], "text STRING, lang STRING")
    model = language.load(language.count_trigrams(docs, "text", "lang"))
    assert language.detect(docs, "text", model).first().language is None
    monkeypatch.setattr(language, "MOST_LANGUAGES", 1)
    two = spark.createDataFrame([("abc", "a"), ("abc", "b")], docs.schema)
    with pytest.raises(ValueError):
        language.load(language.count_trigrams(two, "text", "lang"))


def test_held_out_accuracy_is_above_the_vote(spark):
    told = text_queries.learned_language(spark, "/root/testdata/sf0.01").filter("held_out").toPandas()
    learned, voted = (told.lang == told.learned).mean(), (told.lang == told.voted).mean()
    assert learned >= 0.97 and learned >= voted


def test_every_language_has_stop_words_of_its_own(spark):
    rows = [("de", "der Hund und der Wald"), ("de", "der Mond und, das"), ("de", "der und ein"), ("en", "the dog the"), ("en", "the cat"), ("en", None), (None, "x"), ("fr", "")]
    docs = spark.createDataFrame(rows, "lang STRING, text STRING")
    found = [tuple(r) for r in language.stop_words(docs, "text", "lang", 0.6, 2).orderBy("lang", "place").collect()]
    assert found == [("de", "der", 3, 1), ("de", "und", 3, 2), ("en", "the", 2, 1)]
    lists = language.listed(language.stop_words(docs, "text", "lang", 0.6))
    texts = spark.createDataFrame([("der hund und", "de"), ("der the dog", "en"), ("der the", "xx"), ("a  b", None), (None, "de"), ("und der", "de")], "text STRING, language STRING")
    left = [r.words for r in language.without(texts, "text", "language", lists).collect()]
    assert left == ["hund", "der dog", "der the", "a b", None, ""]
    assert language.without(texts.limit(0), "text", "language", lists).count() == 0

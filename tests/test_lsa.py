"""The learned embedding against numpy's dense decomposition, and what it is good for."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cantera.operators import embedding, knn, lsa
from cantera.session import new_path, shared_folder


def matrix_by_hand(texts, most=10**9, least=2):
    counts = [Counter(w for w in (t or "").split(" ") if w) for t in texts]
    held = Counter(w for c in counts for w in c)
    words = sorted((w for w in held if held[w] >= least), key=lambda w: (-held[w], w))[:most]
    of = sum(t is not None for t in texts)
    rows = np.array([[(1 + math.log(c[w])) * (math.log((1 + of) / (1 + held[w])) + 1) if c[w] else 0.0 for w in words] for c in counts])
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return words, rows / np.where(length > 0, length, 1)


def lyrics(seed, n, vocabulary=80):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    shares = [1 / (i + 1) for i in range(vocabulary)]
    return [" ".join(pick.choices(words, shares, k=pick.randint(0, 40))) for _ in range(n)] + [None, "", "never again"]


@pytest.mark.parametrize("rank,wide", [(200, 60), (10, 60)])
def test_singular_values_equal_the_dense_ones(spark, monkeypatch, rank, wide):
    """All of a small vocabulary in one round, and the first ten by iteration; texts in many parts."""
    shared_folder(spark)
    monkeypatch.setattr(lsa, "TEXTS_AT_ONCE", 7)
    monkeypatch.setattr(lsa, "WORDS_AT_ONCE", 50)
    texts = lyrics(1, 300)
    df = spark.createDataFrame([(t,) for t in texts], "words STRING").repartition(5)
    model = lsa.fit(df, "words", rank=rank, most=wide, rounds=200, tolerance=1e-9)
    words, dense = matrix_by_hand(texts, wide)
    assert model.words == words
    values = np.linalg.svd(dense, compute_uv=False)[:rank]
    assert np.allclose(model.values, values[: len(model.values)], atol=1e-6) and len(model.values) == min(rank, wide)
    # The vectors are orthonormal, and a text's is its row times them.
    assert np.allclose(model.vectors.T @ model.vectors, np.eye(len(model.values)), atol=1e-8)
    encoded = model.encoder()(["" if t is None else t for t in texts])
    assert np.allclose(encoded, dense @ model.vectors, atol=1e-5)


def test_stored_model_is_the_hook_of_embed(spark):
    shared_folder(spark)
    texts = lyrics(2, 60)
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, words STRING")
    model = lsa.fit(df, "words", rank=8)
    path = new_path(spark, "model")
    lsa.save(spark, model, path)
    again = lsa.load(spark, path)
    assert again.words == model.words and np.array_equal(again.vectors, model.vectors) and np.array_equal(again.values, model.values)
    rows = {r.id: r.vector for r in embedding.embed(df, "words", model=lsa.hook(spark, again)).collect()}
    want = model.encoder()([t or "" for t in texts])
    assert rows[60] is None and all(np.allclose(rows[i], want[i]) for i in range(60)) and not any(rows[62])


def test_nothing_to_learn(spark):
    shared_folder(spark)
    df = spark.createDataFrame([("a",), (None,)], "words STRING")
    model = lsa.fit(df, "words")
    assert model.words == [] and model.encoder()(["a", ""]).shape == (2, 0)


def test_weights_in_columns_equal_those_of_batches(spark):
    texts = lyrics(3, 50)
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, words STRING")
    words, dense = matrix_by_hand(texts, 40)
    got = np.zeros_like(dense)
    for r in lsa.tfidf(df, "id", "words", 40).collect():
        got[r.id, words.index(r.word)] = r.weight
    assert np.allclose(got, dense)


def test_torn_copies_are_found_better_than_by_hashed_words(spark):
    """Each query is thirty of a long lyric's words, most of them common ones of its language."""
    shared_folder(spark)
    pick = random.Random(5)
    common, rare = [f"c{i}" for i in range(60)], [f"r{i}" for i in range(3000)]
    texts = []
    for _ in range(300):
        theme = pick.sample(rare, 40)
        texts.append([w for _ in range(300) for w in [pick.choice(common) if pick.random() < 0.8 else pick.choice(theme)]])
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id LONG, words STRING")
    torn = spark.createDataFrame([(i, " ".join(pick.sample(t, 30))) for i, t in enumerate(texts)], "qid LONG, words STRING")
    model = lsa.hook(spark, lsa.fit(df, "words", rank=128, rounds=4))

    def found(**options):
        hits = knn.knn(embedding.embed(torn, "words", **options), embedding.embed(df, "words", into="v", **options), "v", 1)
        return hits.filter(F.col("qid") == F.col("id")).count() / len(texts)

    learned, hashed = found(model=model), found()
    assert learned > hashed + 0.1 and learned > 0.8

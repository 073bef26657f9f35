import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cantera.operators import ann, embedding, knn, pq
from cantera.plans import search, vector_queries
from cantera.session import new_path
from conftest import SMALL


def brute_knn(queries, points, k, passes=lambda q, p: True):
    """{qid: [(id, score)]} by comparing every pair; vectors are (key, vector, ...) tuples."""
    result = {}
    for q in queries:
        scored = []
        for p in points:
            nq, np_ = math.sqrt(sum(x * x for x in q[1])), math.sqrt(sum(x * x for x in p[1]))
            if nq and np_ and passes(q, p):
                scored.append((-sum(a * b for a, b in zip(q[1], p[1])) / (nq * np_), p[0]))
        if scored:
            result[q[0]] = [(i, round(-s, 9)) for s, i in sorted(scored)[:k]]
    return result


def found(hits):
    result = {}
    for r in hits.orderBy("qid", "position").collect():
        result.setdefault(r.qid, []).append((r.id, round(r.score, 9)))
    return result


def whole_number_vectors(seed, n, width=6):
    """Small whole numbers: many ties, exact scores, some zero vectors; a third are copies of one."""
    pick = random.Random(seed)
    hot = [float(pick.randint(-2, 2)) for _ in range(width)]
    return [
        (i, hot if pick.random() < 0.34 else [float(pick.randint(-2, 2)) if pick.random() < 0.8 else 0.0 for _ in range(width)])
        for i in range(n)
    ]


def frames(spark, queries, points):
    q = spark.createDataFrame([t[:2] for t in queries], "qid BIGINT, vector ARRAY<FLOAT>")
    p = spark.createDataFrame([t[:2] for t in points], "id BIGINT, v ARRAY<FLOAT>").repartition(5)
    return q, p


@pytest.mark.parametrize("max_queries", [4096, 3])
@pytest.mark.parametrize("seed", range(3))
def test_knn_equals_brute_force(spark, seed, max_queries):
    points = whole_number_vectors(seed, 300) + [(1000, [0.0] * 6)]
    queries = whole_number_vectors(seed + 50, 12) + [(77, [0.0] * 6)]
    q, p = frames(spark, queries, points)
    assert found(knn.knn(q, p, "v", 7, max_queries=max_queries)) == brute_knn(queries, points, 7)


def test_knn_in_small_chunks(spark, monkeypatch):
    """Ties reach across chunks; copies beyond the k smallest ids are left out of the product."""
    monkeypatch.setattr(knn, "CHUNK", 64)
    points = whole_number_vectors(5, 500)
    random.Random(1).shuffle(points)
    queries = whole_number_vectors(6, 9)
    table = knn.pa.table({"qid": [q[0] for q in queries], "vector": [q[1] for q in queries]})
    best = knn.Best(knn.Queries.of(table, "qid", "vector", ()), 5)
    best.see(np.array([p[0] for p in points]), np.array([p[1] for p in points]), [])
    keys, ids, scores = (column.to_pylist() for column in best.rows())
    got = {}
    for key, id, score in zip(keys, ids, scores):
        got.setdefault(key, []).append((id, round(score, 9)))
    assert got == brute_knn(queries, points, 5)


def test_real_vectors_with_copies(spark):
    """Copies of real-valued vectors score equally, so ids decide between them."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 33)).astype(np.float32)
    points = [(i, [float(x) for x in base[i % 40]]) for i in range(400)]
    queries = [(i, [float(x) for x in base[i]]) for i in range(10)]
    q, p = frames(spark, queries, points)
    hits = knn.knn(q, p, "v", 12).collect()
    for i in range(10):
        own = sorted((r.position, r.id) for r in hits if r.qid == i)
        assert [id for _, id in own[:10]] == [i + 40 * c for c in range(10)]


def test_filters(spark):
    pick = random.Random(9)
    points = [(i, v, pick.choice(["rock", "pop", None]), pick.choice([90.0, 120.0, None])) for i, v in whole_number_vectors(1, 200)]
    queries = [(i, v, pick.choice(["rock", "jazz", None]), pick.choice([120.0, None])) for i, v in whole_number_vectors(2, 12)]
    q = spark.createDataFrame(queries, "qid BIGINT, vector ARRAY<FLOAT>, genre STRING, bpm DOUBLE")
    p = spark.createDataFrame(points, "id BIGINT, v ARRAY<FLOAT>, genre STRING, bpm DOUBLE").repartition(3)

    def passes(query, point):
        return all(query[i] is None or query[i] == point[i] for i in (2, 3))

    want = brute_knn(queries, points, 6, passes)
    for bound in (4096, 4):
        assert found(knn.knn(q, p, "v", 6, ("genre", "bpm"), max_queries=bound)) == want


def test_constraint_of_all_queries_reaches_the_scan(spark, tmp_path):
    points = spark.createDataFrame([(i, [1.0, float(i)], g) for i, g in enumerate(["rock", "pop"] * 5)], "id BIGINT, v ARRAY<FLOAT>, genre STRING")
    points.write.parquet(str(tmp_path / "p"))
    q = spark.createDataFrame([(1, [1.0, 1.0], "rock")], "qid BIGINT, vector ARRAY<FLOAT>, genre STRING")
    hits = knn.knn(q, spark.read.parquet(str(tmp_path / "p")), "v", 3, ("genre",))
    plan = hits._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(genre), EqualTo(genre,rock)]" in plan or "In(genre, [rock])" in plan
    assert hits.count() == 3


def test_widths_must_agree(spark):
    q, p = frames(spark, [(1, [1.0, 2.0])], [(1, [1.0, 2.0, 3.0])])
    with pytest.raises(Exception, match="differ in width"):
        knn.knn(q, p, "v", 3).collect()


def test_no_queries_or_points(spark):
    q, p = frames(spark, [(1, [1.0])], [(1, [1.0])])
    assert knn.knn(q.filter("qid = 5"), p, "v", 3).count() == 0
    assert knn.knn(q, p.filter("id = 5"), "v", 3).count() == 0


def test_hashed_embedding(spark):
    df = spark.createDataFrame([(1, "la la love"), (2, ""), (3, None), (4, "la")], "id INT, words STRING")
    vectors = {r.id: r.vector for r in embedding.embed(df, "words", 64).collect()}
    assert vectors[3] is None and not any(vectors[2]) and len(vectors[2]) == 64
    import hashlib

    want = [0.0] * 64
    for word in ("la", "la", "love"):
        h = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
        want[h % 64] += 1 if h // 64 % 2 == 0 else -1
    assert vectors[1] == want


def test_model_is_made_once_per_task(spark, tmp_path):
    marks = str(tmp_path)

    def model():
        import os
        import uuid

        open(os.path.join(marks, uuid.uuid4().hex), "w").close()
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    df = spark.range(500).select("id", F.when(F.col("id") != 7, F.concat(F.lit("t"), F.col("id"))).alias("t")).coalesce(2)
    got = {r.id: r.vector for r in embedding.embed(df, "t", model=model).collect()}
    assert got[7] is None and got[10] == [3.0, 1.0] and len(got) == 500
    assert len(list(tmp_path.iterdir())) <= 2


def test_mean_pool_and_dims(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 5.0]), (2, None)], "id INT, v ARRAY<FLOAT>")
    pooled = {r.id: (r.vector, r.patches) for r in embedding.mean_pool(df, "id", "v").collect()}
    assert pooled == {1: ([2.0, 3.0], 2), 2: ([5.0, 5.0], 1)}
    assert tuple(embedding.vector_dims(df, "v").first()) == ("v", 2, 2, 2, 3)
    ragged = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v ARRAY<FLOAT>")
    assert embedding.vector_dims(ragged, "v").first()["width"] is None


def test_unit_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "id INT, v ARRAY<FLOAT>")
    assert [tuple(r) for r in embedding.normalise_vectors(df, "v").select("id", "unit").collect()] == [(1, [0.6, 0.8])]


def test_cells_find_most_and_all_cells_find_everything(spark):
    songs = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    queries = songs.filter("id < 40").select(F.col("id").alias("qid"), F.col("embedding").alias("vector"))
    centres = ann.fit_cells(songs, "embedding", 8)
    celled = ann.assign_cells(songs, "embedding", centres)
    exact = knn.knn(queries, songs, "embedding", 15)
    some = ann.recall(ann.ann_knn(queries, celled, "embedding", 15, centres, 3), exact).first()[0]
    every = ann.recall(ann.ann_knn(queries, celled, "embedding", 15, centres, 8), exact).first()[0]
    assert 0.4 < some < 1.0 and every == 1.0


# --- the whole search against a model that answers one request at a time ------------------


def model_search(request, points, embed, top_k=5):
    scores = {}
    passes = [
        p
        for p in points
        if (not request["genre"] or p["genre"] == request["genre"])
        and (not request["key"] or p["key"] == request["key"])
        and (not request["bpm"] or p["bpm"] == request["bpm"])
    ]

    def top(vector, name):
        one = brute_knn([(0, vector)], [(p["id"], p[name]) for p in passes], top_k * 3)
        return one.get(0, [])

    for id, score in top(embed(request["query"]), "lyrics_vector"):
        scores.setdefault(id, []).append(score)
    named = [p for p in points if p["artist"] == request["artist_ref"] and p["title"] == request["title_ref"]]
    if request["artist_ref"] and request["title_ref"] and named:
        ref = min(named, key=lambda p: p["id"])
        for id, score in top(ref["track_vector"], "track_vector"):
            if id != ref["id"]:
                scores.setdefault(id, []).append(score)
    ranked = sorted(((-sum(s) * 0.5, id) for id, s in scores.items()))[:top_k]
    return [(rank, id, round(-score, 4)) for rank, (score, id) in enumerate(ranked, 1)]


POINT = (
    "id BIGINT, track_vector ARRAY<FLOAT>, lyrics_vector ARRAY<FLOAT>, artist STRING, title STRING, lyric STRING, "
    "album STRING, mbid STRING, link STRING, bpm DOUBLE, key STRING, genre STRING"
)
REQUEST = "qid BIGINT, query STRING, genre STRING, key STRING, bpm INT, artist_ref STRING, title_ref STRING"


def length_model():
    return lambda texts: np.array([[len(t) % 5 - 2, len(t) % 3, 1.0, t.count("a")] for t in texts], float)


@pytest.fixture(scope="module")
def case():
    pick = random.Random(11)
    points = []
    for i, (_, track) in enumerate(whole_number_vectors(21, 120, 4)):
        lyric = [float(pick.randint(-2, 2)) for _ in range(4)]
        points.append(
            dict(id=i, track_vector=track, lyrics_vector=lyric, artist=f"a{i % 7}", title=f"t{i % 11}", lyric=f"l{i}", album=None,
                 mbid=None, link="u", bpm=pick.choice([90.0, 120.0, None]), key=pick.choice(["C", "D"]), genre=pick.choice(["rock", "pop"]))
        )
    requests = [
        dict(qid=n, query="a" * n + "bcd", genre=pick.choice(["", None, "rock", "none"]), key=pick.choice([None, "C"]),
             bpm=pick.choice([0, None, 120]), artist_ref=pick.choice(["a1", "a2", "?", None, ""]), title_ref=pick.choice(["t1", "t2", ""]))
        for n in range(40)
    ]
    return points, requests + [dict(requests[0], qid=98, query=""), dict(requests[0], qid=99, query=None)]


@pytest.mark.parametrize("bound", [4096, 8])
def test_fused_search_equals_the_model(spark, case, bound):
    points, requests = case
    names = [column.split()[0] for column in POINT.split(", ")]
    p = spark.createDataFrame([tuple(point[n] for n in names) for point in points], POINT).repartition(4)
    names = [column.split()[0] for column in REQUEST.split(", ")]
    r = spark.createDataFrame([tuple(request[n] for n in names) for request in requests], REQUEST)
    results = search.fused_search(r, p, model=length_model, max_requests=bound)
    got = {}
    for row in results.orderBy("qid", "rank").collect():
        got.setdefault(row.qid, []).append((row.rank, row.id, row.score))
    embed = lambda text: [float(x) for x in length_model()([text])[0]]
    want = {q["qid"]: model_search(q, points, embed) for q in requests if q["query"]}
    assert got == {qid: hits for qid, hits in want.items() if hits}
    assert set(search.RESULT) <= set(results.columns) and max(s for h in got.values() for _, _, s in h) <= 1.0


def test_phrase_alone_scores_half(spark, case):
    points, _ = case
    names = [column.split()[0] for column in POINT.split(", ")]
    p = spark.createDataFrame([tuple(point[n] for n in names) for point in points], POINT)
    r = spark.createDataFrame([(1, "abc", None, None, None, "nobody", "nothing")], REQUEST)
    hits = search.fused_search(r, p, model=length_model).collect()
    assert len(hits) == 5 and all(h.score <= 0.5 and h.lists == 1 for h in hits)
    shown = search.displayed(search.fused_search(r, p, model=length_model)).first()
    assert shown.album == "N/A" and shown.link == "u"


def test_result_songs_are_fetched_by_id(spark, case, tmp_path):
    """On a stored table the ids of the ranked songs reach the scan of the payload."""
    points, requests = case
    names = [column.split()[0] for column in POINT.split(", ")]
    df = spark.createDataFrame([tuple(point[n] for n in names) for point in points], POINT)
    df.sortWithinPartitions("id").write.parquet(str(tmp_path / "points"))
    stored = spark.read.parquet(str(tmp_path / "points"))
    names = [column.split()[0] for column in REQUEST.split(", ")]
    r = spark.createDataFrame([tuple(request[n] for n in names) for request in requests[:3]], REQUEST)
    found = search.fused_search(r, stored, model=length_model)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(id," in plan or "In(id, [" in plan
    assert found.count() > 0


def test_a_name_that_a_third_of_the_songs_bear(spark):
    points = spark.range(3000).select(
        "id",
        F.when(F.col("id") % 3 == 0, "Unknown").otherwise(F.concat(F.lit("a"), F.col("id"))).alias("artist"),
        F.when(F.col("id") % 3 == 0, "Track 1").otherwise(F.lit("t")).alias("title"),
    )
    requests = spark.createDataFrame(
        [(1, "Unknown", "Track 1"), (2, "a7", "t"), (3, "a7", "T"), (4, None, "t"), (5, "Unknown", "Track 1")],
        "qid BIGINT, artist_ref STRING, title_ref STRING",
    )
    for small in (True, False):
        got = sorted(map(tuple, search.reference_songs(requests, points, small).collect()))
        assert got == [(1, 0), (2, 7), (5, 0)]


def test_the_registered_cells_find_nine_tenths(spark):
    exact = {(r.qid, r.id) for r in vector_queries.ann_all_cells(spark, SMALL).collect()}
    found = {(r.qid, r.id) for r in vector_queries.ann_knn(spark, SMALL).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


@pytest.mark.parametrize("filters", [(), ("genre",)])
def test_tiles_equal_brute_force(spark, filters, monkeypatch):
    """Cells, parts and shares of every size; a third of the points are copies of one vector."""
    monkeypatch.setattr(knn, "SAMPLE", 40)
    monkeypatch.setattr(knn, "TILE_BYTES", 1)
    monkeypatch.setattr(knn, "CELLS", 5)
    pick = random.Random(3)
    genres = ["a", "b", None]
    points = [(i, v, pick.choice(genres)) for i, v in whole_number_vectors(9, 900, 4)]
    queries = [(f"q{i}", v, pick.choice(genres)) for i, v in whole_number_vectors(10, 30, 4)]
    q = spark.createDataFrame(queries, "qid STRING, vector ARRAY<FLOAT>, genre STRING").repartition(3)
    p = spark.createDataFrame(points, "id BIGINT, v ARRAY<FLOAT>, genre STRING").repartition(4)
    passes = (lambda a, b: a[2] is None or a[2] == b[2]) if filters else (lambda a, b: True)
    assert found(knn.knn(q, p, "v", 6, filters, max_queries=4)) == brute_knn(queries, points, 6, passes)


def test_tiles_of_little(spark):
    q, p = frames(spark, [(i, [1.0, float(i)]) for i in range(9)], [(1, [1.0, 2.0]), (2, [0.0, 0.0])])
    assert {k: len(v) for k, v in found(knn.knn(q, p, "v", 3, max_queries=2)).items()} == dict.fromkeys(range(9), 1)
    assert knn.knn(q, p.limit(0), "v", 3, max_queries=2).count() == 0
    assert knn.knn(q, p.filter("id = 2"), "v", 3, max_queries=2).count() == 0


def test_tiles_of_clusters_far_apart(spark):
    """Most cells are beyond the bound of most queries; with one far vector no cell is."""
    pick = np.random.default_rng(1)
    single = lambda rows: rows.astype(np.float32).astype(float).tolist()
    middles = np.eye(8)[pick.integers(0, 8, 2100)] * 10
    points = list(enumerate(single(middles + pick.normal(0, 0.1, middles.shape))))
    queries = list(enumerate(single(np.eye(8)[[0] * 20] * 10 + pick.normal(0, 0.1, (20, 8))))) + [(99, [-1.0] * 8)]
    q, p = frames(spark, queries, points)
    assert found(knn.knn(q, p, "v", 5, max_queries=7)) == brute_knn(queries, points, 5)


def quantised(spark, points, **options):
    book = pq.fit(points, "v", **options)
    return pq.build(points, "v", book, new_path(spark, "codes"))


def test_all_codes_and_a_long_list_are_exact(spark):
    points = whole_number_vectors(4, 700) + [(9000, [0.0] * 6)]
    queries = whole_number_vectors(5, 20) + [(77, [0.0] * 6)]
    q, p = frames(spark, queries, points)
    index = quantised(spark, p.unionByName(spark.createDataFrame([(9001, None)], p.schema)), parts=4)
    assert index.sizes.sum() == sum(any(v) for _, v in points)
    assert found(pq.search(q, index, 7, len(index.sizes), 2000)) == brute_knn(queries, points, 7)
    figures = pq.reading(q, index, knn.knn(q, p, "v", 7), 7, len(index.sizes), 2000).collect()
    assert all(r.found == r.wanted == 7 and r.codes == r.vectors == r.points == index.sizes.sum() for r in figures)


def test_codes_are_the_nearest_words(spark):
    pick = np.random.default_rng(8)
    rows = pick.normal(size=(300, 10))
    p = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(rows)], "id BIGINT, v ARRAY<DOUBLE>")
    index = quantised(spark, p, parts=4, cells=9)
    book, unit = index.book, rows / np.linalg.norm(rows, axis=1, keepdims=True)
    for r in index.codes.collect():
        residual = unit[r.id] - book.centres[r.cell]
        assert r.cell == (unit[r.id] @ book.centres.T).argmax()
        for j, code in enumerate(r.codes):
            part = np.pad(residual, (0, 2))[3 * j : 3 * j + 3]
            away = ((book.words[j] - part) ** 2).sum(axis=1)
            assert away[code] <= away.min() + 1e-9


def test_a_cell_with_most_points_is_met_in_parts(spark, monkeypatch):
    monkeypatch.setattr(pq, "POINTS_AT_ONCE", 50)
    monkeypatch.setattr(pq, "QUERIES_AT_ONCE", 3)
    points, queries = whole_number_vectors(6, 600), whole_number_vectors(7, 15)
    q, p = frames(spark, queries, points)
    index = quantised(spark, p, parts=3, cells=2)
    assert found(pq.search(q, index, 5, 2, 700)) == brute_knn(queries, points, 5)


def test_learned_codes_find_nine_tenths_from_a_twentieth_of_the_vectors(spark):
    folder = "/root/testdata/sf0.1"
    songs = vector_queries.vectors(spark, folder)
    asked = vector_queries.sounds(spark, folder)
    index = pq.build(songs, "track_vector", pq.fit(songs, "track_vector"), new_path(spark, "codes"))
    probes = round(0.7 * len(index.sizes))
    rows = pq.reading(asked, index, knn.knn(asked, songs, "track_vector", 15), 15, probes, 60).toPandas()
    assert rows.found.sum() >= 0.9 * rows.wanted.sum()
    assert (rows.vectors <= 0.05 * rows.points).all() and rows.codes.sum() <= 0.75 * rows.points.sum()
    # Sixteen bytes for each point instead of 64 numbers.
    assert index.codes.selectExpr("max(length(codes))").first()[0] == 16


def test_registered_codes_find_nine_tenths(spark):
    rows = vector_queries.ann_recall(spark, "/root/testdata/sf0.1").toPandas()
    assert rows.found.sum() >= 0.9 * rows.wanted.sum() and (rows.vectors <= 0.25 * rows.points).all()


def test_an_index_of_nothing(spark):
    q, p = frames(spark, [(1, [1.0, 2.0])], [(1, [1.0, 2.0])])
    assert pq.fit(p.limit(0), "v") is None
    index = quantised(spark, p, parts=2)
    assert found(pq.search(q, index, 3, 1, 5)) == {1: [(1, 1.0)]} and pq.search(q.limit(0), index, 3, 1, 5).count() == 0


def test_centres_order_little_more_than_their_sample(spark):
    from cantera.operators import ann

    points = spark.range(5000).selectExpr("id", "array(cast(id AS float), 1f, cast(id % 7 AS float)) AS v")
    kept = ann.smallest_hashes(points, "v", 100, 7)
    hashed = sorted(r.h for r in points.selectExpr("xxhash64(7, v) AS h").collect())
    assert [r.hash for r in kept.orderBy("hash").limit(100).collect()] == hashed[:100] and kept.count() < 200

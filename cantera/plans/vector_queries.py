"""Registered queries: embedding, neighbours, search and the point table."""

from __future__ import annotations

from pyspark.sql import functions as F

from cantera.functions import vectors as V
from cantera.operators import ann, embedding, knn, lsa, pq
from cantera.operators import lyrics as L
from cantera.operators import relational as R
from cantera.plans import search
from cantera.plans import standins as S
from cantera.plans.catalogue import vectorise
from cantera.plans.registry import query
from cantera.session import new_path
from cantera.sources import points as P
from cantera.sources import sinks
from cantera.tables import read, spread

LYRIC_WORDS_SQL = f"SELECT id, string_split(words, ' ') AS words FROM ({S.prepared_sql('documents', 'doc_id', 'text')}) WHERE words <> ''"
COSINE_SQL = """list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"""
PHRASE_WORDS_SQL = f"SELECT item_id AS id, {S.tokens_sql(S.clean_sql('text'))} AS words FROM benchmark"


def vectors(spark, folder):
    return read(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("track_vector"))


def embedded(spark, folder):
    """(id, lyrics_vector) of every document, from its whole text."""
    documents = spread(read(spark, folder, "documents", "doc_id", "text"))
    words = L.prepare_lyrics(documents, "text").select(F.col("doc_id").alias("id"), "words")
    return embedding.embed(words, "words", into="lyrics_vector").drop("words")


def phrases(spark, folder):
    items = read(spark, folder, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return search.phrase_vectors(items)


@query("embed_text", S.hashed_sql(f"({LYRIC_WORDS_SQL})", "words"))
def embed_text(spark, folder):
    entries = embedded(spark, folder).select("id", F.posexplode("lyrics_vector").alias("bucket", "weight"))
    return entries.filter("weight <> 0").select("id", F.col("bucket").cast("long"), F.col("weight").cast("long"))


def prepared(spark, folder):
    """(id, words) of every document, stored: what learns from them reads them several times."""
    lyrics = L.prepare_lyrics(spread(read(spark, folder, "documents", "doc_id", "text")), "text").select(F.col("doc_id").alias("id"), "words")
    path = new_path(spark, "words")
    lyrics.write.parquet(path)
    return spark.read.schema(lyrics.schema).parquet(path)


@query(
    "tfidf_weights",
    f"""
WITH t AS MATERIALIZED ({S.prepared_sql('documents', 'doc_id', 'text')}),
w AS MATERIALIZED (SELECT id, word, count(*) AS times FROM (SELECT id, unnest(string_split(words, ' ')) AS word FROM t) WHERE word <> '' GROUP BY ALL),
v AS MATERIALIZED (
  SELECT word, ln((1 + (SELECT count(words) FROM t)) / (1 + count(*))) + 1 AS rarity FROM w GROUP BY word HAVING count(*) >= 2
  ORDER BY count(*) DESC, word LIMIT 4096),
x AS (SELECT id, word, (1 + ln(times)) * rarity AS weight FROM w JOIN v USING (word))
SELECT id, word, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY id)), 6) AS weight FROM x
""",
)
def tfidf_weights(spark, folder):
    """The weighted words that the learned embedding starts from."""
    return lsa.tfidf(prepared(spark, folder), "id", "words", 4096).withColumn("weight", F.round("weight", 6))


@query("learned_embedding")
def learned_embedding(spark, folder):
    """Every lyric by the embedding that all of them taught, stored and loaded as a model."""
    lyrics = prepared(spark, folder)
    path = new_path(spark, "embedding")
    lsa.save(spark, lsa.fit(lyrics, "words", rank=32, most=4096, rounds=4), path)
    model = lsa.hook(spark, lsa.load(spark, path))
    return embedding.embed(lyrics, "words", model=model).drop("words")


@query(
    "normalise_vectors",
    """
SELECT id, pos, round(x / n, 6) AS x FROM (
  SELECT vec_id AS id, unnest(range(len(embedding))) AS pos, unnest(embedding::DOUBLE[]) AS x,
         sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)
WHERE n > 0
""",
)
def normalise_vectors(spark, folder):
    unit = embedding.normalise_vectors(vectors(spark, folder), "track_vector")
    entries = unit.select("id", F.posexplode("unit").alias("pos", "x"))
    return entries.select("id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(
    "mean_pool",
    """
SELECT label::BIGINT AS id, pos, round(avg(x), 6) AS x FROM (
  SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding::DOUBLE[]) AS x FROM embeddings)
GROUP BY label, pos
""",
)
def mean_pool(spark, folder):
    pooled = embedding.mean_pool(vectors(spark, folder), "label", "track_vector")
    entries = pooled.select(F.col("label").cast("long").alias("id"), F.posexplode("vector").alias("pos", "x"))
    return entries.select("id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(
    "cosine_to_mean",
    f"""
WITH m AS (SELECT label, list(x ORDER BY pos) AS mean FROM (
  SELECT label, pos, avg(x) AS x FROM (
    SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding::DOUBLE[]) AS x FROM embeddings)
  GROUP BY label, pos) GROUP BY label)
SELECT vec_id AS id, round({COSINE_SQL.format(a='embedding::DOUBLE[]', b='mean')}, 6) AS score FROM embeddings JOIN m USING (label)
""",
)
def cosine_to_mean(spark, folder):
    """How close each vector is to the mean of its label."""
    songs = vectors(spark, folder)
    means = embedding.mean_pool(songs, "label", "track_vector", "mean").drop("patches")
    score = V.cosine(F.col("track_vector"), F.col("mean"))
    return songs.join(R.reshuffled(means, ["label"]), "label").select("id", F.round(score, 6).alias("score"))


@query(
    "pool_nested",
    """
SELECT vec_id AS id, pos, round(((x + y) / 2)::FLOAT::DOUBLE, 6) AS x FROM (
  SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding::DOUBLE[]) AS x,
         unnest(list_reverse(embedding)::DOUBLE[]) AS y FROM embeddings)
""",
)
def pool_nested(spark, folder):
    """Two patches per song, the second one reversed."""
    songs = vectors(spark, folder).select("id", F.array("track_vector", F.reverse("track_vector")).alias("patches"))
    entries = embedding.pool_nested(songs, "patches").select("id", F.posexplode("vector").alias("pos", "x"))
    return entries.select("id", F.col("pos").cast("long").alias("pos"), F.round(F.col("x").cast("double"), 6).alias("x"))


@query(
    "vectors_roundtrip",
    """
SELECT vec_id AS id, len(embedding)::BIGINT AS width, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings
""",
)
def vectors_roundtrip(spark, folder):
    path = new_path(spark, "vectors")
    sinks.write_vectors(vectors(spark, folder).select("id", "track_vector"), path)
    total = F.aggregate("track_vector", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return spark.read.parquet(path).select("id", F.size("track_vector").cast("long").alias("width"), F.round(total, 6).alias("total"))


@query(
    "vector_dims",
    f"""
SELECT 'track_vector' AS vector, CASE WHEN min(len(embedding)) = max(len(embedding)) THEN min(len(embedding)) END AS width,
       min(len(embedding)) AS narrowest, max(len(embedding)) AS widest, count(embedding) AS points FROM embeddings
UNION ALL SELECT 'lyrics_vector', min(width), min(width), max(width), count(*) FROM documents, (
  SELECT CASE WHEN max(bucket) < 1024 THEN 1024 END AS width FROM ({S.hashed_sql(f'({LYRIC_WORDS_SQL})', 'words')}))
""",
)
def vector_dims(spark, folder):
    tracks = embedding.vector_dims(vectors(spark, folder), "track_vector")
    dims = tracks.unionByName(embedding.vector_dims(embedded(spark, folder), "lyrics_vector"))
    return dims.withColumns({c: F.col(c).cast("long") for c in ("width", "narrowest", "widest")})


@query(
    "points_upsert",
    f"""
WITH s AS ({S.CATALOGUE_SQL})
SELECT id, artista AS artist, cancion AS title, bpm, initialkey AS key, 'new' AS state,
       round(-list_sum(track_vector::DOUBLE[]), 6) AS track_sum, len(string_split(letra, ' '))::DOUBLE AS lyrics_sum
FROM s WHERE track_vector IS NOT NULL AND bpm IS NOT NULL
UNION ALL
SELECT vec_id, NULL, NULL, NULL, NULL, 'old', round(list_sum(embedding::DOUBLE[]), 6), 0 FROM embeddings
WHERE vec_id NOT IN (SELECT id FROM s WHERE track_vector IS NOT NULL AND bpm IS NOT NULL)
""",
)
def points_upsert(spark, folder):
    """Bare vectors are stored; songs with a known tempo come in with their payload."""
    songs = S.catalogue(spark, folder).filter("track_vector IS NOT NULL AND bpm IS NOT NULL")
    # A new track vector is the negated one, a lyric vector a one for each word.
    fresh = songs.select(
        "id",
        F.transform("track_vector", lambda x: -x).alias("track_vector"),
        F.transform(F.split("letra", " "), lambda w: F.lit(1.0).cast("float")).alias("lyrics_vector"),
        P.payload().alias("payload"),
        F.lit("new").alias("state"),
    )
    older = fresh.withColumns({"lyrics_vector": F.array(F.lit(7.0).cast("float")), "state": F.lit("older")})
    stored = vectors(spark, folder).select(
        "id",
        "track_vector",
        F.array(F.lit(0.0).cast("float")).alias("lyrics_vector"),
        F.lit(None).cast(fresh.schema["payload"].dataType).alias("payload"),
        F.lit("old").alias("state"),
    )
    merged = R.upsert(stored, fresh.unionByName(older), "id", [F.asc("state")])
    total = lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double")), 6)
    return merged.select(
        "id",
        "payload.artist",
        "payload.title",
        "payload.bpm",
        "payload.key",
        "state",
        total("track_vector").alias("track_sum"),
        total("lyrics_vector").alias("lyrics_sum"),
    )


@query(
    "publish_queue",
    f"SELECT id, genre FROM ({S.CATALOGUE_SQL}) WHERE track_vector IS NOT NULL AND letra IS NOT NULL AND id NOT IN (SELECT doc_id FROM labels)",
)
def publish_queue(spark, folder):
    published = read(spark, folder, "labels", F.col("doc_id").alias("id"))
    return R.publish_queue(S.catalogue(spark, folder), published, "id", ["track_vector", "letra"]).select("id", "genre")


# --- neighbours -------------------------------------------------------------------------

# Cosine of every phrase with every lyric: exact whole numbers until the final division.
LYRIC_SCORES_SQL = f"""
dw AS MATERIALIZED ({S.hashed_sql(f'({LYRIC_WORDS_SQL})', 'words')}),
qw AS MATERIALIZED ({S.hashed_sql(f'({PHRASE_WORDS_SQL})', 'words')}),
dn AS MATERIALIZED (SELECT id, sum(weight * weight)::DOUBLE AS n FROM dw GROUP BY id),
qn AS MATERIALIZED (SELECT id, sum(weight * weight)::DOUBLE AS n FROM qw GROUP BY id),
dots AS MATERIALIZED (SELECT qw.id AS qid, dw.id AS id, sum(qw.weight * dw.weight)::DOUBLE AS dot FROM qw JOIN dw USING (bucket) GROUP BY ALL),
lyric_scores AS MATERIALIZED (
  SELECT qn.id AS qid, dn.id AS id, coalesce(dots.dot, 0) / (sqrt(qn.n) * sqrt(dn.n)) AS score
  FROM qn CROSS JOIN dn LEFT JOIN dots ON dots.qid = qn.id AND dots.id = dn.id)"""



def rounded(hits):
    return hits.select("qid", "id", F.round("score", 4).alias("score"), F.col("position").cast("long").alias("position"))


@query(
    "lyrics_knn",
    f"""
WITH {LYRIC_SCORES_SQL}
SELECT qid, id, round(score, 4) AS score, position FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS position FROM lyric_scores)
WHERE position <= 15
""",
)
def lyrics_knn(spark, folder):
    return rounded(knn.knn(phrases(spark, folder), embedded(spark, folder), "lyrics_vector", 15))


def sounds(spark, folder):
    """The track vector of the song with the id of each benchmark item."""
    songs = vectors(spark, folder).select(F.col("id").alias("qid"), F.col("track_vector").alias("vector"))
    return R.existing(songs, read(spark, folder, "benchmark"), ["qid"], ["item_id"], unique=True)


TRACK_TOP_SQL = f"""
SELECT qid, id, score, position FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS position FROM (
    SELECT q.vec_id AS qid, p.vec_id AS id, {COSINE_SQL.format(a='q.embedding::DOUBLE[]', b='p.embedding::DOUBLE[]')} AS score
    FROM embeddings q JOIN benchmark ON item_id = q.vec_id CROSS JOIN embeddings p))
WHERE position <= 15"""


@query("track_knn", f"SELECT qid, id, round(score, 4) AS score, position FROM ({TRACK_TOP_SQL}) WHERE id <> qid")
def track_knn(spark, folder):
    """The 15 best sounds, less the reference song itself."""
    hits = knn.knn(sounds(spark, folder), vectors(spark, folder), "track_vector", 15)
    return rounded(hits.filter("id <> qid"))


@query("blocked_knn", f"SELECT qid, id, round(score, 4) AS score, position FROM ({TRACK_TOP_SQL})")
def blocked_knn(spark, folder):
    """`track_knn` on the way taken by more queries than can be broadcast."""
    return rounded(knn.knn(sounds(spark, folder), vectors(spark, folder), "track_vector", 15, max_queries=16))


# The filters of a request as the search reads them, and the songs it may find.
POINTS_SQL = f"SELECT * FROM ({S.CATALOGUE_SQL}) WHERE track_vector IS NOT NULL"
PASSES_SQL = """(r.genre = '' OR r.genre IS NULL OR r.genre = p.genre) AND (r.key IS NULL OR r.key = p.initialkey)
  AND (r.bpm = 0 OR r.bpm = p.bpm)"""


def points(spark, folder):
    """Published songs: both vectors and the payload as columns."""
    songs = vectorise(S.catalogue(spark, folder, heavy=True).filter("track_vector IS NOT NULL"))
    return songs.select(
        "id",
        "track_vector",
        F.col("letra_vec").alias("lyrics_vector"),
        *[F.col(column).alias(field) for field, column in P.PAYLOAD.items()],
    )


@query(
    "filtered_knn",
    f"""
WITH {LYRIC_SCORES_SQL}, r AS MATERIALIZED ({S.REQUESTS_SQL}), p AS MATERIALIZED ({POINTS_SQL})
SELECT qid, id, round(score, 4) AS score, position FROM (
  SELECT s.*, row_number() OVER (PARTITION BY s.qid ORDER BY score DESC, s.id) AS position
  FROM lyric_scores s JOIN r ON r.qid = s.qid JOIN p ON p.id = s.id AND {PASSES_SQL})
WHERE position <= 15
""",
)
def filtered_knn(spark, folder):
    asked = search.phrase_vectors(search.valid_requests(S.requests(spark, folder)))
    return rounded(knn.knn(asked, points(spark, folder), "lyrics_vector", 15, search.FILTERS))


REFERENCE_SQL = """
SELECT r.qid, min(p.id) AS ref_id FROM r JOIN p ON p.artista = r.artist_ref AND p.cancion = r.title_ref
WHERE r.query <> '' AND r.artist_ref <> '' AND r.title_ref <> '' GROUP BY r.qid"""


@query("reference_song", f"WITH r AS ({S.REQUESTS_SQL}), p AS ({POINTS_SQL}) {REFERENCE_SQL}")
def reference_song(spark, folder):
    return search.reference_songs(search.valid_requests(S.requests(spark, folder)), points(spark, folder))


def fused_sql(requests: str) -> str:
    """The fused search of a relation of requests."""
    return f"""
WITH {LYRIC_SCORES_SQL}, r AS MATERIALIZED ({requests}), p AS MATERIALIZED ({POINTS_SQL}), ref AS MATERIALIZED ({REFERENCE_SQL}),
lyric_list AS (
  SELECT qid, id, score FROM (
    SELECT s.*, row_number() OVER (PARTITION BY s.qid ORDER BY score DESC, s.id) AS position
    FROM lyric_scores s JOIN r ON r.qid = s.qid JOIN p ON p.id = s.id AND {PASSES_SQL})
  WHERE position <= 15),
track_list AS (
  SELECT qid, id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS position FROM (
      SELECT ref.qid, ref.ref_id, p.id, {COSINE_SQL.format(a='t.track_vector::DOUBLE[]', b='p.track_vector::DOUBLE[]')} AS score
      FROM ref JOIN r ON r.qid = ref.qid JOIN p t ON t.id = ref.ref_id JOIN p ON {PASSES_SQL}))
  WHERE position <= 15 AND id <> ref_id),
fused AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
    SELECT qid, id, sum(score * 0.5) AS score, count(*) AS lists
    FROM (SELECT * FROM lyric_list UNION ALL SELECT * FROM track_list) GROUP BY qid, id))
SELECT f.qid, f.id, f.lists, f.rank, p.artista AS artist, p.cancion AS title, p.album, p.letra, NULL::VARCHAR AS mbid,
       p.bpm, p.initialkey AS key, p.genre, NULL::VARCHAR AS link, round(f.score, 4) AS score
FROM fused f JOIN p ON p.id = f.id WHERE f.rank <= 5
"""


@query("fused_search", fused_sql(S.REQUESTS_SQL))
def fused_search(spark, folder):
    found = search.fused_search(S.requests(spark, folder), points(spark, folder))
    return found.withColumn("rank", F.col("rank").cast("long"))


@query(
    "search_displayed",
    f"""
SELECT qid, rank, artist, title, coalesce(album, 'N/A') AS album, coalesce(genre, 'N/A') AS genre, coalesce(key, 'N/A') AS key,
       coalesce(bpm::VARCHAR, 'N/A') AS bpm, coalesce(mbid, 'N/A') AS mbid, coalesce(link, 'N/A') AS link,
       coalesce(letra, 'Letra no disponible.') AS letra, score
FROM ({fused_sql(S.REQUESTS_SQL)})
""",
)
def search_displayed(spark, folder):
    """The same results with what is shown for a field that is not there."""
    return search.displayed(fused_search(spark, folder)).drop("id", "lists")


# Of ten requests one is cut off, one has no phrase, one asks for a genre that no song has,
# and one for a tempo with a decimal point.
ANSWERABLE_SQL = f"""
SELECT qid, query, CASE WHEN qid % 10 = 2 THEN 'nowhere' ELSE genre END AS genre, key,
       CASE WHEN qid % 10 = 3 THEN 90.0 ELSE bpm END::DOUBLE AS bpm, artist_ref, title_ref
FROM ({S.REQUESTS_SQL}) WHERE qid % 10 NOT IN (0, 1)"""


@query(
    "search_responses",
    f"""
SELECT q.qid, CASE WHEN q.qid % 10 NOT IN (0, 1) THEN q.query END AS query_input,
       CASE q.qid % 10 WHEN 0 THEN 'Invalid request' WHEN 1 THEN 'Missing ''query'' field' END AS error,
       id, lists, rank, artist, title, album, letra, mbid, bpm, key, genre, link, score
FROM (SELECT qid, query FROM ({S.REQUESTS_SQL})) q LEFT JOIN ({fused_sql(ANSWERABLE_SQL)}) USING (qid)
""",
)
def search_responses(spark, folder):
    kind = F.col("qid") % 10
    fields = (
        F.when(kind != 1, F.col("query")).alias("query"),
        F.when(kind == 2, "nowhere").otherwise(F.col("genre")).alias("genre"),
        "key",
        F.when(kind == 3, F.lit(90.0)).otherwise(F.col("bpm").cast("double")).alias("bpm"),
        "artist_ref",
        "title_ref",
    )
    body = F.to_json(F.struct(*fields))
    texts = S.requests(spark, folder).select("qid", F.when(kind == 0, F.substring(body, 1, 12)).otherwise(body).alias("request"))
    found = search.search_responses(texts, points(spark, folder))
    return found.withColumn("rank", F.col("rank").cast("long"))


# Cells, those of them that a search reads, and the points whose vectors it reads.
CELLS, PROBES, SHORTLIST = 20, 16, 100


def stored_cells(spark, folder, fixed=False):
    """Centres and the point table partitioned by cell, fitted and written once for a search to read."""
    path = new_path(spark, "cells")
    songs = vectors(spark, folder)
    centres = (ann.fixed_cells if fixed else ann.fit_cells)(songs, "track_vector", CELLS)
    return centres, ann.write_cells(songs, "track_vector", centres, path)


@query("ann_all_cells", f"SELECT qid, id, round(score, 4) AS score, position FROM ({TRACK_TOP_SQL})")
def ann_all_cells(spark, folder):
    """With every cell probed, the cells must give exactly what exact search gives."""
    centres, celled = stored_cells(spark, folder)
    return rounded(ann.ann_knn(sounds(spark, folder), celled, "track_vector", 15, centres, probes=len(centres)))


# Unit vectors, the first of them as centres, the cell of every point and the cells a query reads.
CELLS_SQL = f"""
u AS MATERIALIZED (
  SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v,
         embedding::DOUBLE[] AS e, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM embeddings),
near_cells AS MATERIALIZED (
  SELECT u.id, c.n AS cell, row_number() OVER (PARTITION BY u.id ORDER BY round(list_dot_product(u.v, c.v), 9) DESC, c.n) AS nth
  FROM u JOIN u c ON c.n < {CELLS}),
reads AS MATERIALIZED (SELECT id AS qid, cell FROM near_cells WHERE nth <= {PROBES} AND id IN (SELECT item_id FROM benchmark)),
home AS MATERIALIZED (SELECT u.*, cell FROM u JOIN near_cells USING (id) WHERE nth = 1)"""


@query(
    "ann_knn",
    f"""
WITH {CELLS_SQL}
SELECT qid, id, round(score, 4) AS score, position FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS position FROM (
    SELECT reads.qid, home.id, {COSINE_SQL.format(a='q.e', b='home.e')} AS score
    FROM reads JOIN home USING (cell) JOIN u q ON q.id = reads.qid))
WHERE position <= 15
""",
)
def ann_knn(spark, folder):
    """Neighbours out of the cells that a query reads; the centres are points, for SQL to follow."""
    centres, celled = stored_cells(spark, folder, fixed=True)
    return rounded(ann.ann_knn(sounds(spark, folder), celled, "track_vector", 15, centres, probes=PROBES))


# Residual codes of four coordinates a part, the products of queries with the words, and the short list.
CODES_SQL = f"""{CELLS_SQL},
residual AS MATERIALIZED (
  SELECT home.id, home.cell, home.n, j, list_transform(range(4 * j + 1, 4 * j + 5), lambda i: home.v[i] - c.v[i]) AS part
  FROM home JOIN u c ON c.n = home.cell CROSS JOIN (SELECT unnest(range(16)) AS j)),
words AS MATERIALIZED (SELECT j, n AS w, part AS word FROM residual WHERE n < 256),
codes AS MATERIALIZED (
  SELECT id, cell, j, w AS code FROM (
    SELECT id, cell, j, w, row_number() OVER (
      PARTITION BY id, j ORDER BY round(2 * list_dot_product(part, word) - list_dot_product(word, word), 9) DESC, w) AS nth
    FROM residual JOIN words USING (j))
  WHERE nth = 1),
tables AS MATERIALIZED (
  SELECT u.id AS qid, j, w AS code, list_dot_product(u.v[4 * j + 1 : 4 * j + 4], word) AS product
  FROM u JOIN benchmark ON item_id = u.id CROSS JOIN words),
listed AS MATERIALIZED (
  SELECT qid, id FROM (
    SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY near DESC, id) AS nth FROM (
      SELECT t.qid, codes.id, round(any_value(list_dot_product(q.v, c.v)) + sum(product), 9) AS near
      FROM codes JOIN reads USING (cell) JOIN tables t ON t.qid = reads.qid AND t.j = codes.j AND t.code = codes.code
      JOIN u q ON q.id = reads.qid JOIN u c ON c.n = codes.cell GROUP BY t.qid, codes.id))
  WHERE nth <= {SHORTLIST}),
hits AS MATERIALIZED (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS position FROM (
      SELECT qid, listed.id, {COSINE_SQL.format(a='q.e', b='p.e')} AS score
      FROM listed JOIN u q ON q.id = qid JOIN u p ON p.id = listed.id))
  WHERE position <= 15)"""


def stored_codes(spark, folder):
    """The quantised index of the track vectors, its code words taken from the first points."""
    songs = vectors(spark, folder)
    return pq.build(songs, "track_vector", pq.fixed(songs, "track_vector", cells=CELLS), new_path(spark, "codes"))


@query("ann_codes", f"WITH {CODES_SQL} SELECT qid, id, round(score, 4) AS score, position FROM hits")
def ann_codes(spark, folder):
    """Neighbours by residual codes: the best codes' vectors are read and scored exactly."""
    return rounded(pq.search(sounds(spark, folder), stored_codes(spark, folder), 15, PROBES, SHORTLIST))


@query(
    "ann_recall",
    f"""
WITH {CODES_SQL},
exact AS ({TRACK_TOP_SQL}),
sizes AS (SELECT cell, count(*) AS n FROM home GROUP BY cell)
SELECT qid, (SELECT count(*) FROM hits h JOIN exact x ON x.qid = h.qid AND x.id = h.id WHERE h.qid = q.qid) AS found,
       (SELECT count(*) FROM exact x WHERE x.qid = q.qid) AS wanted,
       (SELECT sum(n) FROM reads JOIN sizes USING (cell) WHERE reads.qid = q.qid)::BIGINT AS codes,
       (SELECT count(*) FROM listed l WHERE l.qid = q.qid) AS vectors, (SELECT count(*) FROM u) AS points
FROM (SELECT DISTINCT qid FROM reads) q
""",
)
def ann_recall(spark, folder):
    """How many exact neighbours `ann_codes` finds for each query, and how much of the index it reads for that."""
    asked = sounds(spark, folder)
    exact = knn.knn(asked, vectors(spark, folder), "track_vector", 15)
    return pq.reading(asked, stored_codes(spark, folder), exact, 15, PROBES, SHORTLIST)

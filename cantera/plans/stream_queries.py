"""Registered queries: incremental publishing and streamed progress, run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from cantera.plans import standins as S
from cantera.plans.catalogue import vectorise
from cantera.plans.registry import query
from cantera.plans.relational_queries import PROGRESS_SQL, progress_updates
from cantera.plans.vector_queries import LYRIC_WORDS_SQL
from cantera.session import new_path
from cantera.streaming import progress, publish
from cantera.tables import read, spread

DOCUMENTS = "doc_id BIGINT, text STRING, lang STRING, source STRING"
EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


@query(
    "stream_publish",
    f"""
WITH w AS ({S.hashed_sql(f'({LYRIC_WORDS_SQL})', 'words')}),
n AS (SELECT id, sum(weight * weight)::BIGINT AS lyrics_norm2 FROM w GROUP BY id)
SELECT d.doc_id AS id, d.source AS artist, d.lang AS key, len(e.embedding)::BIGINT AS track_width, coalesce(n.lyrics_norm2, 0) AS lyrics_norm2
FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN n ON n.id = d.doc_id
""",
)
def stream_publish(spark, folder):
    """Documents arrive as a stream, get their vectors and are published; songs without sound are rejected."""
    tracks = read(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("track_vector"))

    def prepare(batch):
        nothing = {c: F.lit(None).cast("string") for c in ("album", "mbid", "link", "genre")}
        songs = spread(batch).join(tracks, "doc_id", "left").select(
            F.col("doc_id").alias("id"),
            "track_vector",
            F.col("source").alias("artista"),
            F.concat(F.lit("song "), F.col("doc_id").cast("string")).alias("cancion"),
            F.col("text").alias("letra"),
            F.col("lang").alias("initialkey"),
            F.lit(None).cast("double").alias("bpm"),
            F.lit(2).alias("version"),
            *[value.alias(name) for name, value in nothing.items()],
        )
        # Every song also comes in an older version, under another name.
        older = songs.withColumns({"version": F.lit(1), "artista": F.lit("older")})
        return vectorise(songs.unionByName(older))

    target, checkpoint = new_path(spark, "points"), new_path(spark, "publish")
    publish.publish_available(spark, f"{folder}/documents.parquet*", DOCUMENTS, target, checkpoint, prepare, version="version")
    squares = F.aggregate("lyrics_vector", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return publish.published(spark, target).select(
        "id",
        "payload.artist",
        "payload.key",
        F.size("track_vector").cast("long").alias("track_width"),
        squares.cast("long").alias("lyrics_norm2"),
    )


LATE_SQL = f"""
WITH w AS ({S.hashed_sql(f'({LYRIC_WORDS_SQL})', 'words')}),
n AS (SELECT id, sum(weight * weight)::BIGINT AS lyrics_norm2 FROM w GROUP BY id)
SELECT d.doc_id AS id, d.source AS artist, round(list_sum(e.embedding::DOUBLE[]), 5) AS track_sum, coalesce(n.lyrics_norm2, 0) AS lyrics_norm2
FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN n ON n.id = d.doc_id
"""


@query("stream_late_publish", LATE_SQL)
def stream_late_publish(spark, folder):
    """Lyrics and sounds arrive by themselves, one half of the songs lyric first and the others sound first.

    Three runs with one checkpoint: a song is published by the run in which its second vector comes.
    """
    source, target, checkpoint = new_path(spark, "arrivals"), new_path(spark, "points"), new_path(spark, "publish")
    nothing = {c: F.lit(None).cast("string") for c in ("album", "mbid", "link", "genre", "initialkey")}
    lyrics = read(spark, folder, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("artista"),
        F.concat(F.lit("song "), F.col("doc_id").cast("string")).alias("cancion"),
        F.col("text").alias("letra"),
        F.lit(None).cast("double").alias("bpm"),
        *[value.alias(name) for name, value in nothing.items()],
    )
    tracks = read(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("track_vector"))
    first = F.col("id") % 2 == 0
    waves = ([(lyrics, "lyrics", first), (tracks, "tracks", ~first)], [(lyrics, "lyrics", ~first)], [(tracks, "tracks", first)])
    for wave in waves:
        for rows, name, part in wave:
            rows.filter(part).write.mode("append").parquet(f"{source}/{name}")
        arriving = {name: spark.readStream.schema(rows.schema).parquet(f"{source}/{name}") for rows, name in ((lyrics, "lyrics"), (tracks, "tracks"))}
        publish.publish_pairs(vectorise(arriving["lyrics"]), arriving["tracks"], target, checkpoint).awaitTermination()
    total = lambda v, f: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + f(x.cast("double")))
    return publish.published(spark, target).select(
        "id",
        "payload.artist",
        F.round(total("track_vector", lambda x: x), 5).alias("track_sum"),
        total("lyrics_vector", lambda x: x * x).cast("long").alias("lyrics_norm2"),
    )


@query(
    "stream_counts",
    """
SELECT CASE WHEN d.doc_id % 2 = 0 THEN 0 ELSE 1 END AS batch, count(*) AS processed,
       count(e.vec_id) FILTER (WHERE d.lang <> 'fr') AS published, count(*) - count(e.vec_id) FILTER (WHERE d.lang <> 'fr') AS rejected
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY ALL
""",
)
def stream_counts(spark, folder):
    """What each batch published and rejected, counted while it was written: songs without sound and French ones, too narrow, are rejected."""
    songs = S.catalogue(spark, folder)
    vector = F.when(F.col("initialkey") == "fr", F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0))).cast("array<float>")
    songs = songs.withColumn("letra_vec", vector)
    source, target, checkpoint, counts = (new_path(spark, name) for name in ("songs", "points", "publish", "counts"))
    for odd in (0, 1):
        # As many files as there are tasks, all of them in one batch.
        songs.filter(F.col("id") % 2 == odd).write.mode("append").parquet(source)
        publish.publish_available(
            spark, source, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in songs.schema), target, checkpoint,
            max_files=(1 << 31) - 1, widths={"lyrics_vector": 2}, counts=counts,
        )
    return publish.published_counts(spark, counts).drop("run").withColumn("batch", F.col("batch").cast("int"))


@query("progress_stream", PROGRESS_SQL)
def progress_stream(spark, folder):
    target, checkpoint = new_path(spark, "progress"), new_path(spark, "progress-checkpoint")
    events = spark.readStream.schema(EVENTS).parquet(f"{folder}/events.parquet*")
    order = ["updated_at", "event_id"]
    # Two streams with checkpoints of their own share the target.
    for number, part in enumerate(("event_type = 'click'", "event_type <> 'click'")):
        updates = progress_updates(events.filter(part))
        progress.progress_stream(updates, order, target, f"{checkpoint}-{number}").awaitTermination()
    return progress.streamed_progress(spark, target, updates, order).drop("updated_at")

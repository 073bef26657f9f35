"""Collecting a catalogue and turning it into points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantera.functions import checks, text
from cantera.operators import embedding, lyrics, quality, relational
from cantera.sources import points as P
from cantera.sources import responses
from cantera.tables import GATES


def new_artists(artists: DataFrame, pages: DataFrame, response: str, query: str) -> DataFrame:
    """Artists to append, from collected pages of names; the id is a hash of the name."""
    names = responses.explode_hits(pages, response, "artists", "name", keep=(query, "page"), into="nombre")
    fresh = relational.insert_absent(artists, names, ["nombre"], [F.asc("page")], "drop")
    return fresh.select(F.xxhash64("nombre").alias("id"), "nombre", F.col(query).alias("query"), "page")


def new_songs(songs: DataFrame, found: DataFrame, response: str) -> DataFrame:
    """Songs to append, from one collected search response per artist."""
    titles = responses.explode_hits(
        found, response, "response.hits", "result.title", keep=("id_artista", "artista"), into="cancion"
    )
    fresh = relational.insert_absent(songs, titles, ["id_artista", "cancion"], [F.asc("artista")], "drop")
    return fresh.select(F.xxhash64("id_artista", "cancion").alias("id"), "id_artista", "artista", "cancion")


def process_missing(songs: DataFrame, held: DataFrame, bodies: DataFrame, body: str, source: str = "source", priority: str = "priority") -> DataFrame:
    """(`id`, `letra`, `source`, `saved`, `reason`): what became of every song that had no lyric.

    `bodies` holds collected responses by song `id`, any number for each, with the name of
    their `source` and its `priority`. The first source that has a lyric counts, whatever the
    others hold: smallest priority, null last, then the name; of one source's several lyrics the
    one that sorts first. The rows that were saved are the lyrics to append, one per song; a
    song whose responses hold no lyric or cannot be read stays queued, with the reason.
    """
    tried = bodies.select("id", text.lyrics_from_body(F.col(body)).alias("letra"), F.col(source).alias("source"), F.col(priority).alias("priority"))
    order = [F.col("letra").isNull(), F.asc_nulls_last("priority"), F.asc_nulls_last("source"), F.asc("letra")]
    best = relational.first_per_key(tried, ["id"], order).drop("priority").withColumn("tried", F.lit(True))
    queue = relational.missing_lyrics(songs, held).select("id")
    saved = F.col("letra").isNotNull()
    reason = F.when(F.col("tried").isNull(), "not tried").when(~saved, "no lyric")
    return queue.join(best, "id", "left").select(
        "id", "letra", F.when(saved, F.col("source")).alias("source"), saved.alias("saved"), reason.alias("reason")
    )


def fill_mbid(songs: DataFrame, found: DataFrame, response: str) -> DataFrame:
    """`songs` with `mbid` filled where it was null and a response has one, and a `reason` where it stays null.

    `found` holds responses by song `id`, any number for each; the first recording of a
    response counts, and the smallest identifier of a song. Identifiers that are there stay.
    """
    pending = relational.pending(songs, "mbid").select("id").distinct()
    hits = responses.first_hit(found.join(pending, "id", "left_semi"), response, "recordings", {"id": "STRING"}, ("id", response))
    hits = hits.toDF("id", "_response", "_hit")
    read = F.try_parse_json("_response").isNotNull()
    valid = F.when(checks.is_mbid(F.col("_hit")), F.col("_hit"))
    state = F.when(valid.isNotNull(), F.lit(None)).when(~read, "broken response").otherwise("no recording")
    updates = hits.select("id", valid.alias("mbid"), state.alias("reason"))
    blank = songs.withColumn("reason", F.when(F.col("mbid").isNull(), F.lit("no response")))
    filled = relational.enrich(blank, updates, "id", [F.asc_nulls_last("mbid"), F.asc("reason")], ["reason"], ["mbid"])
    return filled.withColumn("reason", F.when(F.col("mbid").isNull(), F.col("reason")))


def vectorise_missing(songs: DataFrame, **options) -> DataFrame:
    """`songs` with `letra_vec` written to the rows that lack it and have a lyric; the others stay."""
    queue = songs.filter("letra_vec IS NULL AND letra IS NOT NULL").select("id", "letra")
    fresh = vectorise(queue, **options).select("id", "letra_vec")
    return relational.enrich(songs, fresh, "id", [F.asc("id")], fill=["letra_vec"])


def gates(artists: DataFrame, songs: DataFrame) -> DataFrame:
    """Whether enough was collected for the next stage."""
    return quality.stage_gate(
        {"artistas": (artists, GATES["artistas"]), "canciones": (songs, GATES["canciones"])}
    )


def vectorise(
    songs: DataFrame, width: int = embedding.WIDTH, model: Callable | None = None
) -> DataFrame:
    """Add `letra_procesada` and `letra_vec` to catalogue rows; a null lyric keeps null."""
    prepared = lyrics.prepare_lyrics(songs, "letra", "letra_procesada")
    return embedding.embed(prepared, "letra_procesada", width, model, "letra_vec")


def publishable(songs: DataFrame) -> DataFrame:
    """Points of catalogue rows, with a `reason` where a row cannot be published."""
    return P.to_points(songs)

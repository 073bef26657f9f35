"""Songs about a phrase, optionally sounding like a song, for a batch of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cantera.functions import text as X
from cantera.operators import embedding, knn
from cantera.operators.relational import reshuffled
from cantera.session import shared_folder
from cantera.sources.responses import parse_requests

# Fields that may be constrained, and the fields of a result.
FILTERS = ("genre", "key", "bpm")
RESULT = ("rank", "artist", "title", "album", "letra", "mbid", "bpm", "key", "genre", "link", "score")


def valid_requests(requests: DataFrame) -> DataFrame:
    """Requests with a phrase; empty and zero filters become null, which is no constraint."""
    text = lambda name: F.nullif(F.col(name), F.lit(""))
    return requests.filter(F.coalesce(F.col("query"), F.lit("")) != "").withColumns(
        {
            "genre": text("genre"),
            "key": text("key"),
            "bpm": F.nullif(F.col("bpm").cast("double"), F.lit(0.0)),
            "artist_ref": text("artist_ref"),
            "title_ref": text("title_ref"),
        }
    )


def phrase_vectors(requests: DataFrame, width: int = embedding.WIDTH, model=None) -> DataFrame:
    """Add the `vector` of the phrase. A model gets the phrase as written, hashing its words."""
    words = F.col("query") if model else F.array_join(X.words_of(F.col("query")), " ")
    return embedding.embed(requests.withColumn("_phrase", words), "_phrase", width, model).drop("_phrase")


def reference_songs(requests: DataFrame, points: DataFrame, small: bool = False) -> DataFrame:
    """(qid, ref_id): the song that artist and title of the request name, the smallest id of it.

    Points are only read for id, artist and title. `small` says that the number of requests
    was checked: their names are broadcast and only matching songs are reduced. Otherwise
    songs are reduced to one id per name before the shuffle, so a name that very many songs
    bear is no hot spot.
    """
    named = requests.filter(F.col("artist_ref").isNotNull() & F.col("title_ref").isNotNull())
    songs = points.select(F.col("artist").alias("artist_ref"), F.col("title").alias("title_ref"), "id")
    names = ["artist_ref", "title_ref"]
    if small:
        songs = songs.join(F.broadcast(named.select(names).distinct()), names)
    found = songs.groupBy(names).agg(F.min("id").alias("ref_id"))
    return named.select("qid", *names).join(reshuffled(found, names), names).select("qid", "ref_id")


def sound_queries(requests: DataFrame, points: DataFrame, small: bool = False) -> tuple[DataFrame, DataFrame]:
    """(qid, ref_id) of the reference songs, and (qid, vector, filters) with their sound."""
    refs = reference_songs(requests, points, small)
    wanted = _settled(refs.join(requests.select("qid", *FILTERS), "qid"), small)
    sounds = points.select(F.col("id").alias("ref_id"), F.col("track_vector").alias("vector"))
    sounds = _fetched(sounds, wanted, "ref_id", small)
    return wanted.select("qid", "ref_id"), sounds if small else _settled(sounds, small)


def _settled(df: DataFrame, small: bool) -> DataFrame:
    """Computed once, because several parts of the plan read it: a few narrow rows per request
    as a local table while the requests are few, a checkpoint in the shared folder otherwise."""
    if small:
        return df.sparkSession.createDataFrame(df.toArrow(), df.schema)
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _fetched(songs: DataFrame, wanted: DataFrame, key: str, small: bool) -> DataFrame:
    """`songs` joined to the settled rows of `wanted`.

    When these are few, their ids are named in a filter as well. It reaches the scan, so that
    files sorted by id give up only the pages that hold one, whatever the other columns weigh.
    """
    if not small:
        return songs.join(wanted, key)
    ids = sorted({row[0] for row in wanted.select(key).collect()})
    named = F.expr(f"{key} IN ({', '.join(map(str, ids))})") if ids else F.lit(False)
    return songs.filter(named).join(F.broadcast(wanted), key)


def fuse(hits: DataFrame, top_k: int, weight: float = 0.5) -> DataFrame:
    """(qid, id, score, lists, rank): weighted sum per song of the lists that found it."""
    fused = hits.groupBy("qid", "id").agg(
        F.sum(F.col("score") * weight).alias("score"), F.count(F.lit(1)).alias("lists")
    )
    best = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("id"))
    return fused.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_k)


def fused_search(
    requests: DataFrame,
    points: DataFrame,
    top_k: int = 5,
    widen: int = 3,
    weight: float = 0.5,
    width: int = embedding.WIDTH,
    model=None,
    max_requests: int = knn.MAX_QUERIES,
) -> DataFrame:
    """One row per request and rank, with `id`, `lists` and the eleven result fields.

    `requests`: qid, query, genre, key, bpm, artist_ref, title_ref. `points`: id, both
    vectors, payload columns. Filters bind both lists but not the reference lookup; an
    unknown reference song leaves the phrase list alone; the reference song itself is taken
    from the sound list after its top, and may still come from the phrase list.
    """
    valid = valid_requests(requests)
    # Requests times results decide whether what grows with them may be broadcast or named.
    most = max_requests // max(1, top_k * widen // (knn.TOP * widen))
    small = valid.select("qid").limit(most + 1).count() <= most
    refs, sounds = sound_queries(valid, points, small)
    hits = knn.search_lists(
        [
            knn.SearchList("lyrics", phrase_vectors(valid, width, model), "lyrics_vector"),
            knn.SearchList("track", sounds, "track_vector"),
        ],
        points,
        top_k * widen,
        FILTERS,
        max_queries=max_requests,
    )
    ranked = _settled(fuse(without_reference(hits, refs, small), top_k, weight), small)
    return with_payload(ranked, points, small)


def search_responses(
    requests: DataFrame, points: DataFrame, request: str = "request", top_k: int = 5, **options
) -> DataFrame:
    """From request texts to answers: one row per request and rank, and one for every other request.

    (`qid`, `query_input`, `error`, `id`, `lists` and the eleven result fields). A request that
    cannot be read or has no phrase keeps its error, one without a hit has neither error nor
    rank; none is left out.
    """
    parsed = parse_requests(requests, request, ("qid",))
    found = fused_search(parsed.filter("error IS NULL").drop("error"), points, top_k, **options)
    asked = parsed.select("qid", F.col("query").alias("query_input"), "error")
    return asked.join(found, "qid", "left").select("qid", "query_input", "error", "id", "lists", *RESULT)


def without_reference(hits: DataFrame, refs: DataFrame, small: bool = False) -> DataFrame:
    """Drop the reference song from the sound list."""
    own = refs.select("qid", F.col("ref_id").alias("id"), F.lit("track").alias("list"))
    return hits.join(F.broadcast(own) if small else own, ["qid", "id", "list"], "left_anti")


def with_payload(ranked: DataFrame, points: DataFrame, small: bool = False) -> DataFrame:
    """Join the payload to the few ranked rows and name the result fields."""
    songs = points.select("id", "artist", "title", F.col("lyric").alias("letra"), "album", "mbid", "bpm", "key", "genre", "link")
    return _fetched(songs, ranked, "id", small).withColumn("score", F.round("score", 4)).select("qid", "id", "lists", *RESULT)


def displayed(results: DataFrame, absent: str = "N/A", no_lyric: str = "Letra no disponible.") -> DataFrame:
    """Results as shown: an absent field reads `absent`, an absent lyric `no_lyric`."""
    shown = {name: absent for name in ("album", "genre", "key", "bpm", "mbid", "link")} | {"letra": no_lyric}
    return results.withColumns({name: F.coalesce(F.col(name).cast("string"), F.lit(text)) for name, text in shown.items()})

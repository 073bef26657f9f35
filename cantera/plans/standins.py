"""The catalogue's tables out of the given ones, in Spark and as SQL for the check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantera.functions import text as X
from cantera.tables import read, spread


def artists(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("nombre"))


def songs(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("id_artista"),
        F.col("o_orderpriority").alias("cancion"),
        F.col("o_orderdate").alias("fecha_guardado"),
    )


def lyrics(spark: SparkSession, folder: str) -> DataFrame:
    """Lyric rows by song; a returned line stands for a lyric that came back empty."""
    return read(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("id_cancion"),
        F.when(F.col("l_returnflag") != "R", F.col("l_linestatus")).alias("letra"),
    )


LYRICS_SQL = """
SELECT l_orderkey AS id_cancion, CASE WHEN l_returnflag <> 'R' THEN l_linestatus END AS letra
FROM lineitem
"""


def catalogue(spark: SparkSession, folder: str, heavy: bool = False) -> DataFrame:
    """Songs with lyric, tempo, key, genre and, where there is one, a track vector.

    `heavy` announces expensive work per song.
    """
    documents = read(spark, folder, "documents", "doc_id", "text", "lang", "source")
    documents = spread(documents) if heavy else documents
    labels = read(spark, folder, "labels", "doc_id", "quality")
    vectors = read(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("track_vector"))
    joined = documents.join(labels, "doc_id", "left").join(vectors, "doc_id", "left")
    return joined.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("artista"),
        F.concat(F.lit("song "), F.col("doc_id").cast("string")).alias("cancion"),
        F.col("text").alias("letra"),
        F.col("source").alias("album"),
        F.lit(None).cast("string").alias("mbid"),
        F.lit(None).cast("string").alias("link"),
        F.when(F.col("quality") == 1, F.lit(120.0)).when(F.col("quality") == 0, F.lit(90.0)).alias("bpm"),
        F.col("lang").alias("initialkey"),
        F.col("source").alias("genre"),
        "track_vector",
    )


CATALOGUE_SQL = """
SELECT d.doc_id AS id, d.source AS artista, 'song ' || d.doc_id::VARCHAR AS cancion, d.text AS letra,
       d.source AS album, CASE l.quality WHEN 1 THEN 120.0::DOUBLE WHEN 0 THEN 90.0::DOUBLE END AS bpm,
       d.lang AS initialkey, d.source AS genre, e.embedding AS track_vector
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id
"""


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """A phrase per benchmark item, with filters and a reference song by its language.

    French ones ask for the key, Spanish ones for the genre and no reference song, long
    English ones for a tempo, German ones name an unknown song.
    """
    item = read(spark, folder, "benchmark")
    song = read(spark, folder, "documents", "doc_id", "lang", "source").withColumnRenamed("doc_id", "item_id")
    lang = F.col("lang")
    title = F.concat(F.lit("song "), F.col("item_id").cast("string"))
    return item.join(song, "item_id", "left").select(
        F.col("item_id").alias("qid"),
        F.col("text").alias("query"),
        F.when(lang == "es", F.col("source")).otherwise(F.lit("")).alias("genre"),
        F.when(lang == "fr", lang).alias("key"),
        F.when((lang == "en") & (F.length("text") > 200), F.lit(120)).otherwise(F.lit(0)).alias("bpm"),
        F.when(lang != "es", F.col("source")).alias("artist_ref"),
        F.when(lang == "de", F.lit("unknown")).otherwise(title).alias("title_ref"),
    )


REQUESTS_SQL = """
SELECT b.item_id AS qid, b.text AS query, CASE WHEN d.lang = 'es' THEN d.source ELSE '' END AS genre,
       CASE WHEN d.lang = 'fr' THEN d.lang END AS key,
       CASE WHEN d.lang = 'en' AND length(b.text) > 200 THEN 120 ELSE 0 END AS bpm,
       CASE WHEN d.lang <> 'es' THEN d.source END AS artist_ref,
       CASE WHEN d.lang = 'de' THEN 'unknown' ELSE 'song ' || b.item_id::VARCHAR END AS title_ref
FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id
"""


# --- text in SQL ------------------------------------------------------------------------


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# The classes of functions.text, spelled for RE2.
SPACE_SQL = r"\t-\r\x1c-\x20\x{85}\p{Z}"
LINE_SQL = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def clean_sql(text: str) -> str:
    trimmed = f"lambda x: trim(x, {_quoted(X.SPACE_CHARACTERS)})"
    lines = f"list_transform(string_split_regex(split_part({text}, '____', 1), '{LINE_SQL}'), {trimmed})"
    kept = f"array_to_string(list_filter({lines}, lambda x: x <> ''), chr(10))"
    return rf"regexp_replace(lower({kept}), '[^\p{{L}}\p{{N}}_{SPACE_SQL}]', '', 'g')"


def tokens_sql(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '[{SPACE_SQL}]+'), lambda x: x <> '')"


def _in(language: str) -> str:
    return "(" + ", ".join(_quoted(word) for word in X.STOP_WORDS[language]) + ")"


def votes_sql(words: str) -> str:
    return ", ".join(
        f"len(list_filter({words}, lambda w: w IN {_in(code)})) AS {code}_votes" for code in X.VOTE_ORDER
    )


LANGUAGE_SQL = """CASE WHEN en_votes >= es_votes AND en_votes >= fr_votes AND en_votes >= de_votes THEN 'en'
 WHEN es_votes >= fr_votes AND es_votes >= de_votes THEN 'es' WHEN fr_votes >= de_votes THEN 'fr' ELSE 'de' END"""


def filtered_sql(words: str, language: str) -> str:
    keep = lambda code: f"list_filter({words}, lambda w: w NOT IN {_in(code)})"
    return (
        f"array_to_string(CASE {language} WHEN 'es' THEN {keep('es')} WHEN 'fr' THEN {keep('fr')} "
        f"ELSE {keep('en')} END, ' ')"
    )


def prepared_sql(source: str, id: str, text: str) -> str:
    """(id, words): cleaned text less stop words, of `source`."""
    return f"""
SELECT id, {filtered_sql('words', 'language')} AS words FROM (
  SELECT id, words, {LANGUAGE_SQL} AS language FROM (
    SELECT id, words, {votes_sql('words')} FROM (
      SELECT {id} AS id, {tokens_sql(clean_sql(text))} AS words FROM {source})))"""


def hashed_sql(source: str, words: str, width: int = 1024) -> str:
    """(id, bucket, weight) of `source`, a relation with id and a list column `words`."""
    return f"""
SELECT id, (h % {width})::BIGINT AS bucket, sum(CASE WHEN (h // {width}) % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS weight
FROM (SELECT id, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h
      FROM (SELECT id, unnest({words}) AS w FROM {source}))
GROUP BY ALL HAVING sum(CASE WHEN (h // {width}) % 2 = 0 THEN 1 ELSE -1 END) <> 0"""

"""The point table: two vectors and a payload per song."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantera.operators.embedding import pool_nested
from cantera.sources.sinks import tag_rejected

# Payload field and the catalogue column it comes from.
PAYLOAD = {
    "artist": "artista",
    "title": "cancion",
    "lyric": "letra",
    "album": "album",
    "mbid": "mbid",
    "link": "link",
    "bpm": "bpm",
    "key": "initialkey",
    "genre": "genre",
}


def payload() -> Column:
    return F.struct(*[F.col(column).alias(field) for field, column in PAYLOAD.items()])


def to_points(songs: DataFrame, widths: dict[str, int] | None = None, version: str | None = None) -> DataFrame:
    """(id, track_vector, lyrics_vector, payload, version, reason) of catalogue rows.

    `reason` is null for rows that can be published; a song whose patches cannot be averaged,
    or that has a vector missing or of another width than `widths`, says why instead.
    """
    pooled = pool_nested(songs, "track_vector", "_pooled")
    columns = {"track_vector": F.col("_pooled"), "lyrics_vector": F.col("letra_vec").cast("array<float>")}
    checks = {
        "track vector is empty or ragged": F.coalesce(F.size("_pooled") == 0, F.lit(True)),
        "lyrics vector is empty": F.coalesce(F.size("letra_vec") == 0, F.lit(True)),
    }
    points = tag_rejected(pooled, checks).select(
        "id",
        *[column.alias(name) for name, column in columns.items()],
        payload().alias("payload"),
        (F.col(version) if version else F.lit(0)).cast("long").alias("version"),
        "reason",
    )
    return of_widths(points, widths) if widths else points


def of_widths(points: DataFrame, widths: dict[str, int]) -> DataFrame:
    """`points` with a `reason` where a vector has another width than `widths` says."""
    wrong = [F.when(F.size(name) != width, F.lit(f"{name} is not {width} wide")) for name, width in widths.items()]
    return points.withColumn("reason", F.coalesce("reason", *wrong))


def declare(points: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Note the width and metric of the vectors in the schema, which Parquet keeps."""
    noted = {name: {"width": width, "metric": "cosine"} for name, width in widths.items()}
    return points.select(*[F.col(c).alias(c, metadata=noted[c]) if c in noted else F.col(c) for c in points.columns])


def declared(points: DataFrame) -> dict[str, int]:
    """The widths noted by `declare`."""
    return {f.name: f.metadata["width"] for f in points.schema if "width" in f.metadata}


def flat(points: DataFrame) -> DataFrame:
    """Points with their payload fields as columns, the form that search reads."""
    return points.select("id", "track_vector", "lyrics_vector", "payload.*")

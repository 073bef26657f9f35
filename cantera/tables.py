"""Schemas of the song catalogue, as DDL, and the reader of its Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Table columns. Ids are business keys; `letras` is unique on id_cancion.
SCHEMAS = {
    "artistas": "id BIGINT, nombre STRING, fecha_guardado TIMESTAMP_NTZ, query STRING",
    "canciones": (
        "id BIGINT, id_artista BIGINT, artista STRING, cancion STRING, fecha_guardado TIMESTAMP_NTZ"
    ),
    "letras": (
        "id BIGINT, id_cancion BIGINT, artista STRING, cancion STRING, letra STRING, mbid STRING, "
        "fecha_guardado TIMESTAMP_NTZ"
    ),
    "canciones_resultado": (
        "id BIGINT, id_artista BIGINT, artista STRING, cancion STRING, id_cancion BIGINT, "
        "mbid STRING, letra STRING, fecha_guardado TIMESTAMP_NTZ"
    ),
    "progress": (
        "task_type STRING, current_offset INT, total_items INT, last_processed_id INT, "
        "status STRING, error_message STRING, updated_at TIMESTAMP_NTZ"
    ),
    "lyrics_database": (
        "id BIGINT, artista STRING, cancion STRING, letra STRING, album STRING, mbid STRING, "
        "letra_procesada STRING, letra_vec ARRAY<FLOAT>, link STRING, "
        "track_vector ARRAY<ARRAY<FLOAT>>, bpm DOUBLE, initialkey STRING, genre STRING"
    ),
    "features": "postgre_id BIGINT, mbid STRING, features STRING",
    "points": (
        "id BIGINT, track_vector ARRAY<FLOAT>, lyrics_vector ARRAY<FLOAT>, "
        "payload STRUCT<artist STRING, title STRING, lyric STRING, album STRING, mbid STRING, "
        "link STRING, bpm DOUBLE, key STRING, genre STRING>"
    ),
    "requests": (
        "query STRING, genre STRING, key STRING, bpm DOUBLE, artist_ref STRING, title_ref STRING"
    ),
}

STAGES = ("artistas", "canciones", "letras", "vectors")
# Rows a stage must have collected before the next one may start.
GATES = {"artistas": 100, "canciones": 10}


def read(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Table `name` of `folder`; naming columns documents what the scan is meant to read."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """Give an expensive per-row job all cores when its input has fewer partitions than that.

    A small file holds one row group and is read by one task. Inputs with a partition per
    core or more, which is every large one, are returned as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

"""Rows out of collected JSON: API responses, feature documents, search requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantera.tables import SCHEMAS, spread

TAGS = "features.metadata.tags"


def _nested(path: str, leaf: str) -> str:
    """DDL of the struct that only declares `path`; the parser skips every other field."""
    for name in reversed(path.split(".")):
        leaf = f"STRUCT<`{name}`: {leaf}>"
    return leaf


def parsed_list(response: Column, path: str, fields: dict[str, str]) -> Column:
    """The list at `path` of a JSON text, with only the named fields of its elements."""
    schema = _nested(path, f"ARRAY<{_element(fields)}>")
    return _walk(F.from_json(response, F.lit(schema)), path)


def _walk(value: Column, path: str) -> Column:
    for name in path.split("."):
        value = value.getField(name)
    return value


def _element(fields: dict[str, str]) -> str:
    """DDL of one list element; the fields share their parent path."""
    parents = {name.rpartition(".")[0] for name in fields}
    if len(parents) != 1:
        raise ValueError("fields of one list must share a parent")
    leaves = ", ".join(f"`{name.rpartition('.')[2]}`: {kind}" for name, kind in fields.items())
    parent = parents.pop()
    return _nested(parent, f"STRUCT<{leaves}>") if parent else f"STRUCT<{leaves}>"


def explode_hits(
    responses: DataFrame, response: str, path: str, field: str, keep: Sequence[str] = (), into: str = "value"
) -> DataFrame:
    """One row per list element whose text `field` is neither null nor empty."""
    hits = parsed_list(F.col(response), path, {field: "STRING"})
    rows = responses.select(*keep, F.explode(hits).alias("_hit")).select(*keep, _walk(F.col("_hit"), field).alias(into))
    return rows.filter(F.col(into) != "")


def unusable(responses: DataFrame, response: str, path: str, keep: Sequence[str] = ()) -> DataFrame:
    """(`keep`, `reason`) of the responses that `explode_hits` can take nothing from, for the rejected rows.

    There is no text, it is no JSON, or it has no list at `path`; an empty list is an answer.
    """
    text = F.col(response)
    listed = F.try_variant_get(F.try_parse_json(text), f"$.{path}", "array<variant>")
    reason = (
        F.when(F.coalesce(text, F.lit("")) == "", "empty")
        .when(F.try_parse_json(text).isNull(), "no JSON")
        .when(listed.isNull(), "no list")
    )
    return responses.select(*keep, reason.alias("reason")).filter("reason IS NOT NULL")


def first_hit(
    responses: DataFrame, response: str, path: str, fields: dict[str, str], keep: Sequence[str] = ()
) -> DataFrame:
    """Fields of the first list element, null when the list is empty or absent."""
    first = responses.select(*keep, F.get(parsed_list(F.col(response), path, fields), F.lit(0)).alias("_hit"))
    return first.select(*keep, *[_walk(F.col("_hit"), f).alias(f.rpartition(".")[2]) for f in fields])


def flatten_features(documents: DataFrame, document: str) -> DataFrame:
    """(postgre_id, bpm, initialkey, genre) of raw feature documents that carry an id.

    Tags come as lists or as plain values; of a list the first entry counts. A tempo that is
    no number gives null.
    """
    tags = "STRUCT<bpm: STRING, initialkey: STRING, genre: STRING>"
    schema = f"STRUCT<postgre_id: BIGINT, features: STRUCT<metadata: STRUCT<tags: {tags}>>>"
    # Through a one-element list, so that the filter is not moved below the parse, which would repeat it.
    parsed = spread(documents.select(document)).select(F.explode(F.array(F.from_json(document, F.lit(schema)))).alias("d"))
    read = parsed.filter("d.postgre_id is not null").select(
        "d.postgre_id", *[F.col(f"d.{TAGS}.{t}").alias(t) for t in ("bpm", "initialkey", "genre")]
    )
    return read.select(
        "postgre_id",
        first_or_self(F.col("bpm")).try_cast("double").alias("bpm"),
        first_or_self(F.col("initialkey")).alias("initialkey"),
        first_or_self(F.col("genre")).alias("genre"),
    )


def first_or_self(tag: Column) -> Column:
    """The first entry of a JSON list given as text, or the text itself."""
    entries = F.from_json(tag, "ARRAY<STRING>")
    return F.when(tag.startswith("["), F.get(entries, F.lit(0))).otherwise(tag)


def parse_requests(df: DataFrame, request: str, keep: Sequence[str] = ()) -> DataFrame:
    """Search requests with an `error` column; an unset or empty filter is no constraint.

    Only JSON that cannot be read is invalid. Fields are read as text, so that a tempo may be
    any number; one that is no number sets no constraint.
    """
    schema = ", ".join(f"{column.split()[0]}: STRING" for column in SCHEMAS["requests"].split(", "))
    corrupt = {"columnNameOfCorruptRecord": "_broken"}
    fields = F.from_json(request, F.lit(f"STRUCT<{schema}, _broken: STRING>"), corrupt)
    parsed = df.select(*keep, F.col(request).alias("_raw"), fields.alias("_r"))
    blank = lambda name: F.nullif(F.col(f"_r.{name}"), F.lit("")).alias(name)
    error = F.when(F.col("_raw").isNull() | F.col("_r._broken").isNotNull(), F.lit("Invalid request")).when(
        F.coalesce(F.col("_r.query"), F.lit("")) == "", F.lit("Missing 'query' field")
    )
    return parsed.select(
        *keep,
        blank("query"),
        blank("genre"),
        blank("key"),
        F.nullif(F.col("_r.bpm").try_cast("double"), F.lit(0.0)).alias("bpm"),
        blank("artist_ref"),
        blank("title_ref"),
        error.alias("error"),
    )

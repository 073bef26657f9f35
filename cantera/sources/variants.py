"""Collected documents as VARIANT: parsed once when they land, read by path, and watched for drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cantera.sources.responses import first_or_self

# The paths a feature document is read by, and their types.
FEATURES = {
    "$.postgre_id": "bigint",
    "$.features.metadata.tags.bpm": "string",
    "$.features.metadata.tags.initialkey": "string",
    "$.features.metadata.tags.genre": "string",
}


def land(documents: DataFrame, document: str, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Write `keep`, `document` (VARIANT) and `raw` to `path`; the written table.

    Text that is no JSON stays as `raw`, with a null document; a null text has neither.
    """
    parsed = F.try_parse_json(F.col(document))
    rows = documents.select(*keep, parsed.alias("document"), F.when(parsed.isNull(), F.col(document)).alias("raw"))
    rows.write.mode("append").parquet(path)
    return documents.sparkSession.read.schema(rows.schema).parquet(path)


def read(spark: SparkSession, path: str, keep: str = "") -> DataFrame:
    return spark.read.schema(", ".join(filter(None, [keep, "document VARIANT", "raw STRING"]))).parquet(path)


def at(path: str, kind: str) -> Column:
    """The value at a path of `document`, null where there is none or it cannot be `kind`."""
    return F.try_variant_get("document", path, kind)


def flatten_features(landed: DataFrame) -> DataFrame:
    """(postgre_id, bpm, initialkey, genre) of landed feature documents that carry an id."""
    id, *tags = FEATURES
    names = [path.rpartition(".")[2] for path in tags]
    read = landed.select(at(id, "bigint").alias("postgre_id"), *[first_or_self(at(p, "string")).alias(n) for p, n in zip(tags, names)])
    return read.filter("postgre_id IS NOT NULL").withColumn("bpm", F.col("bpm").try_cast("double"))


def schema_of(landed: DataFrame, *by: str) -> DataFrame:
    """The schema that covers all documents of each group, merged as they are read."""
    return landed.groupBy(*by).agg(F.schema_of_variant_agg("document").alias("schema"), F.count("document").alias("documents"), F.count("raw").alias("broken"))


def drift(landed: DataFrame, expected: dict[str, str], *by: str) -> DataFrame:
    """One row per group and expected path: documents that have it, lack it, or have it as something else, and as what.

    A value drifted if it is there and neither of the expected type nor null. One pass.
    """
    counts = []
    for i, (path, kind) in enumerate(expected.items()):
        value = F.try_variant_get("document", path, "variant")
        there = value.isNotNull() & ~F.is_variant_null(value)
        found = F.schema_of_variant(value)
        drifted = there & (_family(found) != kind)
        counts += [
            F.count_if(there & ~drifted).alias(f"has_{i}"),
            F.count_if(F.col("document").isNotNull() & ~there).alias(f"lacks_{i}"),
            F.count_if(drifted).alias(f"drifted_{i}"),
            F.min(F.when(drifted, _family(found))).alias(f"seen_{i}"),
        ]
    rows = [
        F.struct(F.lit(path).alias("path"), *[F.col(f"{name}_{i}").alias(name) for name in ("has", "lacks", "drifted", "seen")])
        for i, path in enumerate(expected)
    ]
    return landed.groupBy(*by).agg(*counts).select(*by, F.inline(F.array(*rows)))


def _family(schema: Column) -> Column:
    """A schema's name without its elements, all exact numbers as one."""
    name = F.lower(F.regexp_extract(schema, "^[A-Za-z]+", 0))
    return F.when(name.isin("bigint", "int", "smallint", "tinyint"), "bigint").otherwise(name)

"""Table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed value: rows per round trip.
FETCH_SIZE = 1000


def jdbc_options(
    url: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int | None = None,
    fetch_size: int = FETCH_SIZE,
    **more: str,
) -> dict[str, str]:
    """Options of a JDBC scan, in `partitions` ranges of `partition_column`.

    Without a partition column the whole table comes through one connection, so a large
    table should name one with its bounds.
    """
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), **more}
    if partition_column:
        if not bounds or not partitions:
            raise ValueError("a partition column needs bounds and a number of partitions")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def scan_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **options)).load()


def scan_parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def scan_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed documents, one per line, read with a declared schema: no inference pass."""
    return spark.read.schema(schema).json(path)

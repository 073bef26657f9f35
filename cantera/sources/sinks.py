"""Written tables: overwrite, append, land once, and rejected rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantera.operators.relational import insert_absent


def write_vectors(df: DataFrame, path: str) -> None:
    """Replace the vectors at `path`, which must not be a table that `df` reads."""
    df.write.mode("overwrite").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def new_documents(landed: DataFrame, documents: DataFrame, id: str, order: Sequence[Column]) -> DataFrame:
    """The documents to land: ids not landed yet, each once. A document without id is none."""
    return insert_absent(landed, documents, [id], order, "drop")


def append_documents(documents: DataFrame, path: str) -> None:
    """Append documents as JSON lines."""
    documents.write.mode("append").json(path)


def split_rejected(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, rows that do not with the `reason`); `checks` maps reason to failure.

    The first failing check gives the reason. Both frames share the input, so a job that
    writes both should write the tagged rows once, partitioned by reason, or persist them.
    """
    tagged = tag_rejected(df, checks)
    return tagged.filter(F.col("reason").isNull()).drop("reason"), tagged.filter(F.col("reason").isNotNull())


def tag_rejected(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Add `reason`, null for rows that pass all checks."""
    reasons = [F.when(failed, F.lit(reason)) for reason, failed in checks.items()]
    return df.withColumn("reason", F.coalesce(*reasons, F.lit(None).cast("string")))

"""Names that contain a text, found through postings of their short substrings.

Every name is listed under each of its substrings of one to six characters, in lower case. A
text that is looked for is cut into its six-character substrings (a shorter one is one
substring), the lists of the rarest are intersected, and only the names on all of them are
read and compared. A search costs what its lists and its answer hold, not what the table holds;
up to six characters, the one list is the answer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LONGEST = 6
# Lists of a text that are intersected: the rarest ones.
LISTS = 4
# So many times as long as the shortest one a list may be to be worth it.
LONGER = 4
# Candidates that are read by their ids: as a filter, so many can be pushed down to the file.
READ_BY_ID = 200


@dataclass
class Index:
    """Stored names (`id`, `name`), postings (`gram`, `id`) in order, and the length of each list (`gram`, `n`)."""

    names: DataFrame
    postings: DataFrame
    lists: DataFrame


def grams(lowered: Column, lengths: range) -> Column:
    """The distinct substrings of these lengths."""
    def of(length: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.char_length(lowered) - (length - 1), F.lit(1)))
        return F.transform(places, lambda i: F.substring(lowered, i, F.lit(length)))

    each = [of(length) for length in lengths]
    # A name that is too short for a length gives a shorter piece, which another length has as well.
    return F.array_distinct(F.concat(*each))


def build(names: DataFrame, id: str, name: str, path: str) -> Index:
    """Write the index of a column under `path`; null names are not in it. Postings are spread over files by substring and id."""
    rows = names.filter(F.col(name).isNotNull()).select(F.col(id).alias("id"), F.col(name).alias("name"))
    rows.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{path}/names")
    kept = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/names")
    # Every name contains the empty text, which has a list like any other.
    pieces = F.array_union(F.array(F.lit("")), grams(F.lower("name"), range(1, LONGEST + 1)))
    postings = kept.select(F.explode(pieces).alias("gram"), "id").distinct()
    # Sorted by both: a list that a third of the names are on fills several files, and no task.
    postings.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.parquet(f"{path}/postings")
    stored = rows.sparkSession.read.schema(postings.schema).parquet(f"{path}/postings")
    stored.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/lists")
    return read(rows.sparkSession, path, rows.schema["id"].dataType.simpleString())


def read(spark: SparkSession, path: str, id_type: str) -> Index:
    return Index(
        spark.read.schema(f"id {id_type}, name string").parquet(f"{path}/names"),
        spark.read.schema(f"gram string, id {id_type}").parquet(f"{path}/postings"),
        spark.read.schema("gram string, n long").parquet(f"{path}/lists"),
    )


def contains(index: Index, wanted: DataFrame, key: str, part: str) -> DataFrame:
    """(`key`, `id`, `name`): the names that contain each wanted text, whatever the case; null texts ask nothing.

    An empty text is contained in every name.
    """
    asked = wanted.filter(F.col(part).isNotNull()).select(F.col(key).alias("_key"), F.lower(F.col(part)).alias("_part")).distinct()
    cut = F.when(F.char_length("_part") >= LONGEST, grams(F.col("_part"), range(LONGEST, LONGEST + 1))).otherwise(F.array("_part"))
    cuts = asked.select("_key", "_part", F.explode(cut).alias("gram"))
    sized = cuts.join(index.lists, "gram", "left")
    rarest = Window.partitionBy("_key", "_part").orderBy(F.asc_nulls_first("n"), "gram")
    # A substring that no name has leaves a list that nothing is on.
    chosen = sized.withColumn("_place", F.row_number().over(rarest)).withColumn("_least", F.min(F.coalesce("n", F.lit(0))).over(Window.partitionBy("_key", "_part")))
    # A list much longer than the shortest costs more than it leaves out.
    chosen = chosen.filter((F.col("_place") <= LISTS) & (F.coalesce("n", F.lit(0)) <= LONGER * F.col("_least")))
    chosen = chosen.withColumn("_lists", F.count(F.lit(1)).over(Window.partitionBy("_key", "_part"))).select("_key", "_part", "_lists", "gram")
    met = chosen.join(index.postings, "gram").groupBy("_key", "_part", "id").agg(F.count(F.lit(1)).alias("_on"), F.first("_lists").alias("_lists"))
    candidates = met.filter("_on = _lists").select("_key", "_part", "id")
    found = candidates.join(index.names, "id").filter(F.contains(F.lower("name"), F.col("_part")))
    return found.select("_key", "id", "name").withColumnRenamed("_key", key)


def look_up(index: Index, part: str, most: int = READ_BY_ID) -> DataFrame:
    """(`id`, `name`) of the names that contain one text.

    Its lists are read by name, which the stored order answers from few pages, and so are the
    candidates as long as they are at most `most`.
    """
    text = part.lower()
    if not text:
        return index.names
    pieces = sorted({text[i : i + LONGEST] for i in range(max(1, len(text) - LONGEST + 1))})
    known = {r.gram: r.n for r in index.lists.filter(F.col("gram").isin(pieces)).collect()}
    if len(known) < len(pieces):
        return index.names.filter(F.lit(False))
    rarest = [gram for gram in sorted(known, key=lambda gram: (known[gram], gram))[:LISTS] if known[gram] <= LONGER * min(known.values())]
    on = index.postings.filter(F.col("gram").isin(rarest)).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    candidates = on.filter(F.col("n") == len(rarest)).select("id")
    same = F.contains(F.lower("name"), F.lower(F.lit(part)))
    few = [r.id for r in candidates.limit(most + 1).collect()] if known[rarest[0]] <= most else None
    if few is not None and len(few) <= most:
        return index.names.filter(F.col("id").isin(few) & same)
    return index.names.join(candidates, "id", "left_semi").filter(same)

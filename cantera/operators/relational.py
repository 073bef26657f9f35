"""Loads, updates, deletes and existence checks, each over a whole batch.

Wherever a join only asks whether a key exists, the asked side is first reduced to its
distinct keys. That reduction starts before the shuffle, so a key that fills a third of the
asked table arrives as one row per task. The asking side may have such a key as well: Spark
splits it at run time, for which both sides have to be shuffled for the join itself
(`reshuffled`). Sides known to be unique by the key skip that second shuffle of keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantera.operators import paging

# Names that differ by case only are alike, accents make a difference.
NAMES_ALIKE = "UNICODE_CI"


def keys_of(df: DataFrame, keys: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """The distinct key values of `df`, renamed to `names`."""
    return df.select(*[F.col(k).alias(n) for k, n in zip(keys, names or keys)]).distinct()


def reshuffled(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rows, their place by `keys` forgotten.

    After an aggregation by the keys Spark would join in place, and then cannot split a
    partition whose other side is skewed. Only worth it for narrow rows.
    """
    return df.withColumns({k: F.greatest(k, k) for k in keys})


def existing(
    batch: DataFrame, target: DataFrame, keys: Sequence[str], target_keys: Sequence[str] | None = None, unique: bool = False
) -> DataFrame:
    """The rows of `batch` whose key is in `target`; null keys never are.

    `unique` says that no key of `batch` has very many rows.
    """
    return batch.join(_asked(target, keys, target_keys, unique), list(keys), "left_semi")


def absent(
    batch: DataFrame, target: DataFrame, keys: Sequence[str], target_keys: Sequence[str] | None = None, unique: bool = False
) -> DataFrame:
    """The rows of `batch` whose key is not in `target`; null keys never match, so they stay."""
    return batch.join(_asked(target, keys, target_keys, unique), list(keys), "left_anti")


def _asked(target: DataFrame, keys: Sequence[str], target_keys: Sequence[str] | None, unique: bool) -> DataFrame:
    asked = keys_of(target, target_keys or keys, keys)
    return asked if unique else reshuffled(asked, keys)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key. Spark cuts each key to one row per task before the shuffle."""
    place = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(place)).filter("_place = 1").drop("_place")


def insert_absent(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column], null_keys: str = "keep"
) -> DataFrame:
    """The rows to append: new keys only, the first of each by `order`.

    Equal to inserting one row after the other if absent. A null key equals nothing, so each
    such row is new, which takes a second look at the batch; `null_keys="drop"` leaves those
    rows out and is for batches that have none.
    """
    if null_keys not in ("keep", "drop"):
        raise ValueError(f"unknown null_keys {null_keys}")
    null_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    first = first_per_key(batch.filter(~null_key), keys, order)
    new = absent(first, target, keys, unique=True)
    return new if null_keys == "drop" else new.unionByName(batch.filter(null_key))


def ensure_columns(df: DataFrame, columns: dict[str, str], defaults: dict[str, object] | None = None) -> DataFrame:
    """Add the columns of {name: type} that are not there yet, as nulls or their default."""
    have = {row[1] for row in columns_of(df)}
    values = defaults or {}
    new = {n: F.lit(values.get(n)).cast(t) for n, t in columns.items() if n.lower() not in have}
    return df.withColumns(new) if new else df


def columns_of(df: DataFrame) -> list[tuple[int, str, str]]:
    """(position, lower-case name, type) of each column."""
    return [(i, f.name.lower(), f.dataType.simpleString()) for i, f in enumerate(df.schema, 1)]


def update_where(df: DataFrame, predicate: Column, values: dict[str, Column]) -> DataFrame:
    """Set columns where the predicate holds; where it is null nothing changes."""
    return df.withColumns({name: F.when(predicate, value).otherwise(F.col(name)) for name, value in values.items()})


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    """Drop the rows for which the predicate holds; where it is null they stay."""
    return df.filter(~F.coalesce(predicate, F.lit(False)))


def enrich(
    target: DataFrame,
    updates: DataFrame,
    key: str,
    order: Sequence[Column],
    overwrite: Sequence[str] = (),
    fill: Sequence[str] = (),
) -> DataFrame:
    """Set columns of the rows of `target` that have an update; the first update of a key by `order` counts.

    `overwrite` columns get what the update holds, nulls too; `fill` columns only a value.
    `target` keeps its rows, whatever the updates hold.
    """
    columns = [*overwrite, *fill]
    first = first_per_key(updates.filter(F.col(key).isNotNull()), [key], order)
    new = first.select(key, F.lit(True).alias("_matched"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = target.join(new, key, "left")
    values = {c: F.when(F.col("_matched"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in overwrite}
    values |= {c: F.coalesce(f"_new_{c}", c) for c in fill}
    return joined.withColumns(values).select(*target.columns)


def upsert(current: DataFrame, new: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """`current`, unique by key, with the rows of `new` inserted or replaced.

    The first row of each key in `new` by `order` counts. Stored rows are asked only whether
    `new` has their key: where those keys are few, they stay in place, and where they are not,
    they are shuffled once and not sorted with the new rows. Null keys are one key.
    """
    replaced = new.select(F.col(key).alias("_key")).distinct()
    kept = current.join(replaced, F.col(key).eqNullSafe(F.col("_key")), "left_anti")
    return kept.unionByName(first_per_key(new, [key], order))


def cascade_delete(
    deleted: DataFrame, levels: Sequence[tuple[DataFrame, str, str]]
) -> list[DataFrame]:
    """Survivors of each level after deleting `deleted`, a frame with the key of the first level.

    Each level is (rows, key, parent key); the first level's parent key is the deleted one.
    """
    survivors, gone, gone_key = [], deleted, deleted.columns[0]
    for rows, key, parent in levels:
        dead = reshuffled(keys_of(gone, [gone_key], ["_dead"]), ["_dead"])
        # One pass per level: unmarked rows survive, the marked ones are the next level's dead.
        marked = rows.join(dead, rows[parent] == dead["_dead"], "left")
        survivors.append(marked.filter("_dead IS NULL").drop("_dead"))
        gone, gone_key = marked.filter("_dead IS NOT NULL").drop("_dead"), key
    return survivors


def orphans(children: DataFrame, parent_key: str, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is missing; a null reference is no orphan."""
    return absent(children.filter(F.col(parent_key).isNotNull()), parents, [parent_key], [key])


def missing_lyrics(
    songs: DataFrame,
    lyrics: DataFrame,
    limit: int | None = None,
    offset: int = 0,
    after_id: int | None = None,
) -> DataFrame:
    """Songs without a non-null lyric, by id; pages with `limit`.

    `after_id` pages by key: it skips nothing when rows leave the set between two pages, and
    costs the same on every page.
    """
    held = lyrics.filter(F.col("letra").isNotNull())
    missing = absent(songs, held, ["id"], ["id_cancion"], unique=True)
    if after_id is not None:
        missing = missing.filter(F.col("id") > after_id)
    if limit is None:
        if offset:
            raise ValueError("an offset needs a limit; see paging.resume_by_position")
        return missing
    # An OFFSET would bring all rows before the page to one task; the key at its end is a filter.
    return paging.resume_by_position(missing, "id", offset).orderBy("id").limit(limit)


def song_artist(songs: DataFrame, artists: DataFrame) -> DataFrame:
    """Songs with the name of their artist."""
    names = artists.select(F.col("id").alias("id_artista"), "nombre")
    return songs.join(names, "id_artista")


def song_chain(artists: DataFrame, songs: DataFrame, lyrics: DataFrame) -> DataFrame:
    """Artist, song and lyric of every lyric."""
    words = lyrics.select(F.col("id_cancion").alias("id"), "letra")
    return song_artist(songs, artists).join(words, "id")


def collated(names: Sequence[str], collation: str = NAMES_ALIKE) -> list[Column]:
    """Keys that compare names by a collation: whatever the case, and with ICU's rules for letters like ς."""
    return [F.collate(F.col(n), collation).alias(n) for n in names]


def existing_by_name(batch: DataFrame, target: DataFrame, names: Sequence[str], collation: str = NAMES_ALIKE) -> DataFrame:
    """The rows of `batch` whose names are in `target`, compared by a collation; null names never are."""
    asked = target.select(*[c.alias(f"_{n}") for n, c in zip(names, collated(names, collation))]).distinct()
    same = reduce(lambda a, b: a & b, [F.collate(F.col(n), collation) == F.col(f"_{n}") for n in names])
    return batch.join(asked, same, "left_semi")


def absent_by_name(batch: DataFrame, target: DataFrame, names: Sequence[str], order: Sequence[Column], collation: str = NAMES_ALIKE) -> DataFrame:
    """The rows of `batch` to append: names that `target` does not have, of each the first by `order`."""
    asked = target.select(*[c.alias(f"_{n}") for n, c in zip(names, collated(names, collation))]).distinct()
    same = reduce(lambda a, b: a & b, [F.collate(F.col(n), collation) == F.col(f"_{n}") for n in names])
    fresh = batch.filter(reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])).join(asked, same, "left_anti")
    place = Window.partitionBy(*[F.collate(F.col(n), collation) for n in names]).orderBy(*order, *names)
    return fresh.withColumn("_place", F.row_number().over(place)).filter("_place = 1").drop("_place")


def name_contains(df: DataFrame, parts: dict[str, str]) -> DataFrame:
    """Rows whose columns contain the given texts, whatever the case."""
    like = {c: f"%{_escaped(part)}%" for c, part in parts.items()}
    return df.filter(reduce(lambda a, b: a & b, [F.col(c).ilike(p) for c, p in like.items()]))


def _escaped(part: str) -> str:
    return part.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def pending(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """The rows that still lack a value."""
    rows = df.filter(F.col(column).isNull())
    return rows if limit is None else rows.limit(limit)


def pending_stages(df: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    """(stage, key): a row for each of `columns` that a row still lacks, in one pass."""
    stages = [F.when(F.col(c).isNull(), F.lit(c)) for c in columns]
    return df.select(F.explode(F.array_compact(F.array(*stages))).alias("stage"), key)


def present(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def publish_queue(songs: DataFrame, published: DataFrame, key: str, vectors: Sequence[str]) -> DataFrame:
    """Songs with all their vectors that have not been published."""
    complete = reduce(lambda a, b: a & b, [F.col(v).isNotNull() for v in vectors])
    return absent(songs.filter(complete), published, [key], unique=True)

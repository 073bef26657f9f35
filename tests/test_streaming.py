import pytest
from pyspark.sql import functions as F

from cantera.session import new_path
from cantera.streaming import progress, publish
from cantera.tables import SCHEMAS

SONG = SCHEMAS["lyrics_database"]
NAMES = [column.split()[0] for column in SONG.split(", ")]


def songs(spark, *rows):
    base = dict.fromkeys(NAMES)
    full = [{**base, "letra_vec": [1.0, 0.0], **row} for row in rows]
    return spark.createDataFrame([tuple(r[n] for n in NAMES) for r in full], SONG)


def song(id, title, patches):
    return {"id": id, "cancion": title, "track_vector": patches}


@pytest.fixture()
def places(spark):
    return new_path(spark, "source"), new_path(spark, "target"), new_path(spark, "checkpoint")


def run(spark, places, **options):
    source, target, checkpoint = places
    publish.publish_available(spark, source, SONG, target, checkpoint, **options)
    return {r.id: (r.payload.title, r.track_vector) for r in publish.published(spark, target).collect()}


def batches(spark, target):
    return publish._log(spark, target).select("run", "batch").distinct().count()


def test_publish_again_changes_nothing_and_a_changed_song_replaces(spark, places):
    source, target, _ = places
    songs(spark, song(1, "one", [[1.0], [3.0]]), song(2, "two", [[5.0]])).write.mode("append").parquet(source)
    assert run(spark, places) == {1: ("one", [2.0]), 2: ("two", [5.0])}
    done = batches(spark, target)
    assert run(spark, places) == {1: ("one", [2.0]), 2: ("two", [5.0])}
    assert batches(spark, target) == done
    songs(spark, song(2, "two, new", [[7.0]]), song(3, "three", [[8.0]])).write.mode("append").parquet(source)
    assert run(spark, places) == {1: ("one", [2.0]), 2: ("two, new", [7.0]), 3: ("three", [8.0])}


def test_the_largest_version_counts_and_widths_are_kept(spark, places):
    source, target, _ = places
    first = songs(spark, song(1, "new", [[1.0]]), song(2, "two", [[5.0]]), song(2, "two b", [[6.0]])).withColumn("v", F.lit(2))
    old = songs(spark, song(1, "old", [[3.0]])).withColumn("v", F.lit(1))
    first.unionByName(old).coalesce(1).write.parquet(source)
    publish.publish_available(spark, source, f"{SONG}, v INT", target, places[2], version="v")
    got = {r.id: r.payload.title for r in publish.published(spark, target).collect()}
    assert got == {1: "new", 2: "two b"}
    # A later run with an older version replaces nothing; another width is rejected.
    songs(spark, song(1, "older", [[4.0]]), song(3, "wide", [[1.0, 2.0]])).withColumn("v", F.lit(0)).write.mode("append").parquet(source)
    publish.publish_available(spark, source, f"{SONG}, v INT", target, places[2], version="v")
    assert {r.id: r.payload.title for r in publish.published(spark, target).collect()} == got
    assert {r.id for r in publish.rejected(spark, target).collect()} == {3}


def test_files_are_taken_in_batches(spark, places):
    source, target, _ = places
    songs(spark, *[song(i, f"s{i}", [[1.0]]) for i in range(8)]).repartition(4).write.parquet(source)
    assert len(run(spark, places, max_files=1)) == 8
    assert batches(spark, target) == 4


def test_rejected_rows_do_not_stop_the_run(spark, places):
    source, target, _ = places
    songs(spark, song(1, "good", [[1.0, 2.0]]), song(2, "ragged", [[1.0, 2.0], [3.0]]), song(3, "empty", [])).write.parquet(source)
    assert set(run(spark, places)) == {1}
    assert {r.id for r in publish.rejected(spark, target).collect()} == {2, 3}


def test_new_checkpoint_publishes_again_without_duplicates(spark, places):
    source, target, _ = places
    songs(spark, song(1, "one", [[1.0]]), song(2, "two", [[2.0]])).write.parquet(source)
    first = run(spark, places)
    again = run(spark, (source, target, new_path(spark, "checkpoint")))
    assert first == again and batches(spark, target) == 2


def test_publishing_goes_on_after_compaction(spark, places):
    source, target, checkpoint = places
    for title in ("a", "b"):
        songs(spark, song(1, title, [[1.0]]), song(2, title, [[2.0]])).write.mode("append").parquet(source)
        run(spark, places)
    base, later = new_path(spark, "base"), new_path(spark, "target")
    publish.compact(spark, target, base)
    titles = lambda: {r.id: r.payload.title for r in publish.published(spark, later, base).collect()}
    assert spark.read.parquet(base).count() == 2 and titles() == {1: "b", 2: "b"}
    songs(spark, song(2, "c", [[2.0]]), song(3, "c", [[3.0]])).write.mode("append").parquet(source)
    publish.publish_available(spark, source, SONG, later, checkpoint)
    assert titles() == {1: "b", 2: "c", 3: "c"} and publish._log(spark, later).count() == 2
    again = new_path(spark, "base")
    publish.compact(spark, later, again, base)
    assert spark.read.parquet(again).count() == 3


def test_nothing_published_yet(spark):
    assert publish.published(spark, new_path(spark, "none")).count() == 0


LYRIC = f"{SONG}, v INT, at TIMESTAMP"
TRACK = "id LONG, track_vector ARRAY<FLOAT>, v INT, at TIMESTAMP"


class Arrivals:
    """Two folders that lyrics and tracks arrive in; every run takes what came since the last one."""

    def __init__(self, spark, **options):
        self.spark, self.options = spark, options
        self.lyrics, self.tracks, self.target, self.checkpoint, self.counts = (new_path(spark, n) for n in ("lyrics", "tracks", "target", "checkpoint", "counts"))
        self.come([], [])

    def come(self, lyrics, tracks):
        from datetime import datetime

        day = lambda n: datetime(2025, 1, 1 + n)
        rows = [{"id": i, "cancion": title, "letra_vec": vector, "v": v, "at": day(at)} for i, title, vector, v, at in lyrics]
        names = [c.split()[0] for c in LYRIC.split(", ")]
        self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], LYRIC).coalesce(1).write.mode("append").parquet(self.lyrics)
        self.spark.createDataFrame([(i, x, v, day(at)) for i, x, v, at in tracks], TRACK).coalesce(1).write.mode("append").parquet(self.tracks)

    def run(self):
        read = lambda schema, path: self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        publish.publish_pairs(
            read(LYRIC, self.lyrics), read(TRACK, self.tracks), self.target, self.checkpoint,
            version="v", track_version="v", counts=self.counts, arrived="at", **self.options,
        ).awaitTermination()
        return {r.id: (r.payload.title, r.track_vector, r.lyrics_vector) for r in publish.published(self.spark, self.target).collect()}


def test_second_vectors_may_come_batches_and_runs_later(spark):
    songs = Arrivals(spark, widths={"track_vector": 1, "lyrics_vector": 1})
    songs.come([(1, "one", [1.0], 0, 0), (2, "two", None, 0, 0)], [(3, [3.0], 0, 0), (4, None, 0, 0)])
    assert songs.run() == {}
    songs.come([(5, "five", [5.0], 0, 1)], [])
    songs.come([(6, "six", [6.0], 0, 1)], [])
    assert songs.run() == {}
    # Two runs and three batches later; a song that was never halved comes whole.
    songs.come([(3, "three", [3.0], 0, 2), (7, "seven", [7.0], 0, 2)], [(1, [1.0], 0, 2), (7, [7.0], 0, 2)])
    one = {1: ("one", [1.0], [1.0]), 3: ("three", [3.0], [3.0]), 7: ("seven", [7.0], [7.0])}
    assert songs.run() == one
    assert songs.run() == one
    songs.come([(2, "two", [2.0], 0, 3), (4, "four", [4.0], 0, 3)], [(4, [4.0], 0, 3), (5, [5.0, 5.0], 0, 3)])
    assert set(songs.run()) == {1, 3, 4, 7}
    assert [r.id for r in publish.rejected(spark, songs.target).collect()] == [5]
    held = [spark.read.schema(schema).parquet(path) for schema, path in ((LYRIC, songs.lyrics), (TRACK, songs.tracks))]
    assert {(r.id, r.lacks) for r in publish.waiting(*held).collect()} == {(2, "track_vector"), (6, "track_vector")}
    # The rejected half is replaced by one that fits.
    songs.come([], [(5, [5.0], 1, 4)])
    assert songs.run()[5] == ("five", [5.0], [5.0])
    counts = publish.published_counts(spark, songs.counts).groupBy().sum("processed", "published", "rejected").first()
    assert tuple(counts) == (6, 5, 1)


def test_newest_halves_count_in_any_order(spark):
    songs = Arrivals(spark)
    songs.come([(1, "new", [2.0], 2, 0)], [(1, [20.0], 2, 0)])
    assert songs.run() == {1: ("new", [20.0], [2.0])}
    songs.come([(1, "old", [1.0], 1, 1)], [(1, [10.0], 1, 1)])
    assert songs.run() == {1: ("new", [20.0], [2.0])}
    songs.come([], [(1, [30.0], 3, 2)])
    songs.come([(1, "newest", [3.0], 3, 2)], [])
    assert songs.run() == {1: ("newest", [30.0], [3.0])}


def test_state_is_cleared_of_halves_that_waited_too_long(spark):
    songs = Arrivals(spark, wait="2 days")
    songs.come([(1, "one", [1.0], 0, 0), (2, "two", [2.0], 0, 0)], [(9, [9.0], 0, 0)])
    songs.come([], [(1, [1.0], 0, 1)])
    assert set(songs.run()) == {1}
    for day in (10, 11):
        songs.come([(10 + day, "late", [1.0], 0, day)], [(10 + day, [1.0], 0, day)])
        songs.run()
    songs.come([], [(2, [2.0], 0, 10)])
    assert set(songs.run()) == {1, 20, 21}


def test_counts_are_one_row_per_batch_and_repeat_safely(spark, places):
    source, target, checkpoint = places
    counts = new_path(spark, "counts")
    assert publish.published_counts(spark, counts).count() == 0
    for n in range(2):
        songs(spark, song(n, "good", [[1.0, 2.0]]), song(10 + n, "empty", []), song(20 + n, "ragged", [[1.0], [1.0, 2.0]])).coalesce(1).write.mode("append").parquet(source)
        run(spark, places, counts=counts)
        run(spark, places, counts=counts)
    rows = publish.published_counts(spark, counts).drop("run").orderBy("batch").collect()
    assert [tuple(r) for r in rows] == [(0, 3, 1, 2), (1, 3, 1, 2)]


def until(told, seconds=30):
    """Events of streams come by themselves, soon after what they tell."""
    import time

    end = time.time() + seconds
    while not told() and time.time() < end:
        time.sleep(0.1)
    assert told()


def test_counters_tell_while_streams_run_and_how_they_end(spark, places):
    from cantera.streaming.counters import RunCounters

    source, target, checkpoint = places
    counters = RunCounters()
    spark.streams.addListener(counters)
    try:
        songs(spark, *[song(i, f"s{i}", [[1.0]]) for i in range(9)]).repartition(3).write.parquet(source)
        query = publish.publish_stream(spark, source, SONG, target, checkpoint, max_files=1)
        query.awaitTermination()
        run = str(query.runId)
        until(lambda: run in counters.totals() and not counters.totals()[run][2])
        assert counters.totals()[run] == (3, 9, False, None)

        def broken(batch):
            raise ValueError("no model")

        query = publish.publish_stream(spark, source, SONG, target, new_path(spark, "checkpoint"), prepare=broken)
        with pytest.raises(Exception, match="no model"):
            query.awaitTermination()
        failed = str(query.runId)
        until(lambda: failed in counters.totals() and not counters.totals()[failed][2])
        rows = {r.run: r for r in counters.table(spark).collect()}
        assert rows[failed].rows == 0 and "no model" in rows[failed].error and rows[run].rows == 9
    finally:
        spark.streams.removeListener(counters)


def test_vectors_of_the_first_batch_are_made_once(spark, places):
    """The widths come from what was written, not from a second pass over the lyrics."""
    source, target, checkpoint = places
    songs(spark, *[song(i, f"s{i}", [[1.0]]) for i in range(20)]).coalesce(1).write.parquet(source)
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<float>")
    def encode(title):
        made.add(1)
        return [1.0, 2.0]

    assert len(run(spark, places, prepare=lambda batch: batch.withColumn("letra_vec", encode.asNondeterministic()("cancion")))) == 20
    assert made.value == 20


UPDATES = "task_type STRING, current_offset INT, total_items INT, last_processed_id INT, status STRING, error_message STRING, updated_at TIMESTAMP_NTZ, n INT"


def updates(spark):
    from datetime import datetime

    at = datetime(2025, 1, 1)
    rows = [
        ("artistas", 100, 500, None, None, None, at, 1),
        ("artistas", 200, None, 7, "done", "slow", at, 2),
        ("artistas", 300, None, None, None, None, at, 3),
        ("letras", 5, None, 1, "failed", "boom", at, 4),
    ]
    return spark.createDataFrame(rows, UPDATES)


WANT = {"artistas": (300, 500, None, "running", None), "letras": (5, None, 1, "failed", "boom")}
FIELDS = ("current_offset", "total_items", "last_processed_id", "status", "error_message")


def as_dict(df):
    return {r.task_type: tuple(r[f] for f in FIELDS) for r in df.collect()}


def test_progress_keeps_only_the_total(spark):
    assert as_dict(progress.latest_progress(updates(spark), ["n"])) == WANT


def test_progress_of_a_stage_without_row(spark):
    latest = progress.latest_progress(updates(spark), ["n"])
    stages = spark.createDataFrame([("artistas",), ("letras",), ("vectors",)], "task_type STRING")
    got = as_dict(progress.read_progress(latest, stages))
    assert got == {**WANT, "vectors": (0, 0, None, "running", None)}


def test_progress_stream_adds_up_over_batches(spark):
    source, target, checkpoint = (new_path(spark, name) for name in ("updates", "progress", "checkpoint"))
    for n in range(1, 5):
        updates(spark).filter(F.col("n") == n).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(UPDATES).parquet(source)
        progress.progress_stream(stream, ["n"], target, checkpoint).awaitTermination()
    assert as_dict(progress.streamed_progress(spark, target, stream, ["n"])) == WANT


def test_two_progress_streams_share_a_target(spark):
    source, target = new_path(spark, "updates"), new_path(spark, "progress")
    assert as_dict(progress.streamed_progress(spark, target, updates(spark), ["n"])) == {}
    updates(spark).write.parquet(source)
    for stage in ("artistas", "letras"):
        stream = spark.readStream.schema(UPDATES).parquet(source).filter(F.col("task_type") == stage)
        progress.progress_stream(stream, ["n"], target, new_path(spark, "checkpoint")).awaitTermination()
    assert as_dict(progress.streamed_progress(spark, target, stream, ["n"])) == WANT


def test_batches_that_are_counted_come_in_several_files(spark, tmp_path, monkeypatch):
    from cantera.plans import stream_queries

    ids = spark.range(40)
    docs = ids.selectExpr("id AS doc_id", "concat('text ', id) AS text", "'en' AS lang", "'s' AS source")
    docs.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    ids.selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic").write.parquet(str(tmp_path / "labels.parquet"))
    ids.filter("id < 30").selectExpr("id AS vec_id", "array(1f, 2f) AS embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(stream_queries, "new_path", lambda spark, name: str(tmp_path / "work" / name))
    rows = stream_queries.stream_counts(spark, str(tmp_path)).collect()
    assert sorted((r.batch, r.processed, r.published, r.rejected) for r in rows) == [(0, 20, 15, 5), (1, 20, 15, 5)]
    assert len(list((tmp_path / "work" / "songs").glob("*.parquet"))) > 2

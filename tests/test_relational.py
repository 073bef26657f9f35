import random

import pytest
from pyspark.sql import functions as F

from cantera.operators import paging, quality
from cantera.operators import relational as R
from cantera.plans import catalogue
from cantera.tables import SCHEMAS

ARTISTS = [(1, "Artist One"), (2, "Artist Two"), (3, "Artist Three")]
SONGS = [(11, 1, "Song 1"), (12, 1, "Song 2"), (13, 1, "Song 3"), (21, 2, "Song 4"), (99, None, "Stray")]
LYRICS = [(11, "Line 1\nLine 2"), (12, None), (12, None), (13, "x"), (13, "x")]


@pytest.fixture(scope="module")
def tables(spark):
    return (
        spark.createDataFrame(ARTISTS, "id BIGINT, nombre STRING"),
        spark.createDataFrame(SONGS, "id BIGINT, id_artista BIGINT, cancion STRING"),
        spark.createDataFrame(LYRICS, "id_cancion BIGINT, letra STRING"),
    )


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_existing_and_absent_split_the_batch(spark, tables):
    _, songs, lyrics = tables
    assert ids(R.existing(songs, lyrics, ["id"], ["id_cancion"])) == [11, 12, 13]
    assert ids(R.absent(songs, lyrics, ["id"], ["id_cancion"])) == [21, 99]


def test_null_keys_never_match(spark, tables):
    artists, songs, _ = tables
    with_null = artists.unionByName(spark.createDataFrame([(None, "x")], "id BIGINT, nombre STRING"))
    assert ids(R.existing(songs, with_null, ["id_artista"], ["id"])) == [11, 12, 13, 21]
    assert ids(R.absent(songs, with_null, ["id_artista"], ["id"])) == [99]


def sequential_insert(stored, batch):
    """Insert if absent, one row after the other."""
    have, new = {key for key in stored if key is not None}, []
    for name, page in batch:
        if name is None or name not in have:
            new.append((name, page))
            have.add(name)
    return new


@pytest.mark.parametrize("seed", range(3))
def test_insert_absent_equals_one_by_one(spark, seed):
    pick = random.Random(seed)
    stored = [pick.choice([None, *"abcd"]) for _ in range(3)]
    # A third of the batch is one new key.
    batch = [("hot" if pick.random() < 0.34 else pick.choice([None, *"abcdefg"]), page) for page in range(60)]
    fresh = R.insert_absent(
        spark.createDataFrame([(s,) for s in stored], "nombre STRING"),
        spark.createDataFrame(batch, "nombre STRING, page INT"),
        ["nombre"],
        [F.asc("page")],
    )
    assert sorted(map(tuple, fresh.collect()), key=repr) == sorted(sequential_insert(stored, batch), key=repr)


def test_insert_absent_on_two_keys(spark):
    stored = spark.createDataFrame([(1, "A")], "id_artista INT, cancion STRING")
    batch = spark.createDataFrame([(1, "A", 1), (1, "a", 2), (2, "A", 3), (2, "A", 4)], "id_artista INT, cancion STRING, n INT")
    fresh = R.insert_absent(stored, batch, ["id_artista", "cancion"], [F.asc("n")])
    assert sorted(map(tuple, fresh.collect())) == [(1, "a", 2), (2, "A", 3)]


def test_missing_lyrics_and_pages(spark, tables):
    _, songs, lyrics = tables
    assert ids(R.missing_lyrics(songs, lyrics)) == [12, 21, 99]
    assert [r.id for r in R.missing_lyrics(songs, lyrics, limit=2).collect()] == [12, 21]
    assert [r.id for r in R.missing_lyrics(songs, lyrics, limit=2, offset=2).collect()] == [99]
    assert [r.id for r in R.missing_lyrics(songs, lyrics, limit=2, after_id=12).collect()] == [21, 99]
    with pytest.raises(ValueError):
        R.missing_lyrics(songs, lyrics, offset=5)


def test_chain(spark, tables):
    chain = R.song_chain(*tables).orderBy("cancion").select("nombre", "cancion", "letra").collect()
    assert [r.cancion for r in chain] == ["Song 1", "Song 2", "Song 2", "Song 3", "Song 3"]
    assert {r.nombre for r in chain} == {"Artist One"}


def test_cascade(spark, tables):
    artists, songs, lyrics = tables
    deleted = spark.createDataFrame([(1,)], "id BIGINT")
    left = R.cascade_delete(deleted, [(artists, "id", "id"), (songs, "id", "id_artista"), (lyrics, "id_cancion", "id_cancion")])
    assert ids(left[0]) == [2, 3] and ids(left[1]) == [21, 99] and ids(left[2], "id_cancion") == []


def test_orphans(spark, tables):
    artists, songs, _ = tables
    assert ids(R.orphans(songs, "id_artista", artists, "id")) == []
    assert ids(R.orphans(songs, "id_artista", artists.filter("id <> 2"), "id")) == [21]


def test_enrich_modes(spark):
    target = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, None, 3.0)], "id INT, mbid STRING, bpm DOUBLE")
    updates = spark.createDataFrame([(1, None, None), (3, "c", 9.0), (7, "z", 7.0)], "id INT, mbid STRING, bpm DOUBLE")
    order = [F.desc("bpm")]
    over = sorted(map(tuple, R.enrich(target, updates, "id", order, ["mbid", "bpm"]).collect()))
    assert over == [(1, None, None), (2, "b", 2.0), (3, "c", 9.0)]
    keep = sorted(map(tuple, R.enrich(target, updates, "id", order, fill=["mbid", "bpm"]).collect()))
    assert keep == [(1, "a", 1.0), (2, "b", 2.0), (3, "c", 9.0)]
    twice = updates.unionByName(updates.selectExpr("id", "'older' AS mbid", "-1D AS bpm"))
    both = sorted(map(tuple, R.enrich(target, twice, "id", order, ["bpm"], ["mbid"]).collect()))
    assert both == [(1, "older", -1.0), (2, "b", 2.0), (3, "c", 9.0)]


def test_upsert_twice_is_upsert_once(spark):
    schema = "id INT, v STRING, n INT"
    current = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], schema)
    new = spark.createDataFrame([(2, "B", 1), (3, "c", 1), (3, "d", 2)], schema)
    once = R.upsert(current, new, "id", [F.desc("n")])
    want = [(1, "a", 0), (2, "B", 1), (3, "d", 2)]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, R.upsert(once, new, "id", [F.desc("n")]).collect())) == want


def test_update_and_delete_leave_nulls_alone(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id INT, name STRING")
    updated = R.update_where(df, F.col("name") == "a", {"name": F.lit("z")})
    assert sorted(map(tuple, updated.collect())) == [(1, "z"), (2, None), (3, "b")]
    assert ids(R.delete_where(df, F.col("name") == "a")) == [2, 3]


def test_ensure_columns(spark):
    df = spark.createDataFrame([(1, "x")], "id INT, Genre STRING")
    full = R.ensure_columns(df, {"genre": "string", "bpm": "double", "done": "boolean"}, {"done": False})
    assert R.columns_of(full) == [(1, "id", "int"), (2, "genre", "string"), (3, "bpm", "double"), (4, "done", "boolean")]
    assert tuple(full.first()) == (1, "x", None, False)
    assert R.ensure_columns(full, {"BPM": "double"}).columns == full.columns


def test_contains_takes_wildcards_as_text(spark):
    df = spark.createDataFrame([("100% Love",), ("100 Love",), ("under_score",)], "t STRING")
    assert R.name_contains(df, {"t": "100% l"}).count() == 1
    assert R.name_contains(df, {"t": "R_S"}).count() == 1


def test_pending_present_and_queue(spark):
    df = spark.createDataFrame([(1, [1.0], "x"), (2, None, "y"), (3, [2.0], None), (4, [3.0], "z")], "id INT, v ARRAY<FLOAT>, w STRING")
    assert ids(R.pending(df, "v")) == [2] and ids(R.present(df, "v")) == [1, 3, 4]
    assert R.pending(df, "v", limit=10).count() == 1
    done = spark.createDataFrame([(4,)], "id INT")
    assert ids(R.publish_queue(df, done, "id", ["v", "w"])) == [1]


@pytest.mark.parametrize("done", [0, 1, 499, 1000, 1999, 2000, 5000])
def test_resume_by_position(spark, done):
    # Keys bunch together, so equal-width ranges would be of very unequal size.
    keys = list(range(1500)) + [10**12 + 7 * i for i in range(500)]
    df = spark.createDataFrame([(k,) for k in random.Random(3).sample(keys, len(keys))], "id BIGINT").repartition(7)
    assert ids(paging.resume_by_position(df, "id", done)) == sorted(keys)[done:]


def test_resume_by_key_redoes_the_last(spark):
    df = spark.createDataFrame([(2, 5), (1, 1), (2, 3), (3, 9)], "a INT, id INT")
    assert [tuple(r) for r in paging.resume_by_key(df, "a", 2, "id").collect()] == [(2, 3), (2, 5), (3, 9)]
    assert paging.resume_by_key(df, "a", None).count() == 4


def test_gate_counts(spark):
    report = quality.stage_gate({"artistas": (spark.range(99), 100), "canciones": (spark.range(10), 10)})
    assert sorted(map(tuple, report.collect())) == [("artistas", 99, 100, False), ("canciones", 10, 10, True)]


def test_run_report_and_observation(spark):
    data = [(1, True, True, "abc", None), (2, True, False, "de", None), (3, False, False, None, "not found")]
    outcomes = spark.createDataFrame(data, "id INT, saved BOOLEAN, is_new BOOLEAN, letra STRING, reason STRING")
    report = quality.run_report(outcomes).first()
    assert tuple(report) == (3, 2, 1, 1, 5) and report.processed == report.saved + report.failed
    assert [tuple(r) for r in quality.failures(outcomes, "id").collect()] == [(3, "not found")]
    observed, counters = quality.observe_run(outcomes)
    observed.write.format("noop").mode("overwrite").save()
    assert counters.get == {"processed": 3, "saved": 2, "failed": 1}


def test_rates(spark):
    df = spark.range(100).select(F.when(F.col("id") < 95, F.col("id")).alias("x"))
    assert quality.completeness(df, ["x"]).first()["x_pct"] == 95.0
    one = spark.createDataFrame([(5, 100), (0, 0)], "f INT, n INT").select(quality.rate(F.col("f"), F.col("n")).alias("r"))
    assert [None if r.r is None else float(r.r) for r in one.collect()] == [5.0, None]


def test_duplicates_and_variants(spark):
    df = spark.createDataFrame([("A",), ("B",), ("A",)], "name STRING")
    assert [tuple(r) for r in quality.duplicate_keys(df, "name").collect()] == [("A", 2)]
    beatles = spark.createDataFrame([("The Beatles",), ("the beatles",), ("THE BEATLES",), ("Solo",), (None,)], "name STRING")
    assert beatles.distinct().filter("name is not null").count() == 4
    assert [tuple(r) for r in quality.case_variants(beatles, "name").collect()] == [("the beatles", 3, 3)]


def test_rules(spark):
    data = [("t", "a", "one\ntwo", "1"), ("", "a", "short", "x"), (None, None, "long enough to be a lyric", None)]
    df = spark.createDataFrame(data, "title STRING, artist STRING, lyric STRING, year STRING")
    rules = quality.song_rules("title", "artist", "lyric", ["artist", "year"], {"year": "int"})
    got = {r.rule: (r.passed, r.failed) for r in quality.dq_report(df, rules).collect()}
    assert got == {
        "title_filled": (1, 2),
        "artist_filled": (2, 1),
        "lyric_filled": (3, 0),
        "lyric_plausible": (2, 1),
        "artist_present": (2, 1),
        "year_present": (2, 1),
        "year_is_int": (2, 1),
    }


def test_collection_from_responses(spark):
    stored = spark.createDataFrame([(1, "A")], "id BIGINT, nombre STRING")
    pages = spark.createDataFrame(
        [('{"artists":[{"name":"A"},{"name":"B"}]}', "q", 0), ('{"artists":[{"name":"B"},{"name":"C"}]}', "q", 1)],
        "body STRING, query STRING, page INT",
    )
    fresh = catalogue.new_artists(stored, pages, "body", "query")
    assert sorted(r.nombre for r in fresh.collect()) == ["B", "C"]
    found = spark.createDataFrame(
        [(1, "A", '{"response":{"hits":[{"result":{"title":"x"}},{"result":{"title":"x"}},{"result":{"title":""}},{"result":{"title":"y"}}]}}')],
        "id_artista BIGINT, artista STRING, body STRING",
    )
    songs = spark.createDataFrame([(1, "y")], "id_artista BIGINT, cancion STRING")
    assert [r.cancion for r in catalogue.new_songs(songs, found, "body").collect()] == ["x"]


def test_schemas_are_readable(spark):
    for name, ddl in SCHEMAS.items():
        assert spark.createDataFrame([], ddl).columns, name


@pytest.fixture()
def splitting(spark):
    """Thresholds at which Spark splits a hot key already in a small test."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def stored(spark, tmp_path, name, df):
    df.repartition(8).write.parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


@pytest.mark.parametrize("operator", [R.existing, R.absent])
def test_hot_key_on_either_side(spark, splitting, tmp_path, operator):
    """A third of both tables is one key: the asked side shrinks, the asking side is split."""
    hot = F.when(F.col("id") % 3 == 0, F.lit(4)).otherwise(F.col("id"))
    batch = stored(spark, tmp_path, "batch", spark.range(300000).select(hot.alias("k"), F.col("id").alias("v")))
    target = stored(spark, tmp_path, "target", spark.range(0, 300000, 2).select(hot.alias("k")))
    result = operator(batch, target, ["k"]).agg(F.count("v").alias("n"))
    n = result.collect()[0].n
    there = {4 if i % 3 == 0 else i for i in range(0, 300000, 2)}
    want = sum((4 if i % 3 == 0 else i) in there for i in range(300000))
    assert n == (want if operator is R.existing else 300000 - want)
    assert "skew=true" in result._jdf.queryExecution().executedPlan().toString()


def test_song_artist_splits_a_hot_artist(spark, splitting, tmp_path):
    hot = F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 5000)
    songs = stored(spark, tmp_path, "songs", spark.range(300000).select("id", hot.alias("id_artista"), F.lit("t").alias("cancion")))
    artists = stored(spark, tmp_path, "artists", spark.range(5000).select("id", F.col("id").cast("string").alias("nombre")))
    result = R.song_artist(songs, artists).agg(F.count("nombre").alias("n"), F.sum("id"))
    assert result.collect()[0].n == 300000
    assert "skew=true" in result._jdf.queryExecution().executedPlan().toString()


def test_the_first_source_with_a_lyric_counts(spark):
    """Whatever a later source holds, even if its lyric sorts first; the source is named."""
    from cantera.plans.catalogue import process_missing

    songs = spark.createDataFrame([(i,) for i in range(7)], "id LONG")
    held = spark.createDataFrame([(6, "there")], "id_cancion LONG, letra STRING")
    full, none, broken = '{"lyrics": "%s"}', '{"title": "x"}', '{"lyrics": "cut'
    rows = [
        (0, full % "z first", "lyrics.ovh", 1), (0, full % "a second", "genius", 2),
        (1, none, "lyrics.ovh", 1), (1, full % "a second", "genius", 2),
        (2, broken, "lyrics.ovh", 1), (2, none, "genius", 2),
        (3, None, "lyrics.ovh", 1), (3, full % "unranked", "other", None),
        (4, full % "two", "lyrics.ovh", 1), (4, full % "one", "lyrics.ovh", 1),
        (6, full % "held already", "lyrics.ovh", 1),
    ]
    bodies = spark.createDataFrame(rows, "id LONG, body STRING, source STRING, priority INT")
    got = {r.id: tuple(r)[1:] for r in process_missing(songs, held, bodies, "body").collect()}
    assert got == {
        0: ("z first", "lyrics.ovh", True, None), 1: ("a second", "genius", True, None), 2: (None, None, False, "no lyric"),
        3: ("unranked", "other", True, None), 4: ("one", "lyrics.ovh", True, None), 5: (None, None, False, "not tried"),
    }


@pytest.mark.parametrize("kind", ["BIGINT", "INT", "DOUBLE", "STRING", "DATE"])
@pytest.mark.parametrize("sorted_at_once", [3, 100_000])
def test_key_at_any_position(spark, kind, sorted_at_once, monkeypatch):
    """By selection for numbers, brackets narrowed to three keys; bunched, repeated and null keys."""
    monkeypatch.setattr(paging, "SORTED", sorted_at_once)
    pick = random.Random(6)
    values = [5] * 40 + list(range(60)) + [10**6 + i for i in range(40)] + [7] * 30
    df = spark.createDataFrame([(v,) for v in pick.sample(values, len(values))] + [(None,)], "k BIGINT").repartition(3)
    cast = {"DATE": F.expr("date_add(DATE'2000-01-01', cast(k % 100000 as int))")}.get(kind, F.col("k").cast(kind))
    keys = df.select(cast.alias("k"))
    want = sorted(r.k for r in keys.filter("k IS NOT NULL").collect())
    for position in (1, 2, 46, 60, 100, 101, len(want)):
        assert paging.key_at(keys, "k", position) == want[position - 1]
    assert paging.key_at(keys, "k", len(want) + 1) is None and paging.key_at(keys.limit(0), "k", 1) is None


def test_positions_of_many_keys_are_found_without_an_exchange(spark, monkeypatch):
    monkeypatch.setattr(paging, "sorted_key_at", None)
    keys = spark.range(300_000).select((F.col("id") * 7919 % 300_007).alias("k"))
    want = sorted(i * 7919 % 300_007 for i in range(300_000))
    for position in (1, 77_777, 299_999):
        assert paging.key_at(keys, "k", position) == want[position - 1]


def names(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id INT, name STRING")


def test_letters_that_lower_case_does_not_know(spark):
    rows = names(spark, "Straße", "STRASSE", "ΟΔΟΣ", "οδος", "οδοσ", "Über", "über", "uber", "ﬁne", "FINE", "one", None)
    found = lambda collation: {r.name: (r.variants, r.occurrences) for r in quality.name_variants(rows, "name", collation).collect()}
    assert found("UNICODE_CI") == {"ΟΔΟΣ": (3, 3), "Über": (2, 2), "FINE": (2, 2)}
    assert found("UNICODE_CI_AI") == {"STRASSE": (2, 2), "ΟΔΟΣ": (3, 3), "uber": (3, 3), "FINE": (2, 2)}
    lowered = {r.lowered: r.variants for r in quality.case_variants(rows, "name").collect()}
    assert lowered == {"οδος": 2, "über": 2}


def test_joins_by_collation(spark):
    stored = names(spark, "STRASSE", "Σίγμα", None)
    batch = names(spark, "straße", "σίγμα", "ΣΊΓΜΑ", "Neu", "NEU", "neu", None, "résumé")
    assert ids(R.existing_by_name(batch, stored, ["name"])) == [1, 2]
    assert ids(R.existing_by_name(batch, stored, ["name"], "UNICODE_CI_AI")) == [0, 1, 2]
    assert ids(R.absent_by_name(batch, stored, ["name"], [F.asc("id")], "UNICODE_CI_AI")) == [3, 7]
    assert ids(R.absent_by_name(batch, stored, ["name"], [F.desc("id")], "UNICODE_CI_AI")) == [5, 7]


def test_substrings_equal_a_scan(spark):
    """Every text of up to five characters over odd names, one of them on a third of the rows."""
    from cantera.operators import substrings
    from cantera.session import new_path

    pick = random.Random(1)
    values = ["AbcABC"] * 30 + ["".join(pick.choices("abB%_\\ é日ß", k=pick.randint(0, 8))) for _ in range(80)] + [None, "", "a", "ab"]
    rows = names(spark, *values)
    index = substrings.build(rows, "id", "name", new_path(spark, "substrings"))
    parts = ["".join(pick.choices("abB%_\\ é日ß", k=k % 6)) for k in range(60)] + ["ABCa", "zzz", "", None, "bcab"]
    wanted = spark.createDataFrame(list(enumerate(parts)), "part INT, text STRING")
    got = sorted((r.part, r.id) for r in substrings.contains(index, wanted, "part", "text").collect())
    want = sorted((p, i) for p, part in enumerate(parts) if part is not None for i, name in enumerate(values) if name is not None and part.lower() in name.lower())
    assert got == want
    for part in parts[:12] + ["ABCa", "zzz", ""]:
        scan = ids(R.name_contains(rows, {"name": part}))
        assert ids(substrings.look_up(index, part)) == ids(substrings.look_up(index, part, most=1)) == scan


def test_a_look_up_reads_candidates_only(spark):
    from cantera.operators import substrings
    from cantera.session import new_path

    rows = spark.range(5000).select("id", F.concat(F.lit("name "), F.col("id").cast("string")).alias("name"))
    index = substrings.build(rows, "id", "name", new_path(spark, "substrings"))
    found = substrings.look_up(index, "E 4321")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,4321)" in plan and [r.id for r in found.collect()] == [4321]


def test_upsert_leaves_stored_rows_in_place(spark):
    stored = spark.createDataFrame([(i, "old") for i in range(50)] + [(None, "old")], "id INT, state STRING").repartition(5)
    new = spark.createDataFrame([(3, "new"), (3, "newer"), (60, "new"), (None, "new")], "id INT, state STRING")
    merged = R.upsert(stored, new, "id", [F.desc("state")])
    got = {r.id: r.state for r in merged.collect()}
    assert got == {**{i: "old" for i in range(50)}, 3: "newer", 60: "new", None: "new"} and merged.count() == 52


def test_texts_of_up_to_six_characters_have_the_list_of_their_answer(spark):
    from cantera.operators import substrings
    from cantera.session import new_path

    rows = spark.range(500).selectExpr("id", "concat('Customer#', lpad(id, 9, '0')) AS name")
    index = substrings.build(rows, "id", "name", new_path(spark, "substrings"))
    listed = sorted(r.id for r in index.postings.filter("gram = '000012'").collect())
    assert listed == [12, *range(120, 130)] == sorted(r.id for r in substrings.look_up(index, "000012").collect())

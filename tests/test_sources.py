import pytest
from pyspark.sql import functions as F

from cantera.session import new_path
from cantera.sources import html, points, responses, scan, sinks
from cantera.tables import SCHEMAS

PAGES = {
    "none": "<html><body><p>nothing</p></body></html>",
    "two": '<div data-box="true">one<br>two</div><p>no</p><div data-box="true">three</div>',
    "nested": '<div data-box="true">a<div>b</div>c</div>d',
    "blank": '<div data-box="true">x<br>   <br>y</div>',
    "entity": '<div data-box="true">rock &amp; roll &#39;n&#39; &eacute;</div>',
    "other": '<div data-box="false">x</div>',
    "script": '<div data-box="true">a<script>var b = "<p>";</script>c<!-- d --></div>',
    "annotated": '<div data-box="true">[Chorus]<br>la (x2) la<br></div>',
    "unclosed": '<div data-box="true"><p>a<p>b',
}


@pytest.fixture(scope="module")
def lyric(spark):
    df = spark.createDataFrame(list(PAGES.items()), "name STRING, html STRING")
    found = html.lyrics_from_html(df, "html", "div", ("data-box", "true"))
    return {r.name: (r.status, r.letra) for r in found.collect()}


@pytest.mark.parametrize(
    "name, text",
    [
        ("two", "one\ntwo\nthree"),
        ("nested", "a\nb\nc"),
        ("blank", "x\n   \ny"),
        ("entity", "rock & roll 'n' é"),
        ("script", "a\nc"),
        ("annotated", "la  la"),
        ("unclosed", "a\nb"),
    ],
)
def test_container_text(lyric, name, text):
    assert lyric[name] == ("found", text)


@pytest.mark.parametrize("name", ["none", "other"])
def test_page_without_container(lyric, name):
    assert lyric[name] == ("no lyric", None)


def test_null_page(spark):
    df = spark.createDataFrame([(None,)], "html STRING")
    assert html.lyrics_from_html(df, "html", "article").first()["status"] == "no lyric"


def test_first_hit_and_empty_hits(spark):
    body = '{"response":{"hits":[{"result":{"url":"http://song","id":123,"full_title":"t"}},{"result":{"id":9}}]}}'
    df = spark.createDataFrame([(1, body), (2, '{"response":{"hits":[]}}'), (3, "broken{")], "n INT, body STRING")
    fields = {"result.url": "STRING", "result.id": "BIGINT"}
    got = responses.first_hit(df, "body", "response.hits", fields, ("n",))
    assert sorted(map(tuple, got.collect())) == [(1, "http://song", 123), (2, None, None), (3, None, None)]


def test_first_recording(spark):
    df = spark.createDataFrame([('{"recordings":[{"id":"mbid-123"}]}',), ("{}",)], "body STRING")
    got = responses.first_hit(df, "body", "recordings", {"id": "STRING"})
    assert [r.id for r in got.collect()] == ["mbid-123", None]


def test_artist_names_and_blank_titles(spark):
    df = spark.createDataFrame([('{"artists":[{"name":"A"},{"name":""},{"x":1},{"name":"B"}]}',)], "body STRING")
    assert [r.value for r in responses.explode_hits(df, "body", "artists", "name").collect()] == ["A", "B"]


def test_features(spark):
    document = '{"postgre_id": %s, "features": {"lowlevel": [1], "metadata": {"tags": %s}}}'
    docs = [
        document % (1, '{"bpm": ["120.5", "60"], "initialkey": ["C major"], "genre": ["rock", "pop"]}'),
        document % (2, '{"bpm": [], "genre": "jazz"}'),
        document % (3, '{"bpm": ["fast"]}'),
        '{"features": {}}',
        '{"postgre_id": 5}',
        document % (6, '{"bpm": [99]}'),
    ]
    df = spark.createDataFrame([(d,) for d in docs], "document STRING")
    got = {r.postgre_id: (r.bpm, r.initialkey, r.genre) for r in responses.flatten_features(df, "document").collect()}
    assert got == {
        1: (120.5, "C major", "rock"),
        2: (None, None, "jazz"),
        3: (None, None, None),
        5: (None, None, None),
        6: (99.0, None, None),
    }


def test_requests(spark):
    texts = ['{"query":"love","genre":"","bpm":0}', '{"genre":"rock"}', "not json", None, '{"query":"x","key":"C","bpm":120}']
    df = spark.createDataFrame(list(enumerate(texts)), "n INT, r STRING")
    got = {r.n: (r.query, r.genre, r.key, r.bpm, r.error) for r in responses.parse_requests(df, "r", ("n",)).collect()}
    assert got[0] == ("love", None, None, None, None)
    assert got[1][4] == "Missing 'query' field"
    assert got[2][4] == "Invalid request" and got[3][4] == "Invalid request"
    assert got[4] == ("x", None, "C", 120, None)


def test_any_number_is_a_tempo(spark):
    bodies = ['{"query":"x","bpm":120}', '{"query":"x","bpm":120.0}', '{"query":"x","bpm":120.5}', '{"query":"x","bpm":"fast"}', '{"query":"x","bpm":', '{"bpm":1}']
    df = spark.createDataFrame(list(enumerate(bodies)), "qid INT, body STRING")
    got = {r.qid: (r.bpm, r.error) for r in responses.parse_requests(df, "body", ("qid",)).collect()}
    assert got == {
        0: (120.0, None),
        1: (120.0, None),
        2: (120.5, None),
        3: (None, None),
        4: (None, "Invalid request"),
        5: (1.0, "Missing 'query' field"),
    }


def test_features_are_parsed_once(spark):
    df = spark.range(1).selectExpr("cast(id as string) AS d")
    plan = responses.flatten_features(df, "d")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(StructField(postgre_id") == 1


def test_landing_once(spark):
    path = new_path(spark, "landed")
    schema = SCHEMAS["features"]
    first = spark.createDataFrame([(1, "m", "{}"), (2, "m", "{}"), (2, "m", "{}")], schema)
    empty = spark.createDataFrame([], schema)
    sinks.append_documents(sinks.new_documents(empty, first, "postgre_id", [F.asc("mbid")]), path)
    again = spark.createDataFrame([(2, "m", "{}"), (3, "m", "{}")], schema)
    sinks.append_documents(sinks.new_documents(scan.scan_json(spark, path, schema), again, "postgre_id", [F.asc("mbid")]), path)
    assert sorted(r.postgre_id for r in scan.scan_json(spark, path, schema).collect()) == [1, 2, 3]


def test_rejected_rows_are_all_kept(spark):
    df = spark.createDataFrame([(1, "5"), (2, "x"), (3, None)], "id INT, v STRING")
    number = F.col("v").try_cast("int")
    good, bad = sinks.split_rejected(df, {"missing": F.col("v").isNull(), "not a number": number.isNull()})
    assert [tuple(r) for r in good.collect()] == [(1, "5")]
    assert sorted(tuple(r) for r in bad.select("id", "reason").collect()) == [(2, "not a number"), (3, "missing")]


def test_vectors_are_replaced(spark):
    path = new_path(spark, "vectors")
    sinks.write_vectors(spark.createDataFrame([(1, [1.0])], "id INT, v ARRAY<FLOAT>"), path)
    sinks.write_vectors(spark.createDataFrame([(2, [2.0])], "id INT, v ARRAY<FLOAT>"), path)
    assert [tuple(r) for r in scan.scan_parquet(spark, path).collect()] == [(2, [2.0])]


def test_jdbc_options():
    plain = scan.jdbc_options("jdbc:x", "canciones")
    assert plain == {"url": "jdbc:x", "dbtable": "canciones", "fetchsize": "1000"}
    ranged = scan.jdbc_options("jdbc:x", "canciones", "id", (0, 100), 8, user="u")
    assert ranged["numPartitions"] == "8" and ranged["user"] == "u" and ranged["upperBound"] == "100"
    with pytest.raises(ValueError):
        scan.jdbc_options("jdbc:x", "canciones", "id")


def test_points_from_patches(spark):
    schema = SCHEMAS["lyrics_database"]
    base = {name.split()[0]: None for name in schema.split(", ")}
    songs = [
        {**base, "id": 1, "track_vector": [[1.0, 2.0], [3.0, 4.0], [5.0, 9.0]], "letra_vec": [1.0], "artista": "a"},
        {**base, "id": 2, "track_vector": [[1.0, 2.0]], "letra_vec": [1.0]},
        {**base, "id": 3, "track_vector": [[1.0, 2.0], [3.0]], "letra_vec": [1.0]},
        {**base, "id": 4, "track_vector": [], "letra_vec": [1.0]},
        {**base, "id": 5, "track_vector": [[1.0]], "letra_vec": None},
    ]
    made = {r.id: r for r in points.to_points(spark.createDataFrame(songs, schema)).collect()}
    assert made[1].track_vector == [3.0, 5.0] and made[1].reason is None and made[1].payload.artist == "a"
    assert made[2].track_vector == [1.0, 2.0] and made[2].reason is None
    assert {made[i].reason for i in (3, 4)} == {"track vector is empty or ragged"}
    assert made[5].reason == "lyrics vector is empty"


def test_other_widths_are_rejected_and_widths_are_kept(spark):
    schema = SCHEMAS["lyrics_database"]
    names = [name.split()[0] for name in schema.split(", ")]
    base = dict.fromkeys(names)
    songs = [{**base, "id": i, "track_vector": [[1.0] * n], "letra_vec": [1.0]} for i, n in ((1, 2), (2, 3))]
    df = spark.createDataFrame([tuple(s[n] for n in names) for s in songs], schema)
    made = points.to_points(df, {"track_vector": 2, "lyrics_vector": 1})
    assert {r.id: r.reason for r in made.collect()} == {1: None, 2: "track_vector is not 2 wide"}
    path = new_path(spark, "points")
    points.declare(made, {"track_vector": 2, "lyrics_vector": 1}).write.parquet(path)
    assert points.declared(spark.read.parquet(path)) == {"track_vector": 2, "lyrics_vector": 1}


def test_append_adds_rows(spark):
    path = new_path(spark, "results")
    df = spark.createDataFrame([(1, "x")], "id INT, letra STRING")
    sinks.append(df, path)
    sinks.append(df, path)
    assert scan.scan_parquet(spark, path).count() == 2


def test_documents_as_variant(spark):
    """Landed once, read by path; odd documents give null or a row of their own."""
    from cantera.sources import variants

    documents = [
        '{"postgre_id": 1, "features": {"metadata": {"tags": {"bpm": ["120.5", "3"], "initialkey": "Am", "genre": ["rock"]}}}}',
        '{"postgre_id": 2, "features": {"metadata": {"tags": {"bpm": 90, "genre": null}}}}',
        '{"postgre_id": "3", "features": {}}', '{"features": 1}', "{broken", None, "[1, 2]",
        '{"postgre_id": 4, "features": {"metadata": {"tags": {"bpm": "fast", "initialkey": [], "genre": {"main": "pop"}}}}}',
    ]
    rows = spark.createDataFrame([(d,) for d in documents], "document STRING")
    path = new_path(spark, "variants")
    landed = variants.land(rows, "document", path)
    got = {r.postgre_id: (r.bpm, r.initialkey, r.genre) for r in variants.flatten_features(landed).collect()}
    assert got == {1: (120.5, "Am", "rock"), 2: (90.0, None, None), 3: (None, None, None), 4: (None, None, '{"main":"pop"}')}
    assert variants.read(spark, path).filter("raw IS NOT NULL").collect()[0].raw == "{broken" and landed.count() == len(documents)
    report = {r.path.rpartition(".")[2]: (r.has, r.lacks, r.drifted, r.seen) for r in variants.drift(landed, variants.FEATURES).collect()}
    assert report == {
        "postgre_id": (3, 2, 1, "string"), "bpm": (1, 3, 2, "array"), "initialkey": (1, 4, 1, "array"), "genre": (0, 4, 2, "array"),
    }
    told = variants.schema_of(landed).first()
    assert told.documents == 6 and told.broken == 1
    variants.land(rows.limit(1), "document", path)
    assert variants.read(spark, path).count() == len(documents) + 1
    assert variants.flatten_features(landed.limit(0)).count() == 0


def test_responses_that_give_nothing_are_named(spark):
    from cantera.sources import responses

    bodies = ['{"a": {"hits": [{"t": "x"}]}}', '{"a": {"hits": []}}', '{"a": {"hits": null}}', '{"a": {"hits": 3}}', '{"a": 1}', "[]", "{", "", None]
    rows = spark.createDataFrame(list(enumerate(bodies)), "id INT, body STRING")
    got = {r.id: r.reason for r in responses.unusable(rows, "body", "a.hits", ("id",)).collect()}
    assert got == {2: "no list", 3: "no list", 4: "no list", 5: "no list", 6: "no JSON", 7: "empty", 8: "empty"}

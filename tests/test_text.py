import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cantera.functions import checks as C
from cantera.functions import text as X
from cantera.operators import lyrics as L


def model_clean(text):
    """The cleaner, one text at a time."""
    if text is None:
        return None
    text = text.split("____")[0].strip()
    lines = [line.strip() for line in text.splitlines()]
    return re.sub(r"[^\w\s]", "", "\n".join(line for line in lines if line).lower())


def model_prepare(text):
    if text is None:
        return None
    words = model_clean(text).split()
    votes = {code: sum(w in X.STOP_WORDS[code] for w in words) for code in X.VOTE_ORDER}
    winner = max(X.VOTE_ORDER, key=lambda code: (votes[code], -X.VOTE_ORDER.index(code)))
    stop = X.STOP_WORDS[winner if winner in ("es", "fr") else "en"]
    return " ".join(w for w in words if w not in stop)


TEXTS = [
    None,
    "",
    "?!...",
    "Hello, World!____ cut here",
    "  first line \n\n \t \n second\tline  \r\nthird ",
    "Ñandú straße 42 under_score don't stop now",
    "line\x0bfeed\x1cgroup separator",
    "the cat and the dog are in the house",
    "el perro y la casa de los niños que no es",
    "le chien et la maison des enfants qui ne sont pas",
    "der Hund und das Haus von dem Kind, the end of the story",
    "___ three only ____ then four",
    "() [] «quoted» — dash",
]


def column(spark, values, name="t"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id INT, {name} STRING")


def test_clean_equals_the_model(spark):
    got = {r.id: r.cleaned for r in L.clean_lyrics(column(spark, TEXTS), "t").collect()}
    assert [got[i] for i in range(len(TEXTS))] == [model_clean(t) for t in TEXTS]


def test_prepare_equals_the_model(spark):
    got = {r.id: r.words for r in L.prepare_lyrics(column(spark, TEXTS), "t").collect()}
    assert [got[i] for i in range(len(TEXTS))] == [model_prepare(t) for t in TEXTS]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="aZñß9_ .,\t\n\r  'é", max_size=30), min_size=1, max_size=40))
def test_any_text(spark, texts):
    df = L.prepare_lyrics(L.clean_lyrics(column(spark, texts), "t"), "t")
    got = {r.id: (r.cleaned, r.words) for r in df.collect()}
    assert [got[i] for i in range(len(texts))] == [(model_clean(t), model_prepare(t)) for t in texts]


def test_steps_give_what_the_whole_gives(spark):
    df = L.clean_lyrics(column(spark, TEXTS), "t")
    df = L.drop_stopwords(L.detect_language(df, "cleaned"), "cleaned", "language", "step")
    assert all(r.step == r.words for r in L.prepare_lyrics(df, "t").collect())


def test_language_and_another_detector(spark):
    df = L.clean_lyrics(column(spark, TEXTS), "t")
    found = {r.id: r.language for r in L.detect_language(df, "cleaned").collect()}
    assert (found[7], found[8], found[9], found[1], found[0]) == ("en", "es", "fr", "en", "en")
    other = L.detect_language(df, "cleaned", detector=F.lit("xx"))
    assert {r.language for r in other.collect()} == {"xx"}


def test_language_is_mostly_right_on_the_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = L.detect_language(L.clean_lyrics(documents, "text"), "cleaned")
    right = found.agg(F.avg((F.col("language") == F.col("lang")).cast("double"))).first()[0]
    assert right > 0.9


BRACKETS = ["[Chorus] la", "uh (x2) uh", "odd (a] odd", "((a))", "open (not\nclosed) here", "none", None, "[a](b)"]


def test_brackets(spark):
    got = {r.id: r.s for r in column(spark, BRACKETS).select("id", X.strip_annotations(F.col("t")).alias("s")).collect()}
    want = [None if t is None else re.sub(r"[\(\[].*?[\)\]]", "", t) for t in BRACKETS]
    assert [got[i] for i in range(len(BRACKETS))] == want


def test_body(spark):
    bodies = ['<pre>{"lyrics": "one\\ntwo"}</pre>', '{"lyrics":"say \\"hi\\" now"}', '{"error":"none"}', '{"lyrics" : ""}', None]
    got = {r.id: r.s for r in column(spark, bodies).select("id", X.lyrics_from_body(F.col("t")).alias("s")).collect()}
    assert got == {0: "one\ntwo", 1: 'say "hi" now', 2: None, 3: None, 4: None}


def test_names(spark):
    df = spark.createDataFrame([("AC∕DC", "T.N.T."), (None, "x")], "a STRING, t STRING")
    got = df.select(X.query_string(F.col("a"), F.col("t")).alias("q")).collect()
    assert [r.q for r in got] == ["AC/DC T.N.T.", None]


def test_lyric_or_null(spark):
    values = ["no lyric", "  \t", "", None, "la la"]
    got = {r.id: r.s for r in column(spark, values).select("id", X.lyric_or_null(F.col("t")).alias("s")).collect()}
    assert got == {0: None, 1: None, 2: None, 3: None, 4: "la la"}


@pytest.mark.parametrize(
    "value, valid",
    [
        ("12345678-1234-1234-1234-123456789012", True),
        ("aaaaaaaa-bbbb-cccc-dddd-eeeeeeeeeeee", True),
        ("AAAAAAAA-bbbb-cccc-dddd-eeeeeeeeeeee", False),
        ("not-a-uuid", False),
        ("12345678-1234-1234-1234", False),
        ("", False),
        (None, False),
    ],
)
def test_mbid(spark, value, valid):
    assert column(spark, [value]).select(C.is_mbid(F.col("t"))).first()[0] is valid


def test_dates(spark):
    values = ["2025-12-12 20:54:13", "2025-1-1 0:0:0", "2025-02-30 00:00:00", "12/12/2025", "", None]
    parsed = column(spark, values).select("id", C.parse_date(F.col("t")).alias("d"))
    got = {r.id: r.s for r in parsed.select("id", C.format_date(F.col("d")).alias("s")).collect()}
    assert got == {0: values[0], 1: "2025-01-01 00:00:00", 2: None, 3: None, 4: None, 5: None}


def test_titles_with_odd_characters_are_filled(spark):
    titles = ["Normal", "with\nnewline", "with\t\ttabs", "with 'quotes'", 'with "double"', "", None]
    got = {r.id: r.ok for r in column(spark, titles).select("id", C.is_filled(F.col("t")).alias("ok")).collect()}
    assert [got[i] for i in range(7)] == [True] * 5 + [False] * 2


def test_batches_are_taken_in_slices(spark):
    """What a task holds does not follow the size of Spark's batches: results are given on slice by slice."""
    import numpy as np
    import pyarrow as pa

    from cantera.functions import batches, stopwords
    from cantera.operators import embedding

    texts = pa.array(["the cat and the dog" if i % 7 else None for i in range(3000)])
    places = pa.array(["en"] * 3000)
    steps = {
        "vote": stopwords.vote.func(iter([texts])),
        "remove": stopwords.remove.func(iter([(texts, places)])),
        "both": stopwords.vote_and_remove.func(iter([texts])),
        "hashed": embedding._hashed(64).func(iter([texts])),
        "model": embedding._modelled(lambda: lambda some: np.ones((len(some), 2))).func(iter([texts])),
    }
    for name, step in steps.items():
        parts = list(step)
        assert max(len(part) for part in parts) <= batches.TEXTS_AT_ONCE, name
        whole = pa.concat_arrays(parts)
        assert len(whole) == 3000 and (name == "vote" or whole.null_count == texts.null_count), name
    assert [len(part) for part in batches.slices(pa.array(["a" * 10, "b" * 10, "c" * 30, ""]), 20)] == [2, 1, 1]

"""Nulls, empty and very long texts, repeated rows, empty tables and clashing names, for every operator."""

import pytest
from public_tokenizers import path
from pyspark.sql import functions as F

import corpus_pipeline
from cantera.llm import crosspolytope, extraction, langid, licenses, packing, pieces, quality, sharding, simhash, urls
from cantera.session import shared_folder

BPE, MODEL = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
LONG = "the long text of many words " * 4000
PLAIN = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}rd" for i in range(90))
CLASHES = "key string, words string, row string, start long, n_words string, shard string, slot string, s string, b string, place string, content string, by_0 string, host string, score string, ids string, kept string"
ROWS = [
    (1, PLAIN, "en", "a"),
    (1, PLAIN, "en", "a"),
    (2, PLAIN, None, "a"),
    (3, None, "en", None),
    (4, "", "en", "b"),
    (5, " \n\t ", "fr", "b"),
    (None, "no id here", "fr", "b"),
    (6, LONG, "fr", "b"),
    (7, "x", None, None),
    (8, "été 日本語 🙂   \x00 end", "fr", "c"),
    (9, "9" * 100_000, "en", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    shared_folder(spark)
    extra = [c.split()[0] for c in CLASHES.split(", ")]
    base = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return base.select("*", *[F.lit("7").alias(c) for c in extra])


def test_quality(odd):
    result = quality.quality_rules(odd).toPandas()
    assert len(result) == len(ROWS) and result.n_words.dtype == "int64" and list(result.columns).count("n_words") == 1
    assert result[result.doc_id == 1].kept.all() and not result[result.doc_id == 4].kept.any()
    assert result[result.doc_id == 6].n_repeat_words.item() == 24000 and "by_0" in result.columns
    assert quality.quality_report(odd.limit(0)).count() == 0 and quality.quality_rules(odd.limit(0)).count() == 0


def test_sharding(odd):
    result = sharding.shard_documents(odd, 3, bucket_bytes=1000).toPandas()
    assert len(result) == len(ROWS) and sorted(result.text.dropna()) == sorted(r[1] for r in ROWS if r[1] is not None)
    for _, part in result.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert result.groupby("doc_id", dropna=False).shard.nunique().eq(1).all()
    assert sharding.shard_documents(odd.limit(0), 3).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, None, "h"), (2, "", "h"), (3, "http://a.net/x", "h"), (3, "http://a.net/x", "h")], "page_id long, url string, best string")
    rules = spark.createDataFrame([("net", "/", "block"), (None, None, "block")], "host string, path string, verdict string")
    found = urls.judge_urls(pages, rules).orderBy("page_id").collect()
    assert [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in found] == [
        (1, "", "", None, "allow"),
        (2, "", "", "", "block"),
        (3, "a.net", "/x", "net/", "block"),
        (3, "a.net", "/x", "net/", "block"),
    ]
    assert urls.judge_urls(pages, rules.limit(0)).where("verdict = 'allow'").count() == 4
    assert urls.judge_urls(pages.limit(0), rules).count() == 0


def test_language(odd, spark):
    model = langid.learn(odd, MODEL)
    assert model.languages == ["en", "fr"]
    result = langid.identify(odd, model).toPandas()
    assert len(result) == len(ROWS) and result[result.doc_id == 3].lang_pred.item() == "und"
    assert set(result[result.doc_id.isin([4, 5, 9])].lang_pred) == {"und"} and result.score.between(0, 1).all()
    nothing = langid.learn(odd.limit(0), MODEL)
    assert set(langid.identify(odd, nothing).toPandas().lang_pred) == {"und"}
    assert langid.identify(odd.limit(0), model).count() == 0


def test_packing(odd):
    result = packing.pack(odd, BPE, length=64, group_pieces=8, ids=True).toPandas()
    assert (result.groupby("doc_id").length.sum()[[3, 4]] == 1).all()
    assert result.ids.map(len).sum() == result.length.sum() and result.groupby("sequence_id").length.sum().max() <= 64
    assert packing.pack(odd.limit(0), BPE).count() == 0


def test_licenses(odd):
    result = licenses.scan_licenses(odd).toPandas()
    assert len(result) == len(ROWS) and result[result.doc_id == 3].n_words.item() == 0 and (result.n_base == 0).all()
    assert licenses.scan_licenses(odd.limit(0)).count() == 0


def test_simhash(odd):
    result = simhash.simhash_groups(odd).toPandas()
    assert len(result) == len(ROWS) and set(result[result.doc_id.isin([3, 4, 5])].component_id) == {3}
    assert set(result[result.doc_id.isin([1, 2])].component_id) == {1} and set(result[result.doc_id == 4].fingerprint) == {"0" * 16}
    assert simhash.simhash_groups(odd.limit(0)).count() == 0


def test_near_duplicates(odd):
    result = simhash.without_near_duplicates(odd)
    assert result.columns == odd.columns
    # Null, empty and blank texts are one group, the three copies another.
    assert sorted(result.toPandas().doc_id.fillna(0)) == [0, 1, 3, 6, 7, 8, 9]
    assert simhash.without_near_duplicates(odd.limit(0)).count() == 0


def test_pieces(odd):
    result = pieces.decode_pieces(pieces.encode_pieces(odd, MODEL), MODEL).toPandas()
    assert len(result) == len(ROWS) and (result.decoded == result.text.fillna("")).all()
    assert pieces.encode_pieces(odd.limit(0), MODEL).count() == 0


def test_pages(spark):
    shared_folder(spark)
    pages = spark.createDataFrame(
        [(1, None, None), (2, "", ""), (3, "http://h/a", "<p>one<p>two"), (3, "http://h/a", "<p>one<p>two"), (None, "x", "<article>" + "a b " * 50_000 + "</article>")],
        "page_id long, url string, html string",
    )
    result = extraction.main_text(pages).toPandas()
    assert sorted(result.n_chars) == [0, 0, 7, 7, 199_999] and result[result.page_id == 3].text.tolist() == ["one\ntwo"] * 2
    assert extraction.main_text(pages.limit(0)).count() == 0


def test_neighbours_of_nothing(spark):
    shared_folder(spark)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert crosspolytope.nearest(empty, F.col("vec_id") % 20 == 0).count() == 0


def test_pipeline_stages(odd, spark):
    docs = odd.select("doc_id", "text", "lang", "source", F.length("text").alias("n_chars"))
    for some in (docs, docs.limit(0)):
        rows = some
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, "")
            assert rows.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, rows, "").count() >= 0

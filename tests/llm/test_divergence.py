"""The divergence audit against counting by hand; `op13_divergence` is compared with SQL in test_methods."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cantera.llm import divergence
from cantera.session import shared_folder

SCHEMA = "text string, lang string, source string"


def by_hand(rows, top=200):
    words = [(lang or "", source or "", re.findall("[a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    seen = defaultdict(Counter)
    for lang, _, terms in words:
        seen[lang].update(set(terms))
    counts = defaultdict(Counter)
    for lang, source, terms in words:
        counts[lang, source].update(t for t in terms if seen[lang][t] >= 3)
        counts[lang, None].update(t for t in terms if seen[lang][t] >= 3)
    out = set()
    for (lang, source), own in counts.items():
        kept = [t for t in seen[lang] if seen[lang][t] >= 3]
        share = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))
        if source is None:
            continue
        f = lambda p, q: (p - q) ** 2 // q
        pairs = [(s, sum(f(share(own, t), share(c, t)) for t in kept)) for (a, s), c in counts.items() if a == lang and s not in (None, source)]
        every = counts[lang, None]
        terms = [(t, f(share(own, t), share(every, t))) for t in kept if own[t] and share(own, t) > share(every, t)]
        for part, values in (("pair", pairs), ("term", terms)):
            values.sort(key=lambda x: (-x[1], x[0].encode()))
            out |= {(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(values) if part == "pair" or i < top}
    return out


ROWS = [
    ("the cat the dog", "en", "a"), ("The CAT ran, the dog", "en", "b"), ("the dog cat-cat", "en", "b"), ("the the the", "en", "c"), ("é été É", "en", None),
    (None, "en", "d"), ("", "en", "e"), ("x1y2 the", None, "a"), ("the x", None, "a"), ("the x x", None, None), ("x", None, "b"), ("日本 日本", "ja", "a"), ("日本", "ja", "b"),
    ("日本 ok", "ja", "b"), ("lonely", "fr", "z"), ("lonely", "fr", "y"), ("the cat the dog", "en", "a"),
]


@pytest.mark.parametrize("memory", [1, divergence.MEMORY])
def test_against_counting(spark, memory, monkeypatch):
    shared_folder(spark)
    monkeypatch.setattr(divergence, "BLOCK", 8)
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    docs = docs.select("*", *[F.lit("7").alias(c) for c in ("term", "n", "docs", "item", "value", "rank", "part", "total")])
    runs = divergence.index_runs(docs, memory=memory)
    monkeypatch.setattr(divergence, "index_runs", lambda *a, **k: runs)
    assert {tuple(r) for r in divergence.audit(docs).collect()} == by_hand(ROWS)
    assert {tuple(r) for r in divergence.audit(docs, top=1).collect()} == by_hand(ROWS, 1)


def test_many_sources_are_summed_without_a_table_of_pairs(spark, monkeypatch):
    shared_folder(spark)
    rows = [(f"w{i % 7} common term{'x' * (i % 5)} {'odd ' * (i % 3)}", "en", f"s{i % 40}") for i in range(160)]
    docs = spark.createDataFrame(rows, SCHEMA)
    wanted = by_hand(rows)
    assert {tuple(r) for r in divergence.audit(docs).collect()} == wanted
    monkeypatch.setattr(divergence, "SUMMED", 1)
    monkeypatch.setattr(divergence, "PAIRS_AT_ONCE", 50)
    assert {tuple(r) for r in divergence.audit(docs).collect()} == wanted


def test_nothing_and_too_much(spark, monkeypatch):
    shared_folder(spark)
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert divergence.audit(docs.limit(0)).count() == 0
    assert divergence.audit(docs.where("lang = 'fr'")).count() == 2
    monkeypatch.setattr(divergence, "MOST_GROUPS", 3)
    with pytest.raises(ValueError):
        divergence.audit(docs)


def test_shares_are_exact_beyond_longs(spark):
    counts = [(0, 1), (0, 3), (10**13, 10**13 + 7), (9_300_000_000, 9_300_000_001), (123_456_789_012, 987_654_321_098)]
    wanted = [1 + 10**9 * (n + 1) // size for n, size in counts]
    rows = spark.createDataFrame(counts, "n long, size long")
    assert sorted(r[0] for r in rows.select(divergence.share("n", "size")).collect()) == sorted(wanted)
    assert divergence.shares(*np.array(counts).T).tolist() == wanted

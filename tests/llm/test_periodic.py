"""Lyndon arrays, runs and collapsed texts against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cantera.llm import periodic, queries
from conftest import SMALL


def lyndon_by_hand(s):
    out = []
    for i in range(len(s)):
        j = i + 1
        while j < len(s) and s[j:] > s[i:]:
            j += 1
        out.append(j - i)
    return out


def runs_by_hand(s, least, repeats):
    n, found = len(s), []
    for q in range(1, n):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            length = j + q - i
            smaller = (d for d in range(1, q) if all(s[k] == s[k + d] for k in range(i, j + q - d)))
            if j > i and length >= max(least, repeats * q) and next(smaller, None) is None:
                found.append((i, length, q))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(300))
def test_arrays_and_runs(seed):
    draw = random.Random(seed)
    s = [draw.randint(0, 1 + seed % 4) for _ in range(draw.randint(0, 40))]
    if seed % 2 and s:
        s = (s[: draw.randint(1, len(s))] * 9)[: draw.randint(1, 60)]
        for _ in range(seed % 3):
            s[draw.randrange(len(s))] = draw.randint(0, 3)
    assert periodic.lyndon_array(s) == lyndon_by_hand(s)
    for least, repeats in ((6, 4), (2, 2), (3, 3)):
        wanted = runs_by_hand(s, least, repeats)
        assert periodic.runs_of(np.array(s, int), least, repeats) == wanted
        parts = periodic.stretches(np.array(s, int), np.zeros(len(s), int), least, repeats)
        cut = [(a + i, n, q) for a, b in parts for i, n, q in periodic.runs_of(np.array(s[a:b]), least, repeats)]
        assert sorted(cut, key=lambda r: (r[0], r[2])) == wanted


def test_one_word_very_often_takes_linear_time(spark):
    text = "no " * 200_000 + "yes " + "a b c " * 50_000
    row = periodic.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row.runs] == [(0, 200_000, 1), (200_001, 150_000, 3)]
    assert row.n_words == 350_001 and row.collapsed == "no yes a b c"


def test_query_against_brute_force(spark):
    rows = {r.doc_id: r for r in queries.QUERIES["op11_periodic_runs"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(rows) == len(docs) and sum(r.n_runs > 0 for r in rows.values()) > 3
    planted = 0
    for doc in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", doc.text or "")
        n, h = len(words), zlib.crc32(str(doc.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        elif n > 1500:
            continue
        codes = {w: i for i, w in enumerate(words)}
        found = runs_by_hand([codes[w] for w in words], 6, 4) if n <= 1500 else None
        row = rows[doc.doc_id]
        if found is None:
            continue
        dropped = {i for start, length, q in found for i in range(start + q, start + length)}
        text = " ".join(w for i, w in enumerate(words) if i not in dropped)
        lines = "".join(f"{start},{length},{q}\n" for start, length, q in found)
        best = min(((-length, start, q) for start, length, q in found), default=None)
        wanted = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
        assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (len(found), *wanted)
        assert row.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert planted


def test_edges(spark):
    rows = [(1, "a b " * 9), (1, "a b " * 9), (2, None), (3, ""), (4, " \n\t "), (None, "x"), (5, "é 日本 \x00\x01 " * 5), (6, "x" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("7").alias(c) for c in ("runs", "key", "n_words", "collapsed", "start")])
    found = periodic.periodic_runs(docs)
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"]
    result = {(r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in found.collect()}
    assert found.count() == len(rows) and result == {
        (1, 18, ((0, 18, 2),), "a b"),
        (2, 0, (), ""),
        (3, 0, (), ""),
        (4, 0, (), ""),
        (None, 1, (), "x"),
        (5, 15, ((0, 15, 3),), "é 日本 \x00\x01"),
        (6, 1, (), "x" * 200_000),
    }
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    # A tie of lengths, and the law of planted words on odd rows.
    planted = {r.doc_id: r.text for r in queries.with_planted_runs(docs.select("doc_id", "text")).collect()}
    assert planted[2] is None and planted[3] == "" and planted[4] == " \n\t "

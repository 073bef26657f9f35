"""Every operator against a brute-force version, the public library, SQL or held-out accuracy."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F

import check
import corpus_pipeline
from cantera.llm import components, crosspolytope, extraction, langid, licenses, markup, packing, pieces, quality, queries, sharding, simhash, urls
from cantera.session import shared_folder
from conftest import SMALL

BPE, MODEL = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    shared_folder(spark)
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def local(docs):
    return docs.toPandas().sort_values("doc_id")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name, monkeypatch):
    monkeypatch.setattr(check.entry, "queries", lambda: queries.QUERIES)
    monkeypatch.setattr(check.entry, "oracle_sql", lambda: queries.SQL)
    good, message = check.compare(spark, check.connect(SMALL), SMALL, name)
    assert good, message


@pytest.mark.parametrize("name", ["op2_quality_rules", "op3_sharding", "op5_url_filter"])
def test_native_queries_run_no_python(spark, name):
    plan = queries.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct", plan)


def test_fences_hold_against_junk(spark):
    """A source that is a third junk keeps its clean texts and loses the junk."""
    shared_folder(spark)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}rd" for i in range(90)]
    rows = [(i, " ".join(random.Random(i).sample(words, 80)), "en", "a") for i in range(200)]
    rows += [(1000 + i, " ".join(w + "###" for w in random.Random(i).sample(words, 80)), "en", "a") for i in range(100)]
    result = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas()
    assert result[result.doc_id < 1000].kept.all() and not result[result.doc_id >= 1000].kept.any()


def test_sources_have_fences_of_their_own(spark):
    """What is usual in one source is junk in the other: long words, short words and symbols."""
    shared_folder(spark)
    pick = random.Random(8)

    def text(letters, marks=0.0):
        words = ["".join(pick.choices("abcdefghijklmnopqrst", k=max(1, round(pick.gauss(letters, 1))))) for _ in range(120)]
        return " ".join(w + "#" * (pick.random() < marks) for w in words)

    rows = [(i, text(5), "en", "plain") for i in range(300)] + [(1000 + i, text(11, pick.uniform(0.5, 0.9)), "en", "names") for i in range(300)]
    rows += [(2000, text(11), "en", "plain"), (2001, text(5), "en", "names"), (2002, text(2), "en", "plain"), (2003, text(11, 0.7), "en", "names"), (2004, text(5, 0.7), "en", "plain")]
    kept = {r.doc_id for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).where("kept").collect()}
    assert {i for i in range(300)} <= kept and {1000 + i for i in range(300)} <= kept
    assert kept & {2000, 2001, 2002, 2003, 2004} == {2003}


def test_shards_are_a_law_of_the_key(docs):
    result = sharding.shard_documents(docs, 8, bucket_bytes=20_000).toPandas()
    more = sharding.shard_documents(docs, 9, bucket_bytes=20_000).toPandas().set_index("doc_id").shard
    assert result.set_index("doc_id").grown_shard.to_dict() == more.to_dict()
    moved = result[result.shard != result.grown_shard]
    assert (moved.grown_shard == 8).all() and 0 < len(moved) < len(result) / 4


def test_shards_do_not_depend_on_the_partitioning(spark, docs):
    """Small buckets, and one record that would fill several of them."""
    shared_folder(spark)
    many = docs.select("doc_id", "text", "lang").unionByName(
        spark.range(300).select(F.lit(7).cast("long").alias("doc_id"), F.lit("again and again " * 9).alias("text"), (F.col("id") % 3).cast("string").alias("lang"))
    )
    some = [sharding.shard_documents(rows, 5, bucket_bytes=20_000) for rows in (many, many.repartition(7), many.orderBy("text").coalesce(1))]
    first, *others = [sorted(tuple(r) for r in s.select("shard", "slot", "doc_id", "lang", F.crc32(F.col("text").cast("binary"))).collect()) for s in some]
    assert all(other == first for other in others) and len(first) == many.count()
    assert sum(n for _, n in Counter((r.bucket) for r in some[0].collect() if r.doc_id == 7).items()) >= 300
    assert len({r.bucket for r in some[0].where("doc_id = 7").collect()}) > 3
    # One bucket to a partition, in an order of its own: places are not those of the hash order.
    ordered = [r[0] for r in some[0].where("shard = 1").orderBy("slot").select(F.xxhash64(F.lit(42), "doc_id", "text")).collect()]
    assert ordered != sorted(ordered)


def test_sharding_query_against_brute_force(spark, local):
    from xxhash import xxh64

    def hashed(seed, shard, key):
        # Spark hashes columns one after another, each with the hash before as its seed.
        h = 42
        for value, width in ((seed, 4), (shard, 4), (key, 8)):
            h = xxh64(int(value).to_bytes(width, "little", signed=True), h).intdigest()
        return h - (1 << 64) if h >> 63 else h

    def law(key, shards):
        return max(range(shards), key=lambda s: (hashed(42, s, key), s))

    rows = {r.doc_id: r for r in queries.QUERIES["op3_sharding"](spark, SMALL).collect()}
    assert len(rows) == len(local)
    for doc, text in zip(local.doc_id, local.text):
        data, row = (text or "").encode(), rows[doc]
        assert (row["size"], row.text_crc32, row.law) == (len(data) + 16, zlib.crc32(data), "key")
        assert (row.shard, row.grown_shard) == (law(doc, 40), law(doc, 41))
    slots = Counter()
    for row in sorted(rows.values(), key=lambda r: (r.shard, r.slot)):
        assert row.slot == slots[row.shard]
        slots[row.shard] += 1


def test_urls_against_brute_force(spark):
    pick, rows = random.Random(3), []
    for i in range(400):
        host = ".".join(pick.choices(["a", "B", "net", "org", "x"], k=pick.randint(1, 4)))
        rows.append((i, pick.choice(["http://", "", "ftp://"]) + host + pick.choice(["", "/", "/en/x", "/e", "?q=/en/", "#/en"])))
    known = [("net", "/", "block"), ("a.net", "/e", "allow"), ("x.org", "/en/", "block"), ("org", "", "allow"), ("b", "/", "block")]
    found = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(known, "host string, path string, verdict string"))
    for r in found.collect():
        rest = r.url.split("://", 1)[1] if "://" in r.url else ""
        host = re.match("[^/?#]*", rest)[0].lower()
        place = re.match("[^?#]*", rest[len(host) :])[0]
        fits = [(len(h + p), len(h), v, h + p) for h, p, v in known if (host == h or host.endswith("." + h)) and place.startswith(p)]
        assert (r.host, r.path, r.rule, r.verdict) == (host, place, max(fits)[3] if fits else None, max(fits)[2] if fits else "allow")


def test_forward_sums_all_segmentations():
    used = np.zeros(256, bool)
    used[[0, *b"abc"]] = True
    trie = langid.Trie(["▁a", "ab", "b", "bc", "abc", "▁ab", "c"], used)
    rng = np.random.default_rng(1)
    probability = rng.random((len(trie.pieces), 2))
    words = ["a", "abc", "abcab", "ccba"]

    def brute(word, lang):
        if not word:
            return 1.0
        return sum(probability[i, lang] * brute(word[len(p) :], lang) for i, p in enumerate(trie.pieces) if word.startswith(p))

    for rows, letters in trie.matrices(pa.array([w.encode() for w in words], pa.binary())):
        last = langid.forward(trie, letters, probability, 1e-9)[:, -1]
        for row, got in zip(rows, last):
            assert np.allclose(got, [brute(b"\0" + words[row].encode(), lang) for lang in (0, 1)])


def test_long_words_are_summed_whole():
    """Scaled sums equal plain ones, at any length; a word that has no room in a double has a logarithm."""
    pick = np.random.default_rng(2)
    trie = langid.Trie(["▁a", "▁ab", "ab", "ba", "abba", "b", "bab"], np.isin(np.arange(256), [0, 97, 98]))
    probability = pick.random((len(trie.pieces), 3)) / 4
    for size in (1, 20, 60):
        letters = trie.column[np.concatenate([np.zeros((4, 1), int), pick.choice([97, 98, 99], (4, size))], axis=1)]
        plain = np.log(langid.forward(trie, letters, probability, 1e-7)[:, -1])
        assert np.allclose(langid.log_likelihood(trie, letters, probability, 1e-7), plain)
        for word in letters:
            total, logs = langid.scaled(trie.steps(word), word.tolist(), probability, 1e-7, trie.deepest)
            assert np.allclose(np.log(total[-1]) + logs[-1], np.log(langid.forward(trie, word[None], probability, 1e-7)[0, -1]))
            known = word.clip(0)
            short = langid.expected(trie, known[None, : langid.LONGEST], np.ones(1), probability[:, 0])
            assert np.allclose(langid.expected_long(trie, known[: langid.LONGEST], 1.0, probability[:, 0]), short)
    word = trie.column[np.concatenate([[0], pick.choice([97, 98], 20_000)])]
    level = langid.log_likelihood(trie, word[None], probability, 1e-7)
    assert np.isfinite(level).all() and (level < -5000).all()
    assert np.isclose(langid.expected_long(trie, word, 2.0, probability[:, 0]) @ [len(p) for p in trie.pieces], 2 * len(word))


def test_every_labelled_language_is_learned(spark):
    """More languages than fit one block, the rarest with one row; and a text without a space."""
    shared_folder(spark)
    pick = random.Random(4)
    rows, number = [], 0
    for k in range(30):
        letters = [chr(97 + (7 * k + i) % 26) for i in range(5)]
        for _ in range(1 + 2 * k):
            rows.append((number, " ".join("".join(pick.choices(letters, k=6)) for _ in range(40)), f"l{k:02}"))
            number += 1
    rows.append((number, "".join(pick.choices([chr(0x4E00 + i) for i in range(40)], k=3000)), "zh"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs, MODEL)
    assert len(model.languages) == 31
    told = langid.identify(docs.select("doc_id", "text", F.col("lang").alias("is")), model)
    assert told.where("lang_pred = is").count() >= 0.95 * len(rows) and told.where("is = 'zh'").first().lang_pred == "zh"


def test_language_of_held_out_rows(docs):
    model = langid.learn(docs.where(~langid.is_held_out()), MODEL)
    told = langid.identify(docs, model).where(langid.is_held_out())
    assert told.where("lang = lang_pred").count() >= 0.97 * told.count()


def test_packing_keeps_every_id(docs, local):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    result = packing.pack(docs, BPE, ids=True).toPandas().sort_values(["doc_id", "start"])
    got = result.groupby("doc_id").ids.apply(lambda parts: np.concatenate(list(parts)).tolist())
    for doc_id, text in zip(local.doc_id, local.text):
        assert got[doc_id] == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
    for _, part in result.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert (part.offset == part.length.cumsum() - part.length).all() and part.length.sum() <= 2048
    assert result.length.sum() / (2048 * result.sequence_id.nunique()) > 0.97


def test_odd_white_space_is_cut_safely(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    texts = ["a  b", "a　\n b", "x   y", " a  b\t\n c ", "é è ", "<|endoftext|> a <|endoftext|>b", "don't  we'll\r\n\r\n"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shared_folder(spark)
    result = {r.doc_id: list(r.ids) for r in packing.pack(frame, BPE, ids=True).collect()}
    for i, text in enumerate(texts):
        assert result[i] == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_tournament_equals_plain_first_fit():
    lengths = np.random.default_rng(2).integers(1, 101, 300)
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    room, want = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        at = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
        if at == len(room):
            room.append(100)
        want[i] = (at, 100 - room[at])
        room[at] -= lengths[i]
    assert {i: (int(b), int(o)) for i, (b, o) in enumerate(zip(bins, offsets))} == {int(i): (int(b), int(o)) for i, (b, o) in want.items()}


def test_matching_statistics_against_brute_force():
    pick = random.Random(4)
    lists = [[pick.randrange(4) for _ in range(pick.randint(3, 30))] for _ in range(6)]
    automaton = licenses.Automaton(lists)
    scanner = licenses.Scanner.__new__(licenses.Scanner)
    scanner.automaton = automaton
    text = [pick.randrange(5) for _ in range(200)]
    inside = lambda run: [(n, i + len(run) - 1) for n, t in enumerate(lists) for i in range(len(t)) if t[i : i + len(run)] == run]
    for end, (state, length) in enumerate(scanner.statistics(text)):
        longest = max(k for k in range(end + 2) if not k or inside(text[end + 1 - k : end + 1]))
        assert length == longest
        if length:
            assert sorted(automaton.places(state)) == sorted(inside(text[end + 1 - length : end + 1]))


def test_chains_cover_as_much_as_any():
    """The first chain is the best of all there are; the others take what is left, no word twice."""

    def covered(chain, gap):
        total = 0
        for i, (end, at, size) in enumerate(chain):
            if not i:
                total = size
                continue
            there, place, _ = chain[i - 1]
            if not (there < end and place < at and end - size + 1 - there <= gap):
                return -1
            total += size - max(0, there - (end - size), place - (at - size))
        return total

    pick = random.Random(11)
    for _ in range(300):
        matches = sorted((pick.randint(5, 60), pick.randint(5, 30), pick.randint(2, 5)) for _ in range(pick.randint(0, 9)))
        gap = pick.randint(0, 8)
        found = licenses.chains(matches, gap)
        every = [c for k in range(1, len(matches) + 1) for c in itertools.combinations(matches, k)]
        assert max((n for _, _, n in found), default=0) == max((covered(c, gap) for c in every), default=0)
        words = [w for first, last, _ in found for w in range(first, last + 1)]
        assert len(words) == len(set(words))


def test_a_match_goes_on_after_one_that_does_not_fit():
    """A stray run from the template's beginning lies between its two halves; then the template twice in a row."""
    template = " ".join(f"t{i}" for i in range(60))
    scanner = licenses.Scanner(templates=(("own", template),), phrases=())
    numbers = [scanner.vocabulary[w] for w in template.split()]
    torn = [(0, numbers[:30]), (31, numbers[2:8]), (38, numbers[30:])]
    assert scanner.scan(torn)[1] == [("own", 0, 67, 1.0)]
    assert scanner.scan([(0, numbers + numbers)])[1] == [("own", 0, 59, 1.0), ("own", 60, 119, 1.0)]
    # A thousand copies are a thousand spans, and long templates need no square of memory.
    assert len(scanner.scan([(0, numbers * 1000)])[1]) == 1000
    long = licenses.Scanner(templates=(("long", " ".join(f"u{i % 97} v{i % 101}" for i in range(3000))),), phrases=())
    assert len(long.automaton.order) == 6000


def test_licenses(spark, docs, local):
    result = licenses.scan_licenses(docs).toPandas().set_index("doc_id")
    for doc_id, text in zip(local.doc_id, local.text):
        words = licenses.words_of(text)
        starts = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        row = result.loc[doc_id]
        assert (row.n_words, row.n_base) == (len(words), len(starts))
        assert row.base_labels == ",".join(sorted({label for _, label in starts}))
        if starts:
            assert (row.first_word, row.last_word) == (min(starts)[0], max(starts)[0])
    whole = licenses.TEMPLATES[0][1]
    cut = " ".join(w for i, w in enumerate(whole.split()) if i % 40)
    rows = [(1, "x " * 50 + cut + " y" * 50), (2, " ".join(whole.split()[:12])), (3, "the software is the software")]
    found = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].labels == "mit" and 0.8 < found[1].score <= 1 and found[2].labels == found[3].labels == ""


def test_simhash_against_brute_force(docs, local):
    from xxhash import xxh64_intdigest

    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
        counts = Counter(b for r in runs for h in [xxh64_intdigest(r.encode(), 42)] for b in range(64) if h >> b & 1)
        return sum(1 << b for b, n in counts.items() if 2 * n > len(runs))

    prints = {d: fingerprint(t) for d, t in zip(local.doc_id, local.text)}
    parent = {d: d for d in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    result = simhash.simhash_groups(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in result} == {d: (f"{p:016x}", root(d)) for d, p in prints.items()}


@pytest.mark.parametrize("pairwise", [2, 50])
def test_no_link_is_lost_in_crowded_buckets(spark, pairwise):
    shared_folder(spark)
    values = sorted(set(np.random.default_rng(1).integers(0, 1 << 18, 150).tolist()))
    prints = spark.createDataFrame([(v,) for v in values], "print long")
    found = dict(components.connected(simhash.close_pairs(prints, 2, 5, pairwise)).collect())
    want = {v: v for v in values}
    for _ in values:
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= 2 and want[b] > want[a]:
                    want[b] = want[a]
        if all(want[want[v]] == want[v] for v in values):
            break
    assert {v: found.get(v, v) for v in values} == want


def test_bucket_plans_cover_every_close_pair():
    for distance, segments in ((1, 3), (2, 4), (2, 5), (2, 6)):
        masks = [mask for _, mask in simhash.bucket_plans(distance, segments)]
        for a in range(64):
            for b in range(a + 1):
                difference = 1 << a | (1 << b if distance == 2 else 0)
                assert any(not difference & mask for mask in masks)


def test_one_document_of_each_group_stays(spark):
    """Exactly the rows of the smallest keys of `simhash_groups`, one of each, with odd keys and repeated rows."""
    shared_folder(spark)
    pick = random.Random(5)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "klmnp"]
    rows = []
    for i in range(60):
        base = pick.choices(words, k=400)
        rows += [(3 * i, " ".join(base), i), (3 * i + 1, " ".join(base), -i), (3 * i + 2, " ".join([*base[:-1], "changed"]), i)]
    rows += [(0, "another text for the first id", 7), (0, "another text for the first id", 8), (None, rows[0][1], 9), (None, "only here", 1), (None, "only here", 2), (5, None, 3), (4, "", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, identity long").withColumn("whole", F.lit(1)).withColumn("count", F.lit(2))
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    groups = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.simhash_groups(docs.where("doc_id is not null")).collect()}
    got = [(r.doc_id, r.text) for r in kept.collect()]
    wanted = {(d, t) for d, t, _ in rows if d is not None and any(k[0] == d and c == d for k, c in groups.items()) and t}
    least = {c for c in groups.values()}
    assert len(got) == len(set(got)) and {d for d, _ in got if d is not None} == least
    assert (None, "only here") in got and sum(d is None for d, _ in got) == 1 and sum(d == 0 for d, _ in got) == 2
    assert {(d, t) for d, t in got if d is not None and t} <= wanted


def recall_of(spark, ids, matrix, **options):
    """(share of the true 20 nearest that are found, smallest share of a query); scores and ranks are checked on the way."""
    shared_folder(spark)
    frame = spark.createDataFrame(list(zip(ids.tolist(), matrix.tolist())), "vec_id long, embedding array<double>")
    result = crosspolytope.nearest(frame, F.col("vec_id") % 20 == 0, **options).toPandas().groupby("query_id")
    shares = []
    for at in np.flatnonzero(ids % 20 == 0):
        score = matrix @ matrix[at]
        others = np.flatnonzero(ids != ids[at])
        best = ids[others[np.lexsort((ids[others], -score[others]))[:20]]]
        mine = result.get_group(ids[at]).sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, len(best) + 1))
        assert np.allclose(mine.score, [score[ids == i][0] for i in mine.vec_id], atol=1e-12) and (np.diff(mine.score) <= 0).all()
        shares.append(len(set(best) & set(mine.vec_id)) / len(best))
    return np.mean(shares), min(shares)


def clustered(seed, n, width=64):
    pick = np.random.default_rng(seed)
    rows = pick.normal(size=(40, width))[pick.integers(0, 40, n)] + pick.normal(size=(n, width))
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


@pytest.mark.parametrize("lengths", ["even", "one is ten times the others", "log-normal", "even or double"])
def test_neighbours_whatever_the_lengths(spark, lengths):
    """With tables, for 5,000 vectors; no query is left with few."""
    rows, pick = clustered(1, 5000), np.random.default_rng(2)
    if lengths.startswith("one"):
        rows[777] *= 10
    elif lengths == "log-normal":
        rows *= pick.lognormal(size=(len(rows), 1))
    elif lengths.startswith("even or"):
        rows *= pick.choice([1.0, 2.0], (len(rows), 1))
    mean, least = recall_of(spark, np.arange(len(rows)), rows)
    assert mean >= 0.95 and least >= 0.6


@pytest.mark.parametrize("n", [2, 21, 25, 60, 700])
def test_few_vectors_are_all_met(spark, n):
    assert recall_of(spark, np.arange(n), clustered(n, n)) == (1.0, 1.0)


def test_neighbours_do_not_switch_with_the_number_of_vectors(spark):
    """One vector more than are all met changes the cells that are looked into by next to nothing."""
    options = {"exact_classes": 240, "tables": 1, "probes": 0.05}
    assert recall_of(spark, np.arange(240), clustered(5, 240), **options) == (1.0, 1.0)
    assert recall_of(spark, np.arange(241), clustered(5, 241), **options)[0] >= 0.99


def test_queries_that_found_too_little_are_ranked_again(spark):
    """Vectors in opposite corners: the cells of most queries hold nearly nothing."""
    pick = np.random.default_rng(3)
    rows = np.concatenate([np.eye(64)[:1] + pick.normal(0, 1e-3, (400, 64)), pick.normal(size=(60, 64))])
    mean, _ = recall_of(spark, np.arange(len(rows)), rows, exact_classes=0, tables=1, probes=0.01)
    result = crosspolytope.nearest(
        spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>"),
        F.col("vec_id") % 20 == 0, exact_classes=0, tables=1, probes=0.01,
    )
    assert result.groupBy("query_id").count().where("count < 20").count() == 0 and mean > 0.3


def test_neighbours_of_repeated_ids_and_clashing_names(spark):
    shared_folder(spark)
    rows = [(i % 30, [float(i % 7), 1.0, float(i % 5), float(i % 11)]) for i in range(90)] + [(5, [0.0, 1.0, 5.0, 5.0])] * 40
    names = ["id", "vector", "class", "size", "spot", "hash", "ids", "norm", "asks", "n", "found"]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", *[F.lit("7").alias(c) for c in names])
    result = crosspolytope.nearest(frame, F.col("vec_id") % 5 == 0, 4)
    assert result.columns == ["query_id", "rank", "vec_id", "score"]
    distinct = sorted({(i, tuple(v)) for i, v in rows})
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in result.collect())
    want = []
    for i, v in distinct:
        if i % 5 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in distinct if j != i)[:4]
            want += [(i, place + 1, j, -s) for place, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_given_vectors(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas().sort_values("vec_id")
    mean, _ = recall_of(spark, frame.vec_id.to_numpy(), np.array(frame.embedding.tolist(), float), exact_classes=0)
    assert mean >= 0.94


def test_neighbours_with_copies_and_every_cell(spark):
    shared_folder(spark)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else [float(i % 7), 1.0, float(i % 5)]) for i in range(120)]
    rows += [(900, None), (901, []), (902, [0.0] * 3), (903, [1.0, None, 2.0]), (904, [float("nan"), 1.0, 1.0]), (None, [1.0, 2.0, 3.0]), (1000, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    result = crosspolytope.nearest(frame, F.col("vec_id") % 20 == 0, 20, probes=1.0).toPandas()
    usable = [(i, v) for i, v in rows if i is not None and i < 900]
    for i in range(0, 120, 20):
        vector = dict(usable)[i]
        want = sorted((-sum(a * b for a, b in zip(vector, v)), j) for j, v in usable if j != i)[:20]
        mine = result[result.query_id == i].sort_values("rank")
        assert list(zip(-mine.score, mine.vec_id)) == want


def test_pieces_are_the_librarys(docs, spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    odd = ["", " ", "  a  b\n\n\tc ", "日本語 🙂 ééé — “x”", "▁a ▁▁ b", "!!!!....,,,,    x" * 20, "a" * 500, "The THE 12345 http://www.example.com/a?b=c&d"]
    more = spark.createDataFrame([(-i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    result = pieces.decode_pieces(pieces.encode_pieces(docs.select("doc_id", "text").unionByName(more), MODEL), MODEL).collect()
    for r in result:
        assert list(r.ids) == library.encode(r.text)
        assert r.decoded == r.text or "▁" in r.text


def test_articles(spark):
    import html

    shared_folder(spark)
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    result = {r.page_id: r for r in extraction.main_text(pages).collect()}
    for r in pages.collect():
        article = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", x))).strip() for x in re.split("</?p>|</?h1>", article)]
        assert result[r.page_id].text == "\n".join(p for p in parts if p) and result[r.page_id].n_chars == len(result[r.page_id].text)


def test_frames_and_marks():
    page = (
        "<body><header>H</header><div class='cookie-notice'>c</div><main><header><h1>T &amp t</h1></header><p>a &lt; b<p>c<aside>s</aside>"
        "<ul><li>x<li>y</ul>t<br>u<form>f</form><section id=comments>r</section><script>if (a<b) '</p>'</script><!-- </main> --></main><footer>z"
    )
    assert [t for zone, t in markup.blocks_of(page) if zone == markup.ARTICLE] == ["T & t", "a < b", "c", "x", "y", "t u"]


def test_repeated_runs_of_a_host_go(spark):
    shared_folder(spark)
    frame = "<div>Start</div><div>About all of us</div>{}<div>All that you may want to know about the host itself</div>"
    rows = [(i, f"http://h.example/{i}", frame.format(f"<p>own text number n{i} of page p{i}</p>")) for i in range(5)]
    rows.append((9, "http://other.example/", frame.format("<p>alone</p>")))
    result = {r.page_id: r.text for r in extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(result[i] == f"own text number n{i} of page p{i}" for i in range(5)) and result[9].startswith("Start\nAbout")


def test_repeated_runs_do_not_depend_on_the_size_of_a_host(spark):
    shared_folder(spark)
    menu = "all that you may want to know about the host itself"
    blocks = lambda i: [f"own text number n{i} of page p{i}", "a b", *([menu] if i % 8 == 0 else []), f"rare line of the pages c{i // 3} d{i // 3} e{i // 3}", ""]
    rows = [("h", i, None, blocks(i)) for i in range(30)] + [("h", 0, None, blocks(0))] * 500
    read = spark.createDataFrame(rows, "host string, content long, text string, outside array<string>")
    small, copied, large = ({r.of_content: r.covered for r in extraction.repeated(read, n).collect()} for n in (1 << 20, 6000, 100))
    assert small == copied == large and sum(map(sum, small.values())) >= 30


def test_repeated_runs_judge_articles(spark):
    shared_folder(spark)
    notice = "<p>Tell all of your friends to read this paper each week</p>"
    own = lambda i: " ".join(f"word{i}x{j}" for j in range(30))
    rows = [(i, f"http://h.example/{i}", f"<nav>n{i}</nav><article><h1>Title {i}</h1><p>{own(i)}</p>{notice if i < 6 else ''}</article>") for i in range(8)]
    # Two of three articles share a block: fewer pages than a run needs.
    rows += [(i, f"http://few.example/{i}", f"<article><p>{own(i)}</p>{notice if i > 20 else ''}</article>") for i in range(20, 23)]
    # Near copies: runs cover most of their words.
    rows += [(i, f"http://copies.example/{i}", f"<main><p>No {i}</p><p>{own(30)}</p>{notice}</main>") for i in range(30, 35)]
    rows.append((0, "http://h.example/0", rows[0][2]))
    result = {r.page_id: r.text for r in extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    line = notice[3:-4]
    assert all(result[i] == f"Title {i}\n{own(i)}" for i in range(8))
    assert [result[i] for i in range(20, 23)] == [own(20), f"{own(21)}\n{line}", f"{own(22)}\n{line}"]
    assert all(result[i] == f"No {i}\n{own(30)}\n{line}" for i in range(30, 35))


def test_runs_of_articles_do_not_depend_on_groups(spark):
    shared_folder(spark)
    draw = np.random.default_rng(5)
    texts = []
    for i in range(60):
        lines = [" ".join(f"v{v}" for v in draw.integers(0, 4000, 25)) for _ in range(3)]
        lines += [f"line {k} that stands on a share of the pages é" for k in range(8) if draw.random() < 0.35 + 0.05 * k]
        texts.append("\n".join(lines))
    rows = [(i, "u", "h", text) for i, text in enumerate([*texts, *texts[:1] * 40])]
    read = spark.createDataFrame(rows, "key long, url string, host string, text string")
    stands = {}
    for i, text in enumerate(texts):
        for run in np.unique(extraction.windows(text.split("\n"))[0]).tolist():
            stands.setdefault(run, set()).add(i)
    want = sorted(run for run, on in stands.items() if len(on) >= 30)
    for chars, pages in ((1 << 20, 16), (2000, 16), (300, 1)):
        (found,) = extraction.article_runs(read, chars, pages).collect()
        assert found.of == "h" and sorted(found.repeats) == want and want
        kept = {r.key: r.text for r in extraction.judged(read, chars, pages).collect()}
        assert all(kept[i] == extraction.rest_of(text, extraction.covered_blocks(text.split("\n"), np.array(want))) for i, text in enumerate(texts)) and kept[0] == kept[60]
    assert sum(len(kept[i]) < len(text) for i, text in enumerate(texts)) > 30


def test_suffix_array():
    stream = np.array([1, 2, 1, 2, 3, 1, 2, 3, 9, 1])
    order, ranks = extraction.suffix_array(stream)
    assert order.tolist() == sorted(range(10), key=lambda i: stream[i:].tolist())
    prefix = extraction.common_prefixes(order, ranks)
    for k in range(1, 10):
        a, b = stream[order[k - 1] :].tolist(), stream[order[k] :].tolist()
        assert prefix[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_pipeline_against_brute_force(spark, docs, local):
    """Language keeps all with a letter, quality is its SQL, near-duplicates are all close prints, packing holds the rest."""
    result = corpus_pipeline.run(spark, SMALL)
    verdicts = check.connect(SMALL).execute(queries.SQL["op2_quality_rules"]).fetchdf()
    kept = set(verdicts[verdicts.kept].doc_id)
    prints = {r.key: r.print & (1 << 64) - 1 for r in simhash.fingerprints(docs).collect() if r.key in kept}
    group = {d: d for d in prints}
    for a in sorted(prints):
        for b in sorted(prints):
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    assert {r.doc_id for r in result.select("doc_id").distinct().collect()} == set(group.values())

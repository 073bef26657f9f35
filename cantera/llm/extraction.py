"""Main text of pages, with boilerplate found by suffix arrays over each host.

Pages are parsed into blocks. Markup only says which blocks may be text: those of the article
element without the frames inside it or, on a page without one, those outside all frames. The
blocks of a host's pages are joined into streams of words; in their suffix arrays, long runs of
words that stand on several distinct pages are next to each other. Blocks that such runs cover
are boilerplate, on every page, and the others its text. In an article, whose markup speaks for
its blocks, a run must stand on half of the host's articles, and one that runs cover for the
most part is a copy and stays.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantera.llm.markup import ARTICLE, OPEN, blocks_of
from cantera.llm.runs import blocks
from cantera.session import new_path

# Words (and block ends) a repeated run has at least, and distinct pages that show it.
RUN_WORDS = 6
RUN_PAGES = 3
# Share of a host's distinct articles that a run must stand on to be none of their text.
RUN_SHARE = 0.5
# Share of a block's words that must be covered.
COVERED = 0.8
# Characters of the streams that one suffix array takes; the runs of a host with more are counted by hash.
GROUP_CHARS = 1 << 20
# The same for articles, which are divided among several arrays, and the articles that such an
# array has at least, unless they hold many times its characters.
ARTICLE_CHARS = 1 << 18
ARTICLE_PAGES = 64
MOST_CHARS = 64
# Texts that a task remembers having sent on.
REMEMBERED = 1 << 18


def suffix_array(stream: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffixes in order, ranks of the first 1, 2, 4, ... tokens of every suffix), by doubling."""
    n = len(stream)
    rank = np.unique(stream, return_inverse=True)[1].astype(np.int64)
    ranks, step = [rank], 1
    while n and rank.max() < n - 1:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
        ranks.append(rank)
        step *= 2
    return np.argsort(rank, kind="stable"), ranks


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in order (0 for the first)."""
    n = len(order)
    length = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for level in range(len(ranks) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = inside.copy()
        same[inside] = ranks[level][a[inside]] == ranks[level][b[inside]]
        # Equal ranks count the stream's end as a token; the end is one page's own, so it is none here.
        step = 1 << level
        same &= (a + step <= n) & (b + step <= n)
        a, b = a + same * step, b + same * step
        length[1:] += same * step
    return length


def covered(stream: np.ndarray, page: np.ndarray, run_words: int = RUN_WORDS, run_pages: int = RUN_PAGES) -> np.ndarray:
    """True for the tokens in runs of `run_words` or more that stand on `run_pages` distinct pages."""
    n = len(stream)
    if not n:
        return np.zeros(0, bool)
    order, ranks = suffix_array(stream)
    prefix = common_prefixes(order, ranks)
    run = np.cumsum(prefix < run_words)
    seen = np.unique(np.column_stack([run, page[order]]), axis=0)
    pages = np.bincount(seen[:, 0], minlength=run.max() + 1)
    starts = order[pages[run] >= run_pages]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + run_words, n), -1)
    return np.cumsum(edge[:-1]) > 0


def boilerplate(pages: list[list[str]]) -> list[list[bool]]:
    """For every block of every page (all of one host): whether repeated runs cover it."""
    numbers: dict[str, int] = {}
    stream, page, owner = [], [], []
    for p, texts in enumerate(pages):
        stream.append(-2 - p)  # its own page begin, which no other page has
        page.append(p)
        owner.append(-1)
        for b, text in enumerate(texts):
            # Block ends are alike, so that short blocks in one order make a long run.
            words = [numbers.setdefault(w, len(numbers)) for w in text.split()]
            stream.extend([*words, -1])
            page.extend([p] * (len(words) + 1))
            owner.extend([b] * len(words) + [-1])
    page, owner = np.array(page, np.int64), np.array(owner, np.int64)
    marked = covered(np.array(stream, np.int64), page)
    verdicts = []
    for p, texts in enumerate(pages):
        low, high = np.searchsorted(page, [p, p + 1])
        own, hit = owner[low:high], marked[low:high]
        words = np.bincount(own[own >= 0], minlength=len(texts))
        hits = np.bincount(own[(own >= 0) & hit], minlength=len(texts))
        verdicts.append((hits >= COVERED * np.maximum(words, 1)).tolist())
    return verdicts


def folded(tokens: Iterable[np.ndarray]) -> np.ndarray:
    """Hashes of runs, from the hashes of their first tokens, of their second ones, and so on."""
    runs = np.uint64(0)
    for token in tokens:
        runs = (runs ^ (runs >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + token
    return runs.view(np.int64)


def windows(texts: list[str], run_words: int = RUN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the run from each token of a page on, block of each token or -1 at block ends); tokens as in `boilerplate`."""
    from xxhash import xxh64_intdigest

    tokens, owner = [], []
    for b, text in enumerate(texts):
        words = [xxh64_intdigest(w) for w in text.split()]
        tokens.extend([*words, 1])
        owner.extend([b] * len(words) + [-1])
    hashes = np.array(tokens, np.uint64)
    n = max(0, len(hashes) - run_words + 1)
    return folded(hashes[k : k + n] for k in range(run_words)), np.array(owner, np.int64)


def covered_blocks(texts: list[str], repeats: np.ndarray, run_words: int = RUN_WORDS) -> list[bool]:
    """For every block of a page, whether runs whose hash is in `repeats` cover it."""
    return covered_by(*windows(texts, run_words), repeats, len(texts), run_words)


def covered_by(runs: np.ndarray, owner: np.ndarray, repeats: np.ndarray, n_blocks: int, run_words: int = RUN_WORDS) -> list[bool]:
    """`covered_blocks` from what `windows` gives."""
    edge = np.zeros(len(owner) + 1, np.int64)
    starts = np.flatnonzero(np.isin(runs, repeats))
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + run_words, -1)
    hit = np.cumsum(edge[:-1]) > 0
    words = np.bincount(owner[owner >= 0], minlength=n_blocks)
    hits = np.bincount(owner[(owner >= 0) & hit], minlength=n_blocks)
    return (hits >= COVERED * np.maximum(words, 1)).tolist()


def repeated_widely(light: DataFrame) -> DataFrame:
    """What `repeated` gives, for hosts too large for one suffix array: runs are counted by hash over all pages of the host."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 100):
                part = batch.slice(first, 100)
                runs = [np.unique(windows(texts)[0]) for texts in part.column("outside").to_pylist()]
                lists = pa.array(runs, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("host", "content", "asks")), lists], names=["host", "content", "asks", "runs"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("outside").to_pylist(), batch.column("repeats").to_pylist())
            verdicts = [covered_blocks(texts, np.array(repeats or [], np.int64)) for texts, repeats in pairs]
            names = ["of_host", "of_content", "covered"]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("content"), pa.array(verdicts, pa.list_(pa.bool_()))], names=names)

    spelt = light.select("host", "content", "asks", "outside").mapInArrow(spell, "host string, content long, asks boolean, runs array<long>")
    rows = spelt.select("host", "content", "asks", F.explode("runs").alias("run"))
    often = rows.groupBy(F.col("host").alias("h"), F.col("run").alias("r")).count().where(F.col("count") >= RUN_PAGES).select("h", "r")
    shown = rows.where("asks").join(often, (F.col("host") == F.col("h")) & (F.col("run") == F.col("r")), "left_semi")
    shown = shown.groupBy(F.col("host").alias("h"), F.col("content").alias("c")).agg(F.collect_list("run").alias("repeats"))
    asking = light.where("asks").join(shown, (F.col("host") == F.col("h")) & (F.col("content") == F.col("c")), "left")
    return asking.select("host", "content", "outside", "repeats").mapInArrow(judge, "of_host string, of_content long, covered array<boolean>")


def parsed(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """`key`, `url`, `host`, `content` (hash of the html), `text` (null without an article), `zones`, `outside`.

    `text` holds the article's blocks as lines, none of them judged yet, `outside` the blocks
    outside the article in page order, `zones` the zone of each.
    """
    schema = T.StructType(
        [
            T.StructField("key", pages.schema[key].dataType),
            T.StructField("url", T.StringType()),
            T.StructField("content", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("zones", T.ArrayType(T.IntegerType())),
            T.StructField("outside", T.ArrayType(T.StringType())),
        ]
    )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "html"):
            texts, zones, outside = [], [], []
            for one in block.column("html").to_pylist():
                found = blocks_of(one or "")
                article = [text for zone, text in found if zone == ARTICLE]
                texts.append("\n".join(article) if article else None)
                rest = [(zone, text) for zone, text in found if zone != ARTICLE]
                zones.append([zone for zone, _ in rest])
                outside.append([text for _, text in rest])
            yield pa.RecordBatch.from_arrays(
                [
                    *(block.column(c) for c in ("key", "url", "content")),
                    pa.array(texts, pa.string()),
                    pa.array(zones, pa.list_(pa.int32())),
                    pa.array(outside, pa.list_(pa.string())),
                ],
                names=schema.names,
            )

    own = pages.select(
        F.col(f"`{key}`").alias("key"),
        F.col(f"`{url}`").cast("string").alias("url"),
        F.xxhash64(F.col(f"`{html}`")).alias("content"),
        F.col(f"`{html}`").cast("string").alias("html"),
    )
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    return own.mapInArrow(parse, schema).withColumn("host", host)


def repeated(read: DataFrame, group_chars: int = GROUP_CHARS) -> DataFrame:
    """(`of_host`, `of_content`, `covered`): for each distinct page without an article, which of its blocks repeat.

    Pages with the same html are one, also for the size of a host. The runs of a host of more
    than `group_chars` characters are counted in a shuffle over all its pages, so it fills no
    task and has the same result as in one suffix array.
    """
    light = read.select("host", "content", F.col("text").isNull().alias("asks"), "outside").dropDuplicates(["host", "content"])
    weight = F.aggregate("outside", F.lit(0).cast("long"), lambda n, x: n + F.char_length(x) + 1)
    sizes = light.groupBy(F.col("host").alias("of")).agg((F.sum(weight) > group_chars).alias("large"))
    sized = light.join(sizes, F.col("host") == F.col("of")).drop("of")

    def find(table: pa.Table) -> pa.Table:
        table = table.sort_by("content")
        verdicts = boilerplate(table.column("outside").to_pylist())
        result = table.select(["host", "content"]).rename_columns(["of_host", "of_content"])
        result = result.append_column("covered", pa.array(verdicts, pa.list_(pa.bool_())))
        return result.filter(table.column("asks"))

    schema = "of_host string, of_content long, covered array<boolean>"
    small = sized.where("NOT large").select("host", "content", "asks", "outside").groupBy("host").applyInArrow(find, schema)
    return small.unionByName(repeated_widely(sized.where("large")))


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(code of each word and block end of all texts, whose lines are blocks, number of them in each text, words by code)."""
    # Blocks have single spaces, so words and block ends are what stands between them.
    spaced = pc.binary_join_element_wise(pc.replace_substring(texts, "\n", " \n "), *(pa.scalar(x, texts.type) for x in ("\n", " ")))
    lists = pc.split_pattern(spaced, " ")
    words = lists.flatten().dictionary_encode()
    return words.indices.to_numpy().astype(np.int64), pc.list_value_length(lists).to_numpy(), words.dictionary


def spelt(words: pa.Array) -> np.ndarray:
    """Hashes of words and block ends as in `windows`."""
    from xxhash import xxh64_intdigest

    return np.array([1 if w == "\n" else xxh64_intdigest(w) for w in words.to_pylist()], np.uint64)


def windows_of(texts: pa.Array, run_words: int = RUN_WORDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`windows` of the lines of each text; every distinct word is hashed once."""
    stream, lengths, words = coded(texts)
    hashes = spelt(words)[stream]
    n = max(0, len(hashes) - run_words + 1)
    runs = folded(hashes[k : k + n] for k in range(run_words))
    ends = hashes == 1
    for high, length in zip(np.cumsum(lengths).tolist(), lengths.tolist()):
        end = ends[high - length : high]
        owner = np.cumsum(end) - end
        owner[end] = -1
        yield runs[high - length : max(high - length, high - run_words + 1)], owner


def common_runs(texts: pa.Array, share: float = RUN_SHARE, run_words: int = RUN_WORDS) -> np.ndarray:
    """Hashes (as in `windows`) of the runs that stand on at least `share` of the texts, whose lines are blocks."""
    stream, lengths, words = coded(texts)
    page = np.repeat(np.arange(len(texts)), lengths)
    n = len(stream) - run_words + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    order, ranks = suffix_array(stream)
    run = np.cumsum(common_prefixes(order, ranks) < run_words)
    inside = order < n
    inside[inside] = page[order[inside]] == page[order[inside] + run_words - 1]
    order, run = order[inside], run[inside]
    seen = np.unique(np.column_stack([run, page[order]]), axis=0)
    often = np.bincount(seen[:, 0])[run] >= share * len(texts) if len(run) else np.zeros(0, bool)
    starts = order[often][np.unique(run[often], return_index=True)[1]]
    if not len(starts):
        return np.zeros(0, np.int64)
    return folded(spelt(words.take(pa.array(stream[starts + k]))) for k in range(run_words))


def stored(frame: DataFrame, name: str) -> DataFrame:
    """`frame`, written and read again: Spark knows its size before it plans a join with it."""
    path = new_path(frame.sparkSession, name)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def article_runs(read: DataFrame, group_chars: int = ARTICLE_CHARS, group_pages: int = ARTICLE_PAGES) -> DataFrame:
    """(`of`, `repeats`): for each host, the hashes of the runs that stand on `RUN_SHARE` of its articles.

    Equal articles are one, and a run stands on `RUN_PAGES` of them at least. The articles of
    a host go to suffix arrays of about `group_chars` characters by a hash of their text. What
    stands on a share of all of them stands on that share in one of the arrays, so these name
    every run that can count; those are then counted over all articles of the host. The result
    does not depend on the groups.
    """
    articles = read.where(F.col("text").isNotNull()).select("host", F.xxhash64("text").alias("body"), "text")
    distinct = articles.groupBy("host", "body").agg(F.max(F.char_length("text")).alias("chars"))
    hosts = stored(distinct.groupBy(F.col("host").alias("of")).agg(F.count("*").alias("pages"), F.sum("chars").alias("chars")), "hosts")
    parts = F.least(F.ceil(F.col("chars") / group_chars), F.ceil(F.col("pages") / group_pages))
    parts = F.greatest(parts, F.ceil(F.col("chars") / (MOST_CHARS * group_chars)))
    large = stored(hosts.select("of", parts.alias("parts")).where("parts > 1"), "large")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Packed here, for Spark packs shuffled rows only lightly.
        codec, sent = pa.Codec("zstd", 1), set()
        for block in blocks(batches, "text"):
            if len(sent) > REMEMBERED:
                sent.clear()
            names = list(zip(block.column("host").to_pylist(), block.column("body").to_pylist()))
            new = [i for i, name in enumerate(names) if not (name in sent or sent.add(name))]
            block = block.take(pa.array(new, pa.int64()))
            texts = [text.encode() for text in block.column("text").to_pylist()]
            columns = [
                *(block.column(c) for c in ("host", "part", "body")),
                pa.array([len(text) for text in texts], pa.int64()),
                pa.array([codec.compress(text, asbytes=True) for text in texts], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "part", "body", "size", "packed"])

    def find(table: pa.Table) -> pa.Table:
        codec = pa.Codec("zstd")
        texts = [codec.decompress(p, n, asbytes=True).decode() for p, n in zip(table.column("packed").to_pylist(), table.column("size").to_pylist())]
        runs = common_runs(pa.array(texts, pa.large_string()))
        return pa.table({"of": pa.array([table.column("host")[0].as_py()] * len(runs), pa.string()), "run": pa.array(runs, pa.int64())})

    def spot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            pairs = zip(windows_of(block.column("text")), block.column("repeats").to_pylist())
            found = [np.unique(runs[np.isin(runs, np.array(repeats, np.int64))]) for (runs, _), repeats in pairs]
            columns = [block.column("host"), block.column("body"), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "body", "found"])

    part = F.pmod("body", F.coalesce("parts", F.lit(1).cast("long"))).alias("part")
    dealt = articles.join(large, F.col("host") == F.col("of"), "left").select("host", part, "body", "text")
    packed = dealt.mapInArrow(pack, "host string, part long, body long, size long, packed binary")
    # One shuffle serves the distinct texts and the groups.
    groups = packed.repartition("host", "part").dropDuplicates(["host", "part", "body"]).groupBy("host", "part")
    named = groups.applyInArrow(find, "of string, run long")
    lists = stored(named.groupBy("of").agg(F.collect_set("run").alias("repeats")), "named")
    seen = articles.join(lists, F.col("host") == F.col("of")).select("host", "body", "text", "repeats")
    seen = seen.mapInArrow(spot, "host string, body long, found array<long>")
    seen = seen.select("host", "body", F.explode("found").alias("run")).distinct().groupBy("host", "run").count()
    enough = F.greatest(F.lit(RUN_PAGES), RUN_SHARE * F.col("pages"))
    often = seen.join(hosts, F.col("host") == F.col("of")).where(F.col("count") >= enough)
    return stored(often.groupBy("of").agg(F.collect_set("run").alias("repeats")), "repeats")


def rest_of(text: str, marks: list[bool]) -> str:
    """The blocks (lines) of an article that are not marked; all, if the marked ones have half of its words."""
    texts = text.split("\n")
    if not any(marks):
        return text
    words = [len(t.split()) for t in texts]
    if 2 * sum(n for n, mark in zip(words, marks) if mark) >= sum(words):
        return text
    return "\n".join(t for t, mark in zip(texts, marks) if not mark)


def judged(read: DataFrame, group_chars: int = ARTICLE_CHARS, group_pages: int = ARTICLE_PAGES) -> DataFrame:
    """(`key`, `url`, `text`) of the pages with an article: its blocks without those that repeated runs cover."""
    schema = T.StructType([read.schema["key"], T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            texts, lists = block.column("text").to_pylist(), block.column("repeats").to_pylist()
            asked = [i for i, repeats in enumerate(lists) if repeats]
            for i, (runs, owner) in zip(asked, windows_of(block.column("text").take(pa.array(asked, pa.int64())))):
                marks = covered_by(runs, owner, np.array(lists[i], np.int64), texts[i].count("\n") + 1)
                texts[i] = rest_of(texts[i], marks)
            yield pa.RecordBatch.from_arrays([block.column("key"), block.column("url"), pa.array(texts, pa.string())], names=schema.names)

    runs = article_runs(read, group_chars, group_pages)
    articles = read.where(F.col("text").isNotNull()).join(runs, F.col("host") == F.col("of"), "left")
    return articles.select("key", "url", "text", "repeats").mapInArrow(judge, schema)


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of `pages`: `key`, `url`, `text` and `n_chars`.

    The text is what repeated runs leave. With an article (an `article` or `main` element, or
    a container named like one), they leave its blocks, without the frames in it, that no run
    on half of the host's articles covers, or all if those have half of its words: such an
    article is a copy. Otherwise it is the open blocks that no run on three of the host's
    pages covers, or all open blocks if runs cover every one of them. Null html is empty.
    Repeated rows have equal results. Other columns are left out. Pages are parsed once and
    kept in the shared folder.
    """
    read = stored(parsed(pages, key, url, html), "pages")
    asking = stored(read.where(F.col("text").isNull()).select(F.col("host").alias("asked")).distinct(), "asking")
    found = repeated(read.join(asking, F.col("host") == F.col("asked"), "left_semi"))
    opened = F.filter(F.arrays_zip("zones", "outside", "covered"), lambda x: x.zones == OPEN)
    unique = F.filter(opened, lambda x: ~x.covered)
    chosen = F.when(F.size(unique) > 0, unique).otherwise(opened)
    undecided = (
        read.where(F.col("text").isNull())
        .join(found, (F.col("host") == F.col("of_host")) & (F.col("content") == F.col("of_content")), "left")
        .select("key", "url", F.array_join(F.transform(chosen, lambda x: x.outside), "\n").alias("text"))
    )
    every = judged(read).unionByName(undecided)
    return every.select(F.col("key").alias(key), F.col("url").alias(url), "text", F.char_length("text").cast("long").alias("n_chars"))

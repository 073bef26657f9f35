"""How far the sources of a language differ, from an inverted index that is built in one pass.

Tasks index blocks of texts into postings until their memory is full, and spill term-sorted
runs. Runs meet by hash shard of their term, where Spark's external sort merges them, and equal
postings become frequencies. The divergence of two sources is what it would be if neither had
any term, and corrections: for the terms of either, counted by how often they occur, and for the
terms of both, which are streamed from the index and summed by pair before anything is shuffled.

All arithmetic is on whole numbers. A share is a probability in units of 10^-9, add-one smoothed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantera.llm.runs import Runs, blocks, byte_class, changes

TERM_BYTE = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
BLOCK = 6 << 20
# Postings a task holds before it spills a run.
MEMORY = 48 << 20
MIN_DOCS = 3
TOP_TERMS = 200
# Groups that are sent to every task, some 10 MB. Pairs of more, in one language, would be 10^10 rows.
MOST_GROUPS = 100_000
# Pairs of postings that are worked on at a time, and pairs of sources that a task sums in place.
PAIRS_AT_ONCE, SUMMED = 1 << 20, 1 << 21


def filled(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def index_runs(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", memory: int = MEMORY) -> DataFrame:
    """Runs of postings: `lang`, `term`, `source`, `n` (occurrences) and `docs` (texts that hold it).

    Terms are runs of letters and of non-ASCII characters, only A-Z in lower case. A posting
    comes once for each run that has it; runs are sorted by language, term and source.
    """
    names = ["lang", "term", "source", "n", "docs"]

    def summed(parts: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(parts).group_by(names[:3]).aggregate([("n", "sum"), ("docs", "sum")])
        return table.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select(names)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for block in blocks(batches, "text", BLOCK):
            runs = Runs(pc.ascii_lower(block.column("text")), changes(TERM_BYTE), keep=TERM_BYTE)
            if not len(runs.codes):
                continue
            langs, sources = block.column("lang").dictionary_encode(), block.column("source").dictionary_encode()
            many = len(sources.dictionary)
            group = langs.indices.to_numpy().astype(np.int64) * many + sources.indices.to_numpy()
            width = len(runs.words)
            # Occurrences in each text, then texts and occurrences in each group.
            pair, times = np.unique(runs.text_of * width + runs.codes, return_counts=True)
            posting, where = np.unique(group[pair // width] * width + pair % width, return_inverse=True)
            n = np.zeros(len(posting), np.int64)
            np.add.at(n, where, times)
            of = posting // width
            part = pa.table(
                [
                    langs.dictionary.take(pa.array(of // many)),
                    runs.words.take(pa.array(posting % width)).cast(pa.string()),
                    sources.dictionary.take(pa.array(of % many)),
                    pa.array(n),
                    pa.array(np.bincount(where, minlength=len(posting))),
                ],
                names=names,
            )
            held.append(part)
            size += part.nbytes
            if size > memory:
                held = [summed(held)]
                size = held[0].nbytes
                if 2 * size > memory:
                    yield from held.pop().sort_by([(c, "ascending") for c in names[:3]]).to_batches(max_chunksize=20_000)
                    size = 0
        if held:
            yield from summed(held).sort_by([(c, "ascending") for c in names[:3]]).to_batches(max_chunksize=20_000)

    rows = docs.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), filled(lang).alias("lang"), filled(source).alias("source"))
    return rows.mapInArrow(index, "lang string, term string, source string, n long, docs long")


def frequencies(runs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The kept terms: `lang`, `term`, `total` and `postings` (source, n), of terms in `min_docs` texts of the language.

    One shuffle, by language and term, brings the postings of a term together. They are at most
    as many as the language has sources, times the runs, and summed as they are merged.
    """
    sharded = runs.repartition("lang", "term")
    postings = sharded.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return (
        postings.groupBy("lang", "term")
        .agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("postings"))
        .where(F.col("docs") >= min_docs)
        .select("lang", "term", "total", "postings")
    )


def share(n: str, size: str) -> Column:
    """1 + floor(10^9 (n + 1) / size) of two long columns, three digits at a time: no product leaves a long."""
    first = f"(({n} + 1) * 1000)"
    second = f"({first} % {size} * 1000)"
    third = f"({second} % {size} * 1000)"
    return F.expr(f"1 + {first} div {size} * 1000000 + {second} div {size} * 1000 + {third} div {size}")


def shares(n: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The same on arrays."""
    total, rest = np.ones(np.broadcast_shapes(np.shape(n), np.shape(size)), np.int64), n + 1
    for digits in (1_000_000, 1000, 1):
        total += rest * 1000 // size * digits
        rest = rest * 1000 % size
    return total


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q)."""
    return (p - q) ** 2 // q


@dataclass
class Groups:
    """The sources of every language in order, with the size (occurrences and vocabulary) of each."""

    sources: dict[str, pa.Array]
    sizes: dict[str, np.ndarray]


def group_sizes(docs: DataFrame, kept: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """One row for each language and source that occur: `n` occurrences of kept terms, `terms` kept and `lang_n` of the language."""
    every = docs.select(filled(lang).alias("lang"), filled(source).alias("source")).distinct()
    own = kept.select("lang", F.explode("postings").alias("one")).groupBy("lang", "one.source").agg(F.sum("one.n").alias("n"))
    whole = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_n"))
    none = F.lit(0).cast("long")
    return (
        every.join(own, ["lang", "source"], "left")
        .join(whole, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, none).alias(c) for c in ("n", "terms", "lang_n")])
    )


def known_groups(sized: DataFrame) -> Groups:
    """The groups as arrays; their number is counted before they are fetched."""
    if sized.limit(MOST_GROUPS + 1).count() > MOST_GROUPS:
        raise ValueError(f"over {MOST_GROUPS} sources: their pairs are no report")
    table = sized.select("lang", "source", (F.col("n") + F.col("terms")).alias("size")).toArrow().combine_chunks().sort_by([("lang", "ascending"), ("source", "ascending")])
    sources, sizes = {}, {}
    langs = table.column("lang")
    for one in pc.unique(langs).to_pylist():
        mine = table.filter(pc.equal(langs, one))
        sources[one], sizes[one] = mine.column("source").combine_chunks(), mine.column("size").to_numpy()
    return Groups(sources, sizes)


PARTIAL = "lang string, source string, item string, value decimal(38,0)"


def _rows(groups: Groups, lang: str, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(a), 20_000):
        j = i + 20_000
        names = groups.sources[lang]
        columns = [pa.repeat(pa.scalar(lang), len(a[i:j])), names.take(pa.array(a[i:j])), names.take(pa.array(b[i:j]))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(value[i:j]).cast(pa.decimal128(38, 0))], names=["lang", "source", "item", "value"])


def shared_terms(kept: DataFrame, groups: Groups) -> DataFrame:
    """Corrections for the terms that both sources of a pair have, summed by pair within each task."""
    context = kept.sparkSession.sparkContext
    shared = context.broadcast(groups)

    def corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = shared.value
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang in pc.unique(batch.column("lang")).to_pylist():
                lists = batch.filter(pc.equal(batch.column("lang"), lang)).column("postings")
                posting = lists.flatten()
                source = pc.index_in(posting.field("source"), groups.sources[lang]).to_numpy(zero_copy_only=False).astype(np.int64)
                size = groups.sizes[lang]
                p, none = shares(posting.field("n").to_numpy(), size[source]), shares(np.zeros(len(size), np.int64), size)
                length = pc.list_value_length(lists).to_numpy().astype(np.int64)
                first = np.cumsum(length) - length
                begin, many = np.repeat(first, length), np.repeat(length, length)
                S = len(size)
                # Postings one after another, each with all of its term, some pairs at a time.
                edges = np.concatenate([[0], np.cumsum(many)])
                i = 0
                while i < len(many):
                    j = max(i + 1, int(np.searchsorted(edges, edges[i] + PAIRS_AT_ONCE, "right")) - 1)
                    x = np.repeat(np.arange(i, j), many[i:j])
                    y = np.arange(len(x)) - np.repeat(edges[i:j] - edges[i], many[i:j]) + np.repeat(begin[i:j], many[i:j])
                    a, b = source[x], source[y]
                    value = gap(p[x], p[y]) - gap(p[x], none[b]) - gap(none[a], p[y]) + gap(none[a], none[b])
                    if S * S <= SUMMED:
                        np.add.at(sums.setdefault(lang, np.zeros(S * S, np.int64)), a * S + b, value)
                    else:
                        pair, where = np.unique(a * S + b, return_inverse=True)
                        total = np.zeros(len(pair), np.int64)
                        np.add.at(total, where, value)
                        yield from _rows(groups, lang, pair // S, pair % S, total)
                    i = j
        for lang, total in sums.items():
            pair = np.flatnonzero(total)
            yield from _rows(groups, lang, pair // len(groups.sizes[lang]), pair % len(groups.sizes[lang]), total[pair])

    return kept.select("lang", "postings").mapInArrow(corrections, PARTIAL)


def own_terms(kept: DataFrame, groups: Groups) -> DataFrame:
    """Corrections for the terms that one source of a pair has, as if the other had none of them.

    Terms of a source that occur equally often count alike, so what is worked on is, for each
    source, its numbers of occurrences.
    """
    shared = kept.sparkSession.sparkContext.broadcast(groups)
    times = (
        kept.select("lang", F.explode("postings").alias("one"))
        .groupBy("lang", F.col("one.source").alias("source"), F.col("one.n").alias("n"))
        .agg(F.count(F.lit(1)).alias("terms"))
    )

    def corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = shared.value
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for lang in pc.unique(batch.column("lang")).to_pylist():
                mine = table.filter(pc.equal(table.column("lang"), lang))
                size = groups.sizes[lang]
                S = len(size)
                none = shares(np.zeros(S, np.int64), size)
                source = pc.index_in(mine.column("source"), groups.sources[lang]).to_numpy().astype(np.int64)
                p, weight = shares(mine.column("n").to_numpy(), size[source]), mine.column("terms").to_numpy()
                for one in np.unique(source).tolist():
                    own = np.flatnonzero(source == one)
                    there, back = np.zeros(S, np.int64), np.zeros(S, np.int64)
                    step = max(1, PAIRS_AT_ONCE // S)
                    for i in range(0, len(own), step):
                        some = own[i : i + step]
                        a, w = p[some][:, None], weight[some][:, None]
                        there += (w * (gap(a, none) - gap(none[one], none))).sum(axis=0)
                        back += (w * (gap(none[None, :], a) - gap(none, none[one]))).sum(axis=0)
                    every, me = np.arange(S), np.full(S, one)
                    yield from _rows(groups, lang, np.concatenate([me, every]), np.concatenate([every, me]), np.concatenate([there, back]))

    return times.select("lang", "source", "n", "terms").mapInArrow(corrections, PARTIAL)


def pair_values(kept: DataFrame, sized: DataFrame, groups: Groups) -> DataFrame:
    """(`lang`, `source`, `item`, `value`) for every two different sources of a language, in both directions."""
    corrections = shared_terms(kept, groups).unionByName(own_terms(kept, groups))
    corrections = corrections.where("source <> item").groupBy("lang", "source", "item").agg(F.sum("value").alias("correction"))
    one = sized.where("terms > 0").select("lang", "source", "terms", F.lit(0).cast("long").alias("zero"), (F.col("n") + F.col("terms")).alias("size"))
    one = one.withColumn("p", share("zero", "size"))
    every = sized.select("lang", "source", "terms").join(one.select("lang", "source", "p"), ["lang", "source"], "left")
    other = every.select("lang", F.col("source").alias("item"), F.col("p").alias("q"))
    base = F.expr("cast(terms as decimal(38,0)) * ((p - q) * (p - q) div q)")
    return (
        every.join(other, "lang")
        .where("source <> item")
        .select("lang", "source", "item", F.coalesce(base, F.lit(0)).alias("base"))
        .join(corrections, ["lang", "source", "item"], "left")
        .select("lang", "source", "item", (F.col("base") + F.coalesce("correction", F.lit(0))).cast("long").alias("value"))
    )


def term_values(kept: DataFrame, sized: DataFrame) -> DataFrame:
    """(`lang`, `source`, `item`, `value`) for the terms that a source has more of than its language."""
    postings = kept.select("lang", F.col("term").alias("item"), "total", F.explode("postings").alias("one"))
    rows = postings.select("lang", F.col("one.source").alias("source"), "item", F.col("one.n").alias("own"), "total")
    small = sized.select("lang", "source", (F.col("n") + F.col("terms")).alias("size"), (F.col("lang_n") + F.col("terms")).alias("lang_size"))
    # `known_groups` has counted the groups.
    told = rows.join(F.broadcast(small), ["lang", "source"]).select(
        "lang", "source", "item", share("own", "size").alias("p"), share("total", "lang_size").alias("q")
    )
    return told.where("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))


def ranked(values: DataFrame, part: str, most: int | None = None) -> DataFrame:
    order = F.expr("row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)").cast("int")
    rows = values.select("lang", "source", F.lit(part).alias("part"), "item", "value", order.alias("rank"))
    return rows.where(F.col("rank") <= most) if most else rows


def audit(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP_TERMS
) -> DataFrame:
    """(`lang`, `source`, `part`, `item`, `value`, `rank`): how each source differs from the others and from its language.

    Part `pair`: for every other source of the language, the sum over the language's kept terms
    of floor((p - q)^2 / q), p and q being the shares of a term in the two sources. Part `term`:
    the `top` terms that the source has more of than its language, by the same measure. Ranks
    count from 1, largest value first, ties in byte order of the item. A kept term is in
    `min_docs` texts of its language. Null texts, languages and sources are empty strings; a
    source without terms has its pairs too; repeated rows are texts of their own, and other
    columns have no effect, whatever their names. An empty table gives an empty one.
    """
    kept = frequencies(index_runs(docs, text, lang, source), min_docs).checkpoint()
    sized = group_sizes(docs, kept, lang, source).checkpoint()
    pairs = ranked(pair_values(kept, sized, known_groups(sized)), "pair")
    return pairs.unionByName(ranked(term_values(kept, sized), "term", top))

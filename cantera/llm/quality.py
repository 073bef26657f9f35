"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each text is measured once, in the JVM. The measures of every (language, source) go into KLL
sketches; merging those gives one sketch per language and one for everything, without a second
look at the rows. A fence per measure comes from the lower quartile and the median of the
smallest group that has enough rows, so a source may hold up to half junk before its fences
move. The fences are joined to the rows, which are judged in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

# Measure: how far from the median it may always lie, and how many median-to-quartile spreads it
# may lie away where those are more. Rates that are zero in most texts have no spread, so what is
# always allowed decides there; the length of words has one in every group.
UPPER = {
    "symbol_rate": (0.2, 6.0),
    "repeat_rate": (0.3, 6.0),
    "dup_line_rate": (0.4, 6.0),
    "word_length": (1.0, 12.0),
}
# Measures with a fence below as well.
LOWER = ("word_length",)
# KLL keeps this many values exactly before it starts to summarise.
SKETCH_K = 4096
# A group with fewer measured rows takes the fences of its language, then those of all rows.
MIN_ROWS = 100
# Fences of up to this many groups, a few MB, are broadcast; more are joined by shuffling.
BROADCAST_GROUPS = 50_000


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, in order; null gives none."""
    return F.coalesce(F.array_remove(F.split(text, SPACE), ""), F.array().cast("array<string>"))


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `COUNTS` of every whole text (long; columns of these names are replaced).

    A null or empty text counts zero everywhere. A line repeats if it has a word and equals an
    earlier line exactly. A word repeats if it lies in a window of three words that occurs
    twice or more in its text; windows are compared by 64-bit hashes of their words.
    """
    columns = [c for c in docs.columns if c.lower() not in COUNTS]
    words, windows, ordered, at = "words", "windows", "ordered", "at"
    n = F.size(words)
    # The last two words start no window.
    hashed = F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )
    none = F.array().cast("array<bigint>")
    source = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(source, "\n"), lambda line: line.rlike(WORD_CHAR))
    # Three words from each repeated window, less what the next one covers again.
    covered = F.aggregate(
        F.zip_with(
            at,
            F.slice(at, F.lit(2), F.greatest(F.size(at), F.lit(0))),
            lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))),
        ),
        F.lit(0),
        lambda total, x: total + x,
    )
    return (
        # The row travels as one value, so that no name of its own can clash.
        docs.select(
            F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in columns]).alias("row"),
            F.col(f"`{text}`").cast("string").alias("text"),
            words_of(F.col(f"`{text}`").cast("string")).alias(words),
        )
        .withColumn(windows, F.when(n >= 3, hashed).otherwise(none))
        # Most texts repeat no window; only the others are sorted.
        .withColumn(
            ordered,
            F.when(
                F.size(F.array_distinct(windows)) < F.size(windows),
                F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            ),
        )
        .withColumn(
            at,
            F.sort_array(
                F.transform(
                    F.filter(
                        ordered,
                        lambda x, i: x.h.eqNullSafe(F.get(ordered, i - 1).h) | x.h.eqNullSafe(F.get(ordered, i + 1).h),
                    ),
                    lambda x: x.i,
                )
            ),
        )
        # One value through a generator: conditions on the counts are not moved below it, where
        # the steps above would be worked out anew for every element.
        .select(
            "row",
            F.explode(
                F.array(
                    F.struct(
                        n.cast("long").alias("n_words"),
                        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
                        (F.char_length(source) - F.char_length(F.regexp_replace(source, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
                    )
                )
            ).alias("counts"),
        )
        .select(*[F.col(f"row.`{c}`") for c in columns], "counts.*")
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def measures() -> dict[str, Column]:
    """Rates per word; null where a text has no word, so that it enters no sketch."""
    words = F.when(F.col("n_words") > 0, F.col("n_words"))
    return {
        "symbol_rate": F.col("n_symbols") / words,
        "repeat_rate": F.col("n_repeat_words") / words,
        "dup_line_rate": F.col("n_dup_lines") / (F.col("n_dup_lines") + words / 8),
        "word_length": F.col("word_chars") / words,
    }


def fences(counts: DataFrame, by: Sequence[str] = ("lang", "source"), min_rows: int = MIN_ROWS) -> DataFrame:
    """One row per group of `by`: its keys `by_0`, `by_1` ... (null is a value), `fence_<measure>` and `floor_<measure>`.

    A group has the fences of its longest prefix of keys that holds `min_rows` measured rows,
    or else those of all rows. The result is checkpointed: summaries of very many values are
    drawn at random, and every row must be judged by one draw.
    """
    keys = [f"by_{i}" for i in range(len(by))]
    sketches = counts.groupBy(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)]).agg(
        *[F.kll_sketch_agg_double(m, F.lit(SKETCH_K)).alias(f"s_{name}") for name, m in measures().items()]
    )
    sketches = sketches.checkpoint()

    def limits(frame: DataFrame, tag: str) -> DataFrame:
        def quantile(name: str, p: float) -> Column:
            return F.when(
                F.kll_sketch_get_n_double(f"s_{name}") > 0, F.kll_sketch_get_quantile_double(f"s_{name}", F.lit(p))
            )

        def reach(name: str) -> Column:
            slack, spreads = UPPER[name]
            return F.greatest(F.lit(slack), spreads * (quantile(name, 0.5) - quantile(name, 0.25)))

        fields = [(quantile(name, 0.5) + reach(name)).alias(f"fence_{name}") for name in UPPER]
        fields += [(quantile(name, 0.5) - reach(name)).alias(f"floor_{name}") for name in LOWER]
        rows = F.kll_sketch_get_n_double("s_word_length")
        own = [c for c in frame.columns if c in keys]
        return frame.select(*own, F.struct(rows.alias("rows"), *fields).alias(tag))

    levels = {len(keys): limits(sketches, f"level_{len(keys)}")}
    merged = [F.kll_merge_agg_double(f"s_{name}", F.lit(SKETCH_K)).alias(f"s_{name}") for name in UPPER]
    for depth in range(len(keys) - 1, -1, -1):
        group = keys[:depth]
        wider = sketches.groupBy(*group).agg(*merged) if group else sketches.agg(*merged)
        levels[depth] = limits(wider, f"level_{depth}")
    result = levels[len(keys)]
    for depth in range(len(keys) - 1, 0, -1):
        wider = levels[depth].select(*[F.col(k).alias(f"w_{k}") for k in keys[:depth]], f"level_{depth}")
        same = [F.col(k).eqNullSafe(F.col(f"w_{k}")) for k in keys[:depth]]
        condition = same[0]
        for other in same[1:]:
            condition = condition & other
        result = result.join(wider, condition, "left").drop(*[f"w_{k}" for k in keys[:depth]])
    # The one row for everything is small by construction.
    result = result.crossJoin(F.broadcast(levels[0]))
    chosen = F.col("level_0")
    for depth in range(1, len(keys) + 1):
        chosen = F.when(F.col(f"level_{depth}.rows") >= min_rows, F.col(f"level_{depth}")).otherwise(chosen)
    names = [*[f"chosen.fence_{n}" for n in UPPER], *[f"chosen.floor_{n}" for n in LOWER]]
    return result.select(*keys, chosen.alias("chosen")).select(*keys, *names).checkpoint()


def judged(counts: DataFrame, limits: DataFrame, by: Sequence[str] = ("lang", "source")) -> DataFrame:
    """`counts` with `base_failed` and `kept`: no base failure and no measure beyond its fence."""
    plain = [c for c in counts.columns if c.lower() not in ("base_failed", "kept")]
    marked = counts.select(
        F.struct(*[F.col(f"`{c}`") for c in plain]).alias("row"),
        *[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(by)],
        F.struct(*[m.alias(name) for name, m in measures().items()]).alias("measured"),
        base_failed().alias("base_failed"),
    )
    condition = F.lit(True)
    for i in range(len(by)):
        condition = condition & F.col(f"own_{i}").eqNullSafe(F.col(f"by_{i}"))
    beyond = F.lit(False)
    for name in UPPER:
        beyond = beyond | F.coalesce(F.col(f"measured.{name}") > F.col(f"fence_{name}"), F.lit(False))
    for name in LOWER:
        beyond = beyond | F.coalesce(F.col(f"measured.{name}") < F.col(f"floor_{name}"), F.lit(False))
    # The number of groups is counted; only few enough of them are sent to every task.
    few = limits.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    return marked.join(F.broadcast(limits) if few else limits, condition, "left").select(
        *[F.col(f"row.`{c}`") for c in plain], "base_failed", (~F.col("base_failed") & ~beyond).alias("kept")
    )


def quality_rules(docs: DataFrame, text: str = "text", by: Sequence[str] = ("lang", "source")) -> DataFrame:
    """`docs` with `COUNTS`, `base_failed` and `kept`; every row stays, `kept` says the verdict.

    Texts are measured twice, once for the fences and once for the rows, so that no text is
    shuffled or written. Null languages and sources are groups of their own. Repeated rows get
    the same verdict. An empty table gives an empty one.
    """
    counts = counted(docs, text)
    return judged(counts, fences(counts, by), by)


def quality_report(docs: DataFrame, key: str = "doc_id", text: str = "text", by: Sequence[str] = ("lang", "source")) -> DataFrame:
    """`key`, `COUNTS`, `base_failed` and `kept` of every row; texts are measured once."""
    counts = counted(docs.select(key, text, *by), text).drop(text).checkpoint()
    return judged(counts, fences(counts, by), by).drop(*by)

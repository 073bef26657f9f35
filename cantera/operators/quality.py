"""Counts, rates and rule reports. Each report is one pass with partial aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cantera.functions import checks as C


def stage_gate(stages: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """(stage, items, minimum, ready), one row per stage."""
    rows = [
        df.agg(F.count(F.lit(1)).alias("items")).select(
            F.lit(name).alias("stage"),
            "items",
            F.lit(minimum).cast("long").alias("minimum"),
            (F.col("items") >= minimum).alias("ready"),
        )
        for name, (df, minimum) in stages.items()
    ]
    report = rows[0]
    for row in rows[1:]:
        report = report.unionByName(row)
    return report


def run_report(outcomes: DataFrame, *by: str) -> DataFrame:
    """Counts of a run; `outcomes` has one row per item, with `saved`, `is_new`, `letra`.

    The failed items themselves are rows of `failures`, so their number has no bound.
    """
    return outcomes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if("saved").alias("saved"),
        F.count_if(~F.col("saved")).alias("failed"),
        F.count_if(F.col("saved") & F.col("is_new")).alias("new_items"),
        F.coalesce(F.sum(F.when(F.col("saved"), F.length("letra"))), F.lit(0)).cast("long").alias("characters"),
    )


def failures(outcomes: DataFrame, id: str) -> DataFrame:
    """(id, reason) of every item that was not saved."""
    return outcomes.filter(~F.col("saved")).select(id, "reason")


def observe_run(outcomes: DataFrame, name: str = "run") -> tuple[DataFrame, Observation]:
    """The same rows, with live counters filled by whichever action writes them."""
    counters = Observation(name)
    observed = outcomes.observe(
        counters,
        F.count(F.lit(1)).alias("processed"),
        F.count_if("saved").alias("saved"),
        F.count_if(~F.col("saved")).alias("failed"),
    )
    return observed, counters


def completeness(df: DataFrame, columns: Sequence[str], *by: str) -> DataFrame:
    """Percentage of rows that hold a value, per column."""
    rates = [(F.avg(F.col(c).isNotNull().cast("double")) * 100).alias(f"{c}_pct") for c in columns]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("items"), *rates)


def rate(part: Column, total: Column) -> Column:
    """Share in percent, null of nothing."""
    return part * 100.0 / F.nullif(total, F.lit(0))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def case_variants(df: DataFrame, name: str) -> DataFrame:
    """Names that differ only by case: (lower-case name, variants, occurrences).

    Spellings are counted first, so a name that fills the table is a few rows afterwards.
    """
    spellings = df.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    lowered = spellings.groupBy(F.lower(name).alias("lowered"))
    return lowered.agg(F.count(F.lit(1)).alias("variants"), F.sum("n").alias("occurrences")).filter("variants > 1")


def name_variants(df: DataFrame, name: str, collation: str = "UNICODE_CI") -> DataFrame:
    """Names that a collation holds equal: (the smallest spelling, variants, occurrences).

    Unlike lower case, ICU's rules know that both small sigmas are one letter and a ligature its
    letters; "UNICODE_CI_AI" leaves accents out of account too, and takes ß for SS. Spellings
    are counted first.
    """
    spellings = df.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("spelling")).agg(F.count(F.lit(1)).alias("n"))
    alike = spellings.groupBy(F.collate("spelling", collation).alias("alike"))
    counted = alike.agg(F.min("spelling").alias(name), F.count(F.lit(1)).alias("variants"), F.sum("n").alias("occurrences"))
    return counted.filter("variants > 1").drop("alike")


@dataclass(frozen=True)
class Rule:
    name: str
    passes: Column


def song_rules(title: str, artist: str, lyric: str, required: Sequence[str], types: dict[str, str]) -> list[Rule]:
    """The catalogue's rules: filled texts, plausible lyrics, required fields, field types."""
    rules = [Rule(f"{c}_filled", C.is_filled(F.col(c))) for c in (title, artist, lyric)]
    rules.append(Rule(f"{lyric}_plausible", C.is_plausible_lyric(F.col(lyric))))
    rules += [Rule(f"{c}_present", F.col(c).isNotNull()) for c in required]
    rules += [Rule(f"{c}_is_{t}", ~C.fails_cast(F.col(c), t)) for c, t in types.items()]
    return rules


def dq_report(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule, passed, failed) from one pass over the rows."""
    totals = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.coalesce(rule.passes, F.lit(False))).alias(f"r{i}") for i, rule in enumerate(rules)],
    )
    rows = [
        F.struct(
            F.lit(rule.name).alias("rule"),
            F.col(f"r{i}").alias("passed"),
            (F.col("total") - F.col(f"r{i}")).alias("failed"),
        )
        for i, rule in enumerate(rules)
    ]
    return totals.select(F.inline(F.array(*rows)))

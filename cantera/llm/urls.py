"""Rules on hosts and paths, looked up by hashed expressions.

A url is expanded into every pair of a suffix of its host and a prefix of its path that a rule
could have. The pairs meet the rules on the first 32 bits of their SHA-256 digests, and the
full digests must agree. The rule with the longest host and path wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_HEX = 8


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host up to `/`, `?`, `#` or the end, A-Z lower-cased; path up to `?`, `#` or the end.

    Null and urls without `://` have both empty.
    """
    # (?s): a url may hold line breaks.
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def digest(host: Column, path: Column) -> Column:
    """Digest of a host and a path; the length keeps the two apart."""
    return F.sha2(F.concat(F.char_length(host).cast("string"), F.lit(":"), host, path).cast("binary"), 256)


def expressions(urls: DataFrame, labels: list[int], lengths: list[int]) -> DataFrame:
    """One row per url and expression: suffixes of 1..n labels in `labels`, prefixes of `lengths` code points.

    Nothing else can be equal to a rule, so that very long hosts and paths stay cheap.
    """
    parts = F.split("host", r"\.")
    suffixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in labels]), lambda n: n <= F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."),
    )
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.char_length("path")),
        lambda n: F.substring(F.col("path"), F.lit(1), n),
    )
    return (
        urls.withColumn("suffix", F.explode(suffixes))
        .withColumn("prefix", F.explode(prefixes))
        .withColumn("digest", digest(F.col("suffix"), F.col("prefix")))
        .select("url", F.substring("digest", 1, PREFIX_HEX).alias("short"), "digest")
    )


def prepared_rules(rules: DataFrame) -> DataFrame:
    """`rules` (host, path, verdict) with digests, one per host and path; block wins over allow."""
    host = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER)
    path = F.coalesce("path", F.lit(""))
    return (
        rules.select(host.alias("host"), path.alias("path"), "verdict")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .select(
            "verdict",
            F.concat("host", "path").alias("rule"),
            F.char_length("host").alias("host_length"),
            F.char_length("path").alias("path_length"),
            F.size(F.split("host", r"\.")).alias("labels"),
            digest(F.col("host"), F.col("path")).alias("digest"),
        )
        .withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """`pages` with `host`, `path`, `rule` (null if none fits) and `verdict` (`default` if none fits).

    A rule fits its host and all subdomains if the path starts with the rule's path. The longest
    rule (host and path together) wins, then the longer host; one host and path with both
    verdicts blocks. Null urls and urls without `://` fit no rule but one with an empty host.
    Columns of these names in `pages` are replaced. Each distinct url is judged once: a url or
    host that holds many rows is reduced before it is shuffled, and the rows meet their
    verdicts in a plain join that adaptive execution can split.
    """
    known = prepared_rules(rules)
    shapes = known.agg(F.collect_set("labels").alias("labels"), F.collect_set("path_length").alias("lengths")).first()
    host, path = url_parts(F.col("url"))
    distinct = (
        pages.select(F.col(f"`{url}`").alias("url")).where(F.col("url").isNotNull()).distinct().select("url", host.alias("host"), path.alias("path"))
    )
    better = F.struct(F.col("host_length") + F.col("path_length"), F.col("host_length"), F.col("verdict"), F.col("rule"))
    # Nothing can fit where there are no rules; an empty list of shapes still types as int.
    best = (
        expressions(distinct, sorted(shapes.labels) or [0], sorted(shapes.lengths) or [0])
        .join(known.withColumnRenamed("digest", "full"), "short")
        .where(F.col("digest") == F.col("full"))
        .groupBy("url")
        .agg(F.max_by(F.struct("rule", "verdict"), better).alias("best"))
        .withColumnRenamed("url", "judged_url")
    )
    own = [pages[f"`{c}`"] for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    host, path = url_parts(pages[f"`{url}`"])
    return pages.join(best, pages[f"`{url}`"] == best["judged_url"], "left").select(
        *own,
        host.alias("host"),
        path.alias("path"),
        best["best"]["rule"].alias("rule"),
        F.coalesce(best["best"]["verdict"], F.lit(default)).alias("verdict"),
    )

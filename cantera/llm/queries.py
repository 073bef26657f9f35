"""The registered queries of these operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from public_tokenizers import path as public_file

from cantera.llm import chat, crosspolytope, divergence, extraction, langid, licenses, packing, periodic, pieces, quality, sharding, simhash, urls
from cantera.session import new_path, shared_folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            shared_folder(spark)
            return function(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql.strip()
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUALITY_SQL = r"""
WITH words AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
         [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w
  FROM documents
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), counts AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), measured AS (
  SELECT *, n_symbols / nullif(n_words, 0) AS a, n_repeat_words / nullif(n_words, 0) AS b,
         n_dup_lines / (n_dup_lines + nullif(n_words, 0) / 8) AS c, word_chars / nullif(n_words, 0) AS d
  FROM counts
), fences AS (
  SELECT lang, source, grouping(lang) AS no_lang, grouping(source) AS no_source, count(d) AS n,
         quantile_disc(a, 0.5) + greatest(0.2, 6 * (quantile_disc(a, 0.5) - quantile_disc(a, 0.25))) AS fa,
         quantile_disc(b, 0.5) + greatest(0.3, 6 * (quantile_disc(b, 0.5) - quantile_disc(b, 0.25))) AS fb,
         quantile_disc(c, 0.5) + greatest(0.4, 6 * (quantile_disc(c, 0.5) - quantile_disc(c, 0.25))) AS fc,
         quantile_disc(d, 0.5) + greatest(1.0, 12 * (quantile_disc(d, 0.5) - quantile_disc(d, 0.25))) AS fd,
         quantile_disc(d, 0.5) - greatest(1.0, 12 * (quantile_disc(d, 0.5) - quantile_disc(d, 0.25))) AS fe
  FROM measured GROUP BY GROUPING SETS ((lang, source), (lang), ())
), chosen AS (
  SELECT s.lang, s.source,
         CASE WHEN s.n >= 100 THEN s.fa WHEN l.n >= 100 THEN l.fa ELSE e.fa END AS fa,
         CASE WHEN s.n >= 100 THEN s.fb WHEN l.n >= 100 THEN l.fb ELSE e.fb END AS fb,
         CASE WHEN s.n >= 100 THEN s.fc WHEN l.n >= 100 THEN l.fc ELSE e.fc END AS fc,
         CASE WHEN s.n >= 100 THEN s.fd WHEN l.n >= 100 THEN l.fd ELSE e.fd END AS fd,
         CASE WHEN s.n >= 100 THEN s.fe WHEN l.n >= 100 THEN l.fe ELSE e.fe END AS fe
  FROM (FROM fences WHERE no_source = 0) s
  JOIN (FROM fences WHERE no_source = 1 AND no_lang = 0) l ON s.lang IS NOT DISTINCT FROM l.lang
  CROSS JOIN (FROM fences WHERE no_lang = 1) e
), verdicts AS (
  SELECT m.*, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
         coalesce(a > fa, false) OR coalesce(b > fb, false) OR coalesce(c > fc, false) OR coalesce(d > fd OR d < fe, false) AS beyond
  FROM measured m JOIN chosen k ON m.lang IS NOT DISTINCT FROM k.lang AND m.source IS NOT DISTINCT FROM k.source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND NOT beyond) AS kept
FROM verdicts
"""


@query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


@query("op2_quality_rules", QUALITY_SQL)
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


@query("op3_sharding")
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    written = sharding.write_shards(docs, new_path(spark, "shards"), 40)
    text = F.coalesce("text", F.lit(""))
    # The written texts become digests before bucket offsets are joined, so that they stay where they are.
    digests = written.select(
        "doc_id",
        (F.octet_length(text) + sharding.OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "grown_shard",
        "bucket",
        "place",
    )
    return sharding.slots(digests).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


# Fixed values of the task: (host, path, verdict).
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

URL_SQL = r"""
WITH rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), parts AS (
  SELECT row_number() OVER () AS row, page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path
  FROM (SELECT page_id, coalesce(regexp_extract(url, '^.*?://(.*)$', 1, 's'), '') AS rest FROM pages)
), fits AS (
  SELECT row, max_by(struct_pack(rule := rule_host || rule_path, verdict := verdict), length(rule_host || rule_path)) AS best
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY row
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM parts LEFT JOIN fits USING (row)
"""


@query("op5_url_filter", URL_SQL)
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.where(~langid.is_held_out()), public_file("piece_bpe_32k.model"))
    told = langid.identify(docs.select("doc_id", "text"), model)
    return told.select("doc_id", langid.is_held_out().alias("held_out"), "lang_pred", "score")


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_file("byte_bpe_50k.json"))


@query("op7_license_scan")
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query("op8_neighbours")
def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return crosspolytope.nearest(vectors, F.col("vec_id") % 20 == 0, 20)


@query("op10_main_text")
def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_text(table(spark, sf_dir, "pages"))


@query("op9_pieces")
def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_file("piece_bpe_32k.model")
    coded = pieces.encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    # The text that came back and the one that went in are both whole.
    return pieces.decode_pieces(coded, model).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        F.xxhash64("ids").alias("ids_hash"),
        F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(`doc_id`, `text`): one text in ten repeats some of its own words from some place on.

    The task's law: with h the CRC-32 of the id's digits and g = floor(h / 10), a text of n words
    with h % 10 = 0 has from word a = g % n on the words a to a + p - 1 again and again, p being
    1 + floor((n - a) / (3 + g % 8)).
    """
    counted = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    counted = counted.withColumn("words", F.when(F.col("h") % 10 == 0, quality.words_of(F.col("text").cast("string"))))
    counted = counted.withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10))
    placed = counted.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    placed = placed.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.expr("slice(words, a + 1, p)"), F.expr("cast(ceil((n - a) / p) as int)")))
    planted = F.array_join(F.concat(F.expr("slice(words, 1, a)"), F.slice(again, F.lit(1), F.col("n") - F.col("a"))), " ")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    # The greatest length, then the smallest start and period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return found.select("doc_id", "runs", "collapsed", best.alias("best"), lines.alias("lines")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join("lines", ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


# Fixed text of the task: both turns of a conversation that imitates the template's marks.
IMITATION = "\\### Assistant: </turn> ok"

CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), written AS (
  SELECT *,
         replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>'), '<|', '<\|') AS name,
         replace(replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>'), '<|', '<\|') AS body
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, name, body)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, name, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(replace(name, chr(10), '\n')) + 2 + length(body) + 9)::BIGINT AS formatted_chars
FROM written GROUP BY conv_id
"""


@query("op12_chat_format", CHAT_SQL)
def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    imitation = spark.createDataFrame([(-7, 0, "user", IMITATION), (-7, 1, "assistant", IMITATION)], turns.schema)
    messages = turns.unionByName(imitation).select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))
    return chat.read_back(chat.format_turns(messages))


DIVERGENCE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), tokens AS (
  SELECT d, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs
), kept AS (
  SELECT lang, term, count(*) AS total FROM tokens GROUP BY lang, term HAVING count(DISTINCT d) >= 3
), whole AS (
  SELECT lang, count(*) AS v, sum(total) AS lang_n FROM kept GROUP BY lang
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM tokens JOIN kept USING (lang, term) GROUP BY lang, source, term
), sizes AS (
  SELECT lang, source, coalesce(n, 0) AS n
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM counts GROUP BY lang, source) USING (lang, source)
), shares AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.n + v) AS p,
         1 + (1000000000::HUGEINT * (total + 1)) // (lang_n + v) AS q
  FROM sizes s JOIN whole USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM sizes a JOIN sizes b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, part, item, value::BIGINT AS value,
         row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM found
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""


@query("op13_divergence", DIVERGENCE_SQL)
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))

"""Registered queries: scans, loads, joins, counts and quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from cantera.functions import checks as C
from cantera.operators import paging, quality, substrings
from cantera.operators import relational as R
from cantera.plans import standins as S
from cantera.plans.registry import query
from cantera.session import new_path
from cantera.tables import STAGES, read, spread

DATE = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@query("scan_songs", f"SELECT o_orderkey AS id, o_custkey AS id_artista, o_orderpriority AS cancion, {DATE.format('o_orderdate')} AS fecha FROM orders")
def scan_songs(spark, folder):
    return S.songs(spark, folder).select("id", "id_artista", "cancion", C.format_date(F.col("fecha_guardado")).alias("fecha"))


@query(
    "pending_by_null",
    f"""
SELECT 'track_vector' AS stage, id FROM ({S.CATALOGUE_SQL}) WHERE track_vector IS NULL
UNION ALL SELECT 'bpm', id FROM ({S.CATALOGUE_SQL}) WHERE bpm IS NULL
""",
)
def pending_by_null(spark, folder):
    return R.pending_stages(S.catalogue(spark, folder), ["track_vector", "bpm"])


@query(
    "exists_semi",
    """
SELECT 'lyric' AS level, o_orderkey AS id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
UNION ALL
SELECT 'song', o_orderkey FROM orders o WHERE EXISTS (
  SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderpriority = o.o_orderpriority AND p.o_orderstatus = 'F')
UNION ALL
SELECT 'artist', c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
""",
)
def exists_semi(spark, folder):
    songs = S.songs(spark, folder)
    stored = read(spark, folder, "orders").filter("o_orderstatus = 'F'")
    with_lyric = R.existing(songs, S.lyrics(spark, folder), ["id"], ["id_cancion"], unique=True)
    saved = R.existing(songs, stored, ["id_artista", "cancion"], ["o_custkey", "o_orderpriority"])
    with_song = R.existing(S.artists(spark, folder), songs, ["id"], ["id_artista"], unique=True)
    levels = {"lyric": with_lyric, "song": saved, "artist": with_song}
    rows = [df.select(F.lit(level).alias("level"), "id") for level, df in levels.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("ilike_lookup", "SELECT p_partkey AS id, p_name AS artista, p_type AS cancion FROM part WHERE p_name ILIKE '%RED%' AND p_type ILIKE '%eco%'")
def ilike_lookup(spark, folder):
    parts = read(spark, folder, "part", F.col("p_partkey").alias("id"), F.col("p_name").alias("artista"), F.col("p_type").alias("cancion"))
    return R.name_contains(parts, {"artista": "RED", "cancion": "eco"})


PIECES_SQL = """
SELECT s_name AS asks, substr(s_name, 13) AS text FROM supplier UNION ALL SELECT n_name, substr(n_name, 8) FROM nation
UNION ALL SELECT r_name, 'OMER#' FROM region WHERE r_name = 'ASIA' UNION ALL SELECT r_name, 'nobody' FROM region"""


@query("contains_indexed", f"SELECT asks, c_custkey AS id, c_name AS name FROM ({PIECES_SQL}) JOIN customer ON contains(lower(c_name), lower(text))")
def contains_indexed(spark, folder):
    """Names that contain texts of one to six characters, by postings of their substrings."""
    index = substrings.build(read(spark, folder, "customer"), "c_custkey", "c_name", new_path(spark, "substrings"))
    asked = read(spark, folder, "supplier").select(F.col("s_name").alias("asks"), F.expr("substring(s_name, 13)").alias("text"))
    asked = asked.unionByName(read(spark, folder, "nation").select(F.col("n_name").alias("asks"), F.expr("substring(n_name, 8)").alias("text")))
    region = read(spark, folder, "region").select(F.col("r_name").alias("asks"))
    asked = asked.unionByName(region.withColumn("text", F.lit("nobody")))
    asked = asked.unionByName(region.filter("asks = 'ASIA'").withColumn("text", F.lit("OMER#")))
    return substrings.contains(index, asked, "asks", "text")


@query("ilike_indexed", "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_name ILIKE '%RED%'")
def ilike_indexed(spark, folder):
    """One text, its postings and candidates read by name."""
    index = substrings.build(read(spark, folder, "part"), "p_partkey", "p_name", new_path(spark, "substrings"))
    return substrings.look_up(index, "RED")


@query("ensure_columns", "SELECT o_orderkey AS id, o_orderpriority AS cancion, NULL::VARCHAR AS mbid, NULL::DOUBLE AS bpm, FALSE AS vector_migrado FROM orders")
def ensure_columns(spark, folder):
    wanted = {"cancion": "string", "mbid": "string", "bpm": "double", "vector_migrado": "boolean"}
    full = R.ensure_columns(S.songs(spark, folder), wanted, {"vector_migrado": False})
    return full.select("id", "cancion", "mbid", "bpm", "vector_migrado")


@query("update_where", "SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'checked' ELSE c_name END AS nombre FROM customer")
def update_where(spark, folder):
    customers = read(spark, folder, "customer", F.col("c_custkey").alias("id"), F.col("c_name").alias("nombre"), "c_mktsegment")
    return R.update_where(customers, F.col("c_mktsegment") == "MACHINERY", {"nombre": F.lit("checked")}).drop("c_mktsegment")


@query("delete_where", f"SELECT id, bpm FROM ({S.CATALOGUE_SQL}) WHERE NOT coalesce(bpm = 90.0, FALSE)")
def delete_where(spark, folder):
    return R.delete_where(S.catalogue(spark, folder), F.col("bpm") == 90.0).select("id", "bpm")


MISSING_SQL = f"""
SELECT c.o_custkey AS id_artista, c.o_orderkey AS id, c.o_orderpriority AS cancion FROM orders c
LEFT JOIN (SELECT DISTINCT id_cancion FROM ({S.LYRICS_SQL}) WHERE letra IS NOT NULL) l ON l.id_cancion = c.o_orderkey
WHERE l.id_cancion IS NULL"""


@query("missing_lyrics", MISSING_SQL)
def missing_lyrics(spark, folder):
    return R.missing_lyrics(S.songs(spark, folder), S.lyrics(spark, folder)).select("id_artista", "id", "cancion")


@query("missing_lyrics_page", f"{MISSING_SQL} ORDER BY c.o_orderkey LIMIT 100 OFFSET 50")
def missing_lyrics_page(spark, folder):
    page = R.missing_lyrics(S.songs(spark, folder), S.lyrics(spark, folder), limit=100, offset=50)
    return page.select("id_artista", "id", "cancion")


@query(
    "missing_lyrics_after",
    f"SELECT * FROM ({MISSING_SQL}) WHERE id > (SELECT median(o_orderkey) FROM orders) ORDER BY id LIMIT 100",
)
def missing_lyrics_after(spark, folder):
    """The page after a song, by key."""
    songs = S.songs(spark, folder)
    middle = songs.agg(F.expr("median(id)").alias("m")).first().m
    page = R.missing_lyrics(songs, S.lyrics(spark, folder), limit=100, after_id=int(middle))
    return page.select("id_artista", "id", "cancion")


@query(
    "columns_of",
    """
SELECT ordinal_position::BIGINT AS position, lower(column_name) AS name,
       CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' END AS type
FROM (SELECT * FROM information_schema.columns WHERE table_name = 'documents')
""",
)
def columns_of(spark, folder):
    listed = R.columns_of(read(spark, folder, "documents"))
    return spark.createDataFrame(listed, "position BIGINT, name STRING, type STRING")


@query("song_artist", "SELECT o_orderkey AS id, o_orderpriority AS cancion, c_name AS nombre FROM orders JOIN customer ON c_custkey = o_custkey")
def song_artist(spark, folder):
    return R.song_artist(S.songs(spark, folder), S.artists(spark, folder)).select("id", "cancion", "nombre")


@query(
    "song_chain",
    f"""
SELECT nombre, cancion, letra, count(*) AS lyrics FROM (
  SELECT c_name AS nombre, o_orderpriority AS cancion, letra
  FROM ({S.LYRICS_SQL}) JOIN orders ON o_orderkey = id_cancion JOIN customer ON c_custkey = o_custkey)
GROUP BY ALL
""",
)
def song_chain(spark, folder):
    chain = R.song_chain(S.artists(spark, folder), S.songs(spark, folder), S.lyrics(spark, folder))
    return chain.groupBy("nombre", "cancion", "letra").agg(F.count(F.lit(1)).alias("lyrics"))


@query(
    "enrich_metadata",
    """
SELECT d.doc_id AS id, d.lang AS genre,
       CASE WHEN l.doc_id IS NULL THEN d.n_chars::DOUBLE ELSE CASE WHEN l.toxic = 0 THEN l.quality::DOUBLE END END AS bpm,
       coalesce(CASE WHEN l.toxic = 0 THEN 'mbid-' || l.doc_id::VARCHAR END, d.source) AS mbid
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
""",
)
def enrich_metadata(spark, folder):
    songs = read(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("genre"), F.col("n_chars").cast("double").alias("bpm"), F.col("source").alias("mbid")
    )
    found = read(spark, folder, "labels").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("toxic") == 0, F.col("quality").cast("double")).alias("bpm"),
        F.when(F.col("toxic") == 0, F.concat(F.lit("mbid-"), F.col("doc_id").cast("string"))).alias("mbid"),
    )
    # Every update comes twice, the older one with other values.
    older = found.withColumns({"bpm": F.lit(-1.0), "mbid": F.lit("older"), "version": F.lit(1)})
    updates = found.withColumn("version", F.lit(2)).unionByName(older)
    return R.enrich(songs, updates, "id", [F.desc("version")], ["bpm"], ["mbid"])


@query(
    "insert_new_artists",
    """
SELECT c_name AS nombre, min(o_orderkey) AS first_page FROM orders JOIN customer ON c_custkey = o_custkey
WHERE c_name NOT IN (SELECT c_name FROM customer WHERE c_acctbal >= 0) GROUP BY 1
""",
)
def insert_new_artists(spark, folder):
    stored = read(spark, folder, "customer").filter("c_acctbal >= 0").select(F.col("c_name").alias("nombre"))
    batch = R.song_artist(S.songs(spark, folder), S.artists(spark, folder)).select("nombre", F.col("id").alias("first_page"))
    return R.insert_absent(stored, batch, ["nombre"], [F.asc("first_page")], "drop")


@query(
    "insert_new_songs",
    f"""
SELECT l_suppkey AS id_artista, p_name AS cancion, {DATE.format('min(l_shipdate)')} AS fecha
FROM lineitem l JOIN part ON p_partkey = l_partkey
WHERE NOT EXISTS (SELECT 1 FROM lineitem s JOIN part q ON q.p_partkey = s.l_partkey
                  WHERE s.l_returnflag = 'R' AND s.l_suppkey = l.l_suppkey AND q.p_name = part.p_name)
GROUP BY l_suppkey, p_name
""",
)
def insert_new_songs(spark, folder):
    titles = read(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("cancion"))
    lines = read(spark, folder, "lineitem", "l_suppkey", "l_partkey", "l_shipdate", "l_returnflag").join(titles, "l_partkey")
    found = lines.select(F.col("l_suppkey").alias("id_artista"), "cancion", F.col("l_shipdate").alias("fecha"), "l_returnflag")
    stored = found.filter("l_returnflag = 'R'")
    fresh = R.insert_absent(stored, found.drop("l_returnflag"), ["id_artista", "cancion"], [F.asc("fecha")], "drop")
    return fresh.select("id_artista", "cancion", C.format_date(F.col("fecha")).alias("fecha"))


@query(
    "cascade_delete",
    """
SELECT 'artistas' AS level, c_custkey AS id FROM customer WHERE c_acctbal >= 0
UNION ALL SELECT 'canciones', o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal >= 0
UNION ALL SELECT 'letras', l_orderkey FROM lineitem WHERE l_orderkey NOT IN (
  SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0)
""",
)
def cascade_delete(spark, folder):
    deleted = read(spark, folder, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    artists, songs = S.artists(spark, folder), S.songs(spark, folder)
    lyrics = S.lyrics(spark, folder).select("id_cancion")
    levels = R.cascade_delete(deleted, [(artists, "id", "id"), (songs, "id", "id_artista"), (lyrics, "id_cancion", "id_cancion")])
    named = zip(("artistas", "canciones", "letras"), levels, ("id", "id", "id_cancion"))
    rows = [df.select(F.lit(name).alias("level"), F.col(key).alias("id")) for name, df, key in named]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("orphans", "SELECT o_orderkey AS id, o_custkey AS id_artista FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def orphans(spark, folder):
    kept = read(spark, folder, "customer").filter("c_acctbal >= 0")
    return R.orphans(S.songs(spark, folder), "id_artista", kept, "c_custkey").select("id", "id_artista")


@query(
    "stage_gate",
    """
SELECT 'artistas' AS stage, count(*) AS items, 100::BIGINT AS minimum, count(*) >= 100 AS ready FROM customer
UNION ALL SELECT 'canciones', count(*), 10::BIGINT, count(*) >= 10 FROM orders
""",
)
def stage_gate(spark, folder):
    from cantera.plans.catalogue import gates

    return gates(S.artists(spark, folder), S.songs(spark, folder))


OUTCOMES_SQL = """
SELECT d.doc_id AS id, d.lang, d.text AS letra, l.doc_id IS NOT NULL AND l.toxic = 0 AS saved,
       coalesce(l.quality = 1, FALSE) AS is_new,
       CASE WHEN l.doc_id IS NULL THEN 'not found' WHEN l.toxic <> 0 THEN 'rejected' END AS reason
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
"""


def outcomes(spark, folder):
    """One row per attempted lyric: found and accepted, or not."""
    attempts = read(spark, folder, "documents", "doc_id", "lang", "text")
    labels = read(spark, folder, "labels").withColumn("found", F.lit(True))
    found = F.coalesce("found", F.lit(False))
    return attempts.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        "lang",
        F.col("text").alias("letra"),
        (found & (F.col("toxic") == 0)).alias("saved"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("is_new"),
        F.when(~found, "not found").when(F.col("toxic") != 0, "rejected").alias("reason"),
    )


@query(
    "run_report",
    f"""
SELECT lang, count(*) AS processed, count(*) FILTER (WHERE saved) AS saved, count(*) FILTER (WHERE NOT saved) AS failed,
       count(*) FILTER (WHERE saved AND is_new) AS new_items,
       coalesce(sum(CASE WHEN saved THEN length(letra) END), 0)::BIGINT AS characters
FROM ({OUTCOMES_SQL}) GROUP BY lang
""",
)
def run_report(spark, folder):
    return quality.run_report(outcomes(spark, folder), "lang")


@query("run_failures", f"SELECT id, reason FROM ({OUTCOMES_SQL}) WHERE NOT saved")
def run_failures(spark, folder):
    return quality.failures(outcomes(spark, folder), "id")


@query(
    "completeness",
    f"""
SELECT initialkey, count(*) AS items, round(avg((bpm IS NOT NULL)::INT) * 100, 6) AS bpm_pct,
       round(avg((track_vector IS NOT NULL)::INT) * 100, 6) AS track_vector_pct
FROM ({S.CATALOGUE_SQL}) GROUP BY initialkey
""",
)
def completeness(spark, folder):
    shares = quality.completeness(S.catalogue(spark, folder), ["bpm", "track_vector"], "initialkey")
    return shares.withColumns({c: F.round(c, 6) for c in ("bpm_pct", "track_vector_pct")})


@query("error_rate", f"SELECT lang, round(count(*) FILTER (WHERE NOT saved) * 100.0 / count(*), 6)::DOUBLE AS error_pct FROM ({OUTCOMES_SQL}) GROUP BY lang")
def error_rate(spark, folder):
    report = quality.run_report(outcomes(spark, folder), "lang")
    percent = quality.rate(F.col("failed").cast("double"), F.col("processed"))
    return report.select("lang", F.round(percent, 6).alias("error_pct"))


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, folder):
    return quality.duplicate_keys(read(spark, folder, "lineitem"), "l_orderkey", "l_linenumber")


@query(
    "case_variants",
    r"""
SELECT lower(name) AS lowered, count(*) AS variants, sum(n)::BIGINT AS occurrences FROM (
  SELECT name, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[^\p{L}]+')) AS name FROM documents) GROUP BY 1)
WHERE name <> '' GROUP BY 1 HAVING count(*) > 1
""",
)
def case_variants(spark, folder):
    texts = spread(read(spark, folder, "documents", "text"))
    names = texts.select(F.explode(F.split("text", r"[^\p{L}]+")).alias("name")).filter("name <> ''")
    return quality.case_variants(names, "name")


WORDS_SQL = r"SELECT unnest(string_split_regex(text, '[^a-zA-Z]+')) AS name FROM documents"


def plain_words(spark, folder):
    texts = spread(read(spark, folder, "documents", "text"))
    return texts.select(F.explode(F.split("text", "[^a-zA-Z]+")).alias("name")).filter("name <> ''")


@query(
    "name_variants",
    f"""
SELECT min(name) AS name, count(*) AS variants, sum(n)::BIGINT AS occurrences FROM (
  SELECT name, count(*) AS n FROM ({WORDS_SQL}) WHERE name <> '' GROUP BY 1)
GROUP BY lower(name) HAVING count(*) > 1
""",
)
def name_variants(spark, folder):
    """Names alike by collation; on ASCII letters that is lower case."""
    return quality.name_variants(plain_words(spark, folder), "name")


@query(
    "absent_by_name",
    f"""
SELECT min(name) AS name FROM ({WORDS_SQL}) WHERE name <> ''
AND lower(name) NOT IN (SELECT lower(unnest(string_split_regex(text, '[^a-zA-Z]+'))) FROM benchmark) GROUP BY lower(name)
""",
)
def absent_by_name(spark, folder):
    """New names, none of which is a stored one in other case; of each the first spelling."""
    stored = read(spark, folder, "benchmark").select(F.explode(F.split("text", "[^a-zA-Z]+")).alias("name"))
    return R.absent_by_name(plain_words(spark, folder).distinct(), stored, ["name"], [])


@query(
    "dq_report",
    r"""
WITH s AS (SELECT d.source AS artista, CASE WHEN l.toxic = 1 THEN '' ELSE d.lang END AS cancion, d.text AS letra,
                  l.quality::VARCHAR AS calidad, d.source AS pista
           FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
r AS (
 SELECT 'cancion_filled' AS rule, coalesce(cancion <> '', FALSE) AS ok FROM s
 UNION ALL SELECT 'artista_filled', coalesce(artista <> '', FALSE) FROM s
 UNION ALL SELECT 'letra_filled', coalesce(letra <> '', FALSE) FROM s
 UNION ALL SELECT 'letra_plausible', coalesce(contains(letra, chr(10)) OR length(letra) > 20, FALSE) FROM s
 UNION ALL SELECT 'calidad_present', calidad IS NOT NULL FROM s
 UNION ALL SELECT 'calidad_is_int', calidad IS NULL OR TRY_CAST(calidad AS INT) IS NOT NULL FROM s
 UNION ALL SELECT 'pista_is_int', pista IS NULL OR TRY_CAST(pista AS INT) IS NOT NULL FROM s)
SELECT rule, count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed FROM r GROUP BY rule
""",
)
def dq_report(spark, folder):
    labels = read(spark, folder, "labels")
    songs = read(spark, folder, "documents").join(labels, "doc_id", "left").select(
        F.col("source").alias("artista"),
        F.when(F.col("toxic") == 1, "").otherwise(F.col("lang")).alias("cancion"),
        F.col("text").alias("letra"),
        F.col("quality").cast("string").alias("calidad"),
        F.col("source").alias("pista"),
    )
    rules = quality.song_rules("cancion", "artista", "letra", ["calidad"], {"calidad": "int", "pista": "int"})
    return quality.dq_report(songs, rules)


@query("resume_offset", "SELECT o_orderkey AS id, o_custkey AS id_artista FROM orders ORDER BY o_orderkey OFFSET 1000")
def resume_offset(spark, folder):
    return paging.resume_by_position(S.songs(spark, folder), "id", 1000).select("id", "id_artista")


@query("resume_key", "SELECT o_custkey AS id_artista, o_orderkey AS id, o_orderpriority AS cancion FROM orders WHERE o_custkey >= 100")
def resume_key(spark, folder):
    return paging.resume_by_key(S.songs(spark, folder), "id_artista", 100, "id").select("id_artista", "id", "cancion")


@query(
    "date_validity",
    f"""
SELECT o_orderkey AS id, try_strptime(s, '%Y-%m-%d %H:%M:%S') IS NOT NULL AS valid,
       strftime(try_strptime(s, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS fecha
FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 'F' THEN {DATE.format('o_orderdate')}
      ELSE strftime(o_orderdate, '%Y-%m-%d') END AS s FROM orders)
""",
)
def date_validity(spark, folder):
    orders = read(spark, folder, "orders", "o_orderkey", "o_orderstatus", "o_orderdate")
    formats = {"P": "dd/MM/yyyy", "F": C.DATE_FORMAT}
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    for status, pattern in formats.items():
        text = F.when(F.col("o_orderstatus") == status, F.date_format("o_orderdate", pattern)).otherwise(text)
    dated = orders.select(F.col("o_orderkey").alias("id"), C.parse_date(text).alias("parsed"))
    return dated.select("id", F.col("parsed").isNotNull().alias("valid"), C.format_date(F.col("parsed")).alias("fecha"))


@query(
    "mbid_validity",
    """
SELECT c_custkey AS id, mbid, coalesce(regexp_matches(mbid, '^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$'), FALSE) AS valid
FROM (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN upper(u) WHEN c_mktsegment = 'BUILDING' THEN substr(u, 1, 23) ELSE u END AS mbid
      FROM (SELECT *, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) AS u
            FROM (SELECT *, md5(c_name) AS m FROM customer)))
""",
)
def mbid_validity(spark, folder):
    customers = read(spark, folder, "customer").withColumn("m", F.md5("c_name"))
    parts = [F.substring("m", start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    uuid = F.concat_ws("-", *parts)
    mbid = F.when(F.col("c_acctbal") < 0, F.upper(uuid)).when(F.col("c_mktsegment") == "BUILDING", F.substring(uuid, 1, 23)).otherwise(uuid)
    return customers.select(F.col("c_custkey").alias("id"), mbid.alias("mbid")).withColumn("valid", C.is_mbid(F.col("mbid")))


PROGRESS_SQL = """
WITH u AS (SELECT event_type AS task_type, event_id AS current_offset,
             CASE WHEN value > 20 THEN user_id END AS total_items, user_id AS last_processed_id,
             CASE WHEN value > 50 THEN 'done' END AS status, CASE WHEN value < 1 THEN props END AS error_message,
             ts, event_id FROM events)
SELECT task_type, arg_max(current_offset, (ts, event_id)) AS current_offset,
       arg_max(total_items, (ts, event_id)) FILTER (WHERE total_items IS NOT NULL) AS total_items,
       arg_max(last_processed_id, (ts, event_id)) AS last_processed_id,
       arg_max(coalesce(status, 'running'), (ts, event_id)) AS status,
       nullif(arg_max(coalesce(error_message, ''), (ts, event_id)), '') AS error_message
FROM u GROUP BY task_type"""


def progress_updates(events):
    value = F.col("value")
    return events.select(
        F.col("event_type").alias("task_type"),
        F.col("event_id").alias("current_offset"),
        F.when(value > 20, F.col("user_id")).alias("total_items"),
        F.col("user_id").alias("last_processed_id"),
        F.when(value > 50, "done").alias("status"),
        F.when(value < 1, F.col("props")).alias("error_message"),
        F.col("ts").alias("updated_at"),
        "event_id",
    )


@query("progress_latest", PROGRESS_SQL)
def progress_latest(spark, folder):
    from cantera.streaming.progress import latest_progress

    updates = progress_updates(read(spark, folder, "events"))
    return latest_progress(updates, ["updated_at", "event_id"]).drop("updated_at")


@query(
    "progress_read",
    f"""
WITH p AS ({PROGRESS_SQL}),
stages AS (SELECT DISTINCT event_type AS task_type FROM events UNION ALL SELECT unnest(['artistas', 'canciones', 'letras', 'vectors']))
SELECT s.task_type, CASE WHEN p.task_type IS NULL THEN 0 ELSE p.current_offset END AS current_offset,
       CASE WHEN p.task_type IS NULL THEN 0 ELSE p.total_items END AS total_items, p.last_processed_id,
       CASE WHEN p.task_type IS NULL THEN 'running' ELSE p.status END AS status, p.error_message
FROM stages s LEFT JOIN p ON p.task_type = s.task_type
""",
)
def progress_read(spark, folder):
    from cantera.streaming.progress import read_progress

    events = read(spark, folder, "events")
    named = spark.createDataFrame([(stage,) for stage in STAGES], "task_type STRING")
    stages = events.select(F.col("event_type").alias("task_type")).distinct().unionByName(named)
    return read_progress(progress_latest(spark, folder), stages)

"""Analytics and maintenance. ``events`` plays the query log: its type is the query, its value the duration."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.operators import analytics as a
from codequarry.operators import incremental
from codequarry.operators import maintain as m
from codequarry.query_sets.tracking import _KEY
from codequarry.registry import query
from codequarry.session import table

_LOG = """log AS (SELECT event_id AS log_id, ts AS executed_at, event_type || ':' || (user_id % 20) AS query_text, md5(event_type || ':' || (user_id % 20)) AS query_hash, CAST(value AS DOUBLE) AS duration_ms,
  CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS result_count, event_type = 'click' AS cache_hit, event_type = 'purchase' AS exact_match, event_id % 4 <> 0 AS cache_valid, 'r' || event_id AS result_ids FROM events)"""


def log(spark, sf):
    e = table(spark, sf, "events")
    text = F.concat("event_type", F.lit(":"), (F.col("user_id") % 20).cast("string"))
    return e.select(
        F.col("event_id").alias("log_id"),
        F.col("ts").alias("executed_at"),
        text.alias("query_text"),
        F.md5(text.cast("binary")).alias("query_hash"),
        F.col("value").cast("double").alias("duration_ms"),
        (F.get_json_object("props", "$.k").cast("int") % 10).alias("result_count"),
        (F.col("event_type") == "click").alias("cache_hit"),
        (F.col("event_type") == "purchase").alias("exact_match"),
        (F.col("event_id") % 4 != 0).alias("cache_valid"),
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("result_ids"),
    )


_PCT = "CASE WHEN {1} > 0 THEN round(100.0::DOUBLE * {0} / {1}, 2) ELSE 0::DOUBLE END"


@query(
    "log_stats",
    f"""WITH {_LOG}, s AS (SELECT count(*) AS n_queries, CAST(count_if(cache_hit) AS BIGINT) AS cache_hits, CAST(count_if(exact_match) AS BIGINT) AS exact_matches, CAST(count_if(result_count = 0) AS BIGINT) AS empty, round(avg(duration_ms), 6) AS avg_ms FROM log)
SELECT *, {_PCT.format('cache_hits', 'n_queries')} AS hit_percent, {_PCT.format('empty', 'n_queries')} AS empty_percent FROM s""",
)
def log_stats(spark, sf):
    return a.log_stats(log(spark, sf))


_CACHE = "cache AS (SELECT query_hash, count(*) AS hit_count, bool_or(cache_valid) AS cache_valid, CAST(floor(avg(duration_ms)) AS BIGINT) AS avg_ms FROM log WHERE day(executed_at) <= 15 GROUP BY 1)"


def cache(spark, sf):
    return log(spark, sf).where(F.dayofmonth("executed_at") <= 15).groupBy("query_hash").agg(F.count("*").alias("hit_count"), F.bool_or("cache_valid").alias("cache_valid"), F.floor(F.avg("duration_ms")).alias("avg_ms"))


@query("cache_stats", f"WITH {_LOG}, {_CACHE} SELECT count(*) AS entries, CAST(count_if(cache_valid) AS BIGINT) AS valid, CAST(sum(hit_count) AS BIGINT) AS hits, CAST(count_if(hit_count >= 3) AS BIGINT) AS popular FROM cache")
def cache_stats(spark, sf):
    return a.cache_stats(cache(spark, sf))


@query(
    "log_to_cache",
    f"""WITH {_LOG}, latest AS (SELECT query_hash, result_ids, row_number() OVER (PARTITION BY query_hash ORDER BY executed_at DESC, log_id DESC) AS n FROM log),
g AS (SELECT query_hash, max(query_text) AS query_text, count(*) AS hit_count, min(executed_at) AS first_seen, max(executed_at) AS last_seen, round(avg(duration_ms), 6) AS avg_ms FROM log WHERE cache_valid GROUP BY 1)
SELECT g.*, l.result_ids FROM g JOIN latest l ON g.query_hash = l.query_hash AND l.n = 1""",
)
def log_to_cache(spark, sf):
    return a.log_to_cache(log(spark, sf))


@query(
    "running_avg",
    f"""WITH {_LOG}, {_CACHE}, new AS (SELECT query_hash, count(*) AS n, CAST(sum(floor(duration_ms)) AS BIGINT) AS d FROM log WHERE day(executed_at) > 15 GROUP BY 1)
SELECT coalesce(cache.query_hash, new.query_hash) AS query_hash, CAST(coalesce(hit_count, 0) + coalesce(n, 0) AS BIGINT) AS hit_count,
  (coalesce(avg_ms, 0) * coalesce(hit_count, 0) + coalesce(d, 0)) // (coalesce(hit_count, 0) + coalesce(n, 0)) AS avg_ms FROM cache FULL JOIN new ON cache.query_hash = new.query_hash""",
)
def running_avg(spark, sf):
    batch = log(spark, sf).where(F.dayofmonth("executed_at") > 15).select("query_hash", F.floor("duration_ms").alias("duration_ms"))
    return a.upsert_cache(cache(spark, sf).select("query_hash", "hit_count", "avg_ms"), batch)


@query("top_queries", f"WITH {_LOG} SELECT query_text, count(*) AS times FROM log GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_queries(spark, sf):
    return a.top_queries(log(spark, sf))


@query("log_retention", f"WITH {_LOG} SELECT log_id FROM log WHERE cache_valid OR executed_at >= TIMESTAMP '2024-02-01' - INTERVAL 20 DAY")
def log_retention(spark, sf):
    return a.retained(log(spark, sf), F.expr("timestamp_ntz'2024-02-01'"), 20).select("log_id")


@query("folder_throughput", "SELECT folder_path, epoch_us(indexed_at) AS at_us, CASE WHEN duration_seconds > 0 THEN round(chunks_count::DOUBLE / duration_seconds, 2) END AS per_second FROM indexed_folders")
def folder_throughput(spark, sf):
    return a.folder_throughput(table(spark, sf, "indexed_folders")).select("folder_path", F.unix_micros("indexed_at").alias("at_us"), "per_second")


@query("folder_totals", "SELECT count(*) AS n_rows, CAST(coalesce(sum(files_count), 0) AS BIGINT) AS files, CAST(coalesce(sum(chunks_count), 0) AS BIGINT) AS chunks, CAST(coalesce(sum(duration_seconds), 0) AS BIGINT) AS seconds, round(avg(duration_seconds), 6) AS mean_seconds FROM indexed_folders")
def folder_totals(spark, sf):
    return a.folder_totals(table(spark, sf, "indexed_folders"))


@query("type_distribution", "SELECT type, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM symbols), 4) AS percent FROM symbols GROUP BY 1")
def type_distribution(spark, sf):
    return a.distribution(table(spark, sf, "symbols"), "type")


@query("size_buckets", "SELECT CASE WHEN content IS NULL THEN 'none' WHEN length(content) < 100 THEN 'tiny' WHEN length(content) < 1000 THEN 'small' WHEN length(content) <= 4000 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS n FROM symbols GROUP BY 1")
def size_buckets(spark, sf):
    return a.size_buckets(table(spark, sf, "symbols"))


@query("chunks_per_file", "SELECT o_orderkey, CAST(count(l_orderkey) AS BIGINT) AS chunks FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def chunks_per_file(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return a.chunks_per_file(table(spark, sf, "orders").select("o_orderkey"), lines, "o_orderkey")


@query(
    "ir_metrics",
    """
WITH r AS (SELECT event_type AS mode, user_id AS query_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS pos, value > 50 AS relevant FROM events),
p AS (SELECT mode, query_id, sum(relevant::INT) AS rel, count(*) AS n, min(CASE WHEN relevant THEN pos END) AS first FROM r WHERE pos <= 10 GROUP BY 1, 2)
SELECT mode, count(*) AS queries, round(sum(rel)::DOUBLE / sum(n), 6) AS precision, round(avg((rel > 0)::INT::DOUBLE), 6) AS hit_rate, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM p GROUP BY 1
""",
)
def ir_metrics(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("event_type", "user_id").orderBy("event_id")
    r = table(spark, sf, "events").select(F.col("event_type").alias("mode"), F.col("user_id").alias("query_id"), F.row_number().over(w).alias("pos"), (F.col("value") > 50).alias("relevant"))
    return a.ir_metrics(r, 10)


@query("tag_sets", "SELECT id, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(domain_tags, ','), lambda x: trim(x)), lambda x: x <> ''))), ','), '') AS tags FROM symbols")
def tag_sets(spark, sf):
    return a.tag_sets(table(spark, sf, "symbols"), "id", "domain_tags")


@query("indexed_roots", "SELECT DISTINCT folder_path FROM indexed_folders WHERE parent_folder_path IS NULL OR trim(parent_folder_path) = ''")
def indexed_roots(spark, sf):
    from codequarry.functions.paths import blank

    return table(spark, sf, "indexed_folders").where(blank(F.col("parent_folder_path"))).select("folder_path").distinct()


# ---------------------------------------------------------------- maintenance

_SCAN = f"""cur AS (SELECT k, file_hash, modified_at FROM (SELECT {_KEY.format('file_path')} AS k, file_hash, modified_at, row_number() OVER (PARTITION BY {_KEY.format('file_path')} ORDER BY scanned_at DESC NULLS LAST, scan_seq DESC) AS n FROM file_scan WHERE file_path IS NOT NULL) WHERE n = 1 AND file_hash IS NOT NULL),
rec AS (SELECT k, file_hash, last_indexed FROM (SELECT {_KEY.format('file_path')} AS k, file_hash, last_indexed, row_number() OVER (PARTITION BY {_KEY.format('file_path')} ORDER BY last_indexed DESC NULLS LAST, h.run_id DESC) AS n FROM file_hashes h WHERE run_id IN (SELECT run_id FROM index_runs WHERE lower(trim(status)) = 'success') AND file_path IS NOT NULL) WHERE n = 1)"""


@query(
    "file_status",
    f"""WITH {_SCAN} SELECT coalesce(cur.k, rec.k) AS file_key, CASE WHEN rec.k IS NULL THEN 'new' WHEN cur.k IS NULL THEN 'deleted' WHEN modified_at <= last_indexed THEN 'skipped' WHEN lower(trim(cur.file_hash)) = lower(trim(rec.file_hash)) THEN 'unchanged' ELSE 'modified' END AS status
FROM cur FULL JOIN rec ON cur.k = rec.k""",
)
def file_status(spark, sf):
    from codequarry.functions.paths import path_key

    scan = table(spark, sf, "file_scan").where("file_path is not null")
    cur = scan.groupBy(path_key(F.col("file_path")).alias("file_key")).agg(F.max(F.struct("scanned_at", "scan_seq", "file_hash", "modified_at")).alias("r")).select("file_key", "r.file_hash", "r.modified_at").where("file_hash is not null")
    runs = table(spark, sf, "index_runs").where("lower(trim(status)) = 'success'").select("run_id")
    rec = table(spark, sf, "file_hashes").where("file_path is not null").join(runs, "run_id", "left_semi")
    rec = rec.groupBy(path_key(F.col("file_path")).alias("file_key")).agg(F.max(F.struct("last_indexed", "run_id", "file_hash")).alias("r")).select("file_key", F.col("r.file_hash").alias("stored_hash"), F.col("r.last_indexed").alias("indexed_at"))
    return m.file_status(cur, rec)


@query("upsert_latest", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY name, file_path, type ORDER BY created_at DESC NULLS LAST, id DESC) AS n FROM symbols) WHERE n = 1")
def upsert_latest(spark, sf):
    return m.upsert_latest(table(spark, sf, "symbols"), m.LEGACY_KEY, ["created_at", "id"]).select("id")


@query("upsert_full_key", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY file_path, full_name, type, start_line ORDER BY created_at DESC NULLS LAST, id DESC) AS n FROM symbols) WHERE n = 1")
def upsert_full_key(spark, sf):
    return m.upsert_latest(table(spark, sf, "symbols"), m.FULL_KEY, ["created_at", "id"]).select("id")


_GONE = f"gone AS (SELECT k FROM (SELECT {_KEY.format('file_path')} AS k, file_hash, row_number() OVER (PARTITION BY {_KEY.format('file_path')} ORDER BY scanned_at DESC NULLS LAST, scan_seq DESC) AS n FROM file_scan WHERE file_path IS NOT NULL) WHERE n = 1 AND file_hash IS NULL)"


def _gone(spark, sf):
    return incremental.latest_sightings(table(spark, sf, "file_scan")).where("file_hash is null").select("file_key")


@query(
    "cascade_delete",
    f"""WITH {_GONE}, dead AS (SELECT id FROM symbols WHERE {_KEY.format('file_path')} IN (SELECT k FROM gone))
SELECT 'symbol' AS kind, id FROM symbols WHERE id NOT IN (SELECT id FROM dead) UNION ALL SELECT 'vector', vec_id FROM vec_embeddings WHERE symbol_id IS NULL OR symbol_id NOT IN (SELECT id FROM dead)""",
)
def cascade_delete(spark, sf):
    s, v = m.cascade_delete(table(spark, sf, "symbols"), table(spark, sf, "vec_embeddings"), _gone(spark, sf))
    return s.select(F.lit("symbol").alias("kind"), "id").unionAll(v.select(F.lit("vector"), "vec_id"))


@query("delete_folder", f"SELECT id FROM symbols WHERE file_path IS NULL OR NOT starts_with({_KEY.format('file_path')}, 'c:/work/')")
def delete_folder(spark, sf):
    return m.outside_folder(table(spark, sf, "symbols"), "C:\\Work\\").select("id")


@query(
    "longest_prefix",
    f"""
WITH f AS (SELECT DISTINCT file_path, {_KEY.format('file_path')} AS p FROM symbols WHERE file_path IS NOT NULL), d AS (SELECT {_KEY.format('folder_path')} AS k, max(folder_path) AS folder_path FROM indexed_folders WHERE folder_path IS NOT NULL GROUP BY 1),
j AS (SELECT file_path, folder_path, row_number() OVER (PARTITION BY file_path ORDER BY length(k) DESC) AS n FROM f JOIN d ON starts_with(p, k || '/'))
SELECT f.file_path, coalesce(j.folder_path, '') AS folder_path FROM f LEFT JOIN j ON f.file_path = j.file_path AND n = 1
""",
)
def longest_prefix(spark, sf):
    return m.longest_prefix(table(spark, sf, "symbols"), table(spark, sf, "indexed_folders"))


def _folder_hash(keys: str, lines: str) -> str:
    slots = f"SELECT {keys}, substr(md5(line), 1, 3) AS slot, md5(string_agg(line, chr(10) ORDER BY line)) AS d FROM ({lines}) GROUP BY ALL"
    return f"SELECT {keys}, md5(string_agg(slot || ':' || d, chr(10) ORDER BY slot || ':' || d)) AS h FROM ({slots}) GROUP BY ALL"


@query(
    "merkle_hash",
    f"""
WITH f AS (SELECT r_name, n_name, 'F:' || c_custkey || ':' || md5(c_name) AS line FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
n AS ({_folder_hash("r_name, n_name", "SELECT * FROM f")}), r AS ({_folder_hash("r_name", "SELECT r_name, 'D:' || n_name || ':' || h AS line FROM n")}), t AS ({_folder_hash("top", "SELECT 'all' AS top, 'D:' || r_name || ':' || h AS line FROM r")})
SELECT 'all/' || r_name || '/' || n_name AS folder, h AS hash FROM n UNION ALL SELECT 'all/' || r_name, h FROM r UNION ALL SELECT top, h FROM t
""",
)
def merkle_hash(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return m.merkle(j.select(F.concat_ws("/", F.lit("all"), "r_name", "n_name", F.col("c_custkey").cast("string")).alias("path"), F.md5(F.col("c_name").cast("binary")).alias("hash")))


@query(
    "deleted_subfolders",
    rf"""
WITH l AS (SELECT folder_path, {_KEY.format('folder_path')} AS k, unnest(from_json(CASE WHEN json_valid(subfolders_list) THEN subfolders_list END, '["VARCHAR"]')) AS gone FROM indexed_folders WHERE folder_path IS NOT NULL)
SELECT DISTINCT folder_path, gone FROM l WHERE gone IS NOT NULL AND CASE WHEN regexp_matches(gone, '[\\/]') THEN {_KEY.format('gone')} ELSE k || '/' || lower(gone) END NOT IN (SELECT {_KEY.format('folder_path')} FROM indexed_folders WHERE folder_path IS NOT NULL)
""",
)
def deleted_subfolders(spark, sf):
    return m.deleted_subfolders(table(spark, sf, "indexed_folders"))


@query(
    "cache_validate",
    """
WITH items AS (SELECT md5('q' || (id % 997)) AS query_hash, id, CASE WHEN id % 53 = 0 THEN id + 100000000 ELSE id END AS rid, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 31 = 0 THEN 'x' ELSE coalesce(content_hash, '') END AS rhash FROM symbols)
SELECT query_hash, bool_and(s.id IS NOT NULL AND (coalesce(rhash, '') = '' OR coalesce(lower(trim(rhash)) = lower(trim(s.content_hash)), false))) AS still_valid FROM items LEFT JOIN symbols s ON items.rid = s.id GROUP BY 1
""",
)
def cache_validate(spark, sf):
    s = table(spark, sf, "symbols")
    return _validated(s, s)


def _validated(cached, s):
    i = F.col("id")
    rid = F.when(i % 53 == 0, i + 100000000).otherwise(i).cast("string")
    item = F.when(i % 5 == 0, rid).otherwise(F.concat(rid, F.lit(":"), F.when(i % 31 == 0, "x").otherwise(F.coalesce("content_hash", F.lit("")))))
    c = cached.groupBy(F.md5(F.concat(F.lit("q"), (i % 997).cast("string")).cast("binary")).alias("query_hash")).agg(F.array_join(F.collect_list(item), ",").alias("result_ids"), F.count("*").alias("result_count"))
    return m.validate_cache(c, s)


@query("orphan_embeddings", "SELECT vec_id FROM vec_embeddings v WHERE NOT EXISTS (SELECT 1 FROM symbols s WHERE s.id = v.symbol_id)")
def orphan_embeddings(spark, sf):
    return m.orphans(table(spark, sf, "vec_embeddings"), table(spark, sf, "symbols")).select("vec_id")


@query(
    "folder_consistency",
    f"""
WITH d AS (SELECT folder_path, k, chunks_count FROM (SELECT folder_path, {_KEY.format('folder_path')} AS k, chunks_count, row_number() OVER (PARTITION BY {_KEY.format('folder_path')} ORDER BY indexed_at DESC NULLS LAST, folder_path DESC) AS n FROM indexed_folders WHERE folder_path IS NOT NULL) WHERE n = 1),
s AS (SELECT regexp_replace({_KEY.format('file_path')}, '/[^/]*$', '') AS p, count(*) AS n FROM symbols WHERE file_path IS NOT NULL GROUP BY 1)
SELECT folder_path, CAST(coalesce(chunks_count, 0) AS BIGINT) AS tracked, coalesce(n, 0) AS actual, coalesce(chunks_count, 0) - coalesce(n, 0) AS difference FROM d LEFT JOIN s ON d.k = s.p
""",
)
def folder_consistency(spark, sf):
    return m.folder_consistency(table(spark, sf, "indexed_folders"), table(spark, sf, "symbols"))


@query("declared_and_implemented", "SELECT s.id, count(o.id) > 0 AS has_other FROM symbols s LEFT JOIN symbols o ON lower(o.full_name) = lower(s.full_name) AND o.id <> s.id WHERE lower(s.type) IN ('function', 'procedure') GROUP BY 1")
def declared_and_implemented(spark, sf):
    s = table(spark, sf, "symbols")
    n = s.where("full_name is not null").groupBy(F.lower("full_name").alias("k")).agg(F.count("*").alias("n"))
    return s.where("lower(type) in ('function', 'procedure')").join(n, F.lower("full_name") == F.col("k"), "left").select("id", (F.coalesce("n", F.lit(0)) > 1).alias("has_other"))


@query("chunk_embeddings", "SELECT s.id, count(v.vec_id) AS vectors FROM symbols s LEFT JOIN vec_embeddings v ON v.symbol_id = s.id GROUP BY 1")
def chunk_embeddings(spark, sf):
    v = table(spark, sf, "vec_embeddings").groupBy("symbol_id").agg(F.count("vec_id").alias("n"))
    return table(spark, sf, "symbols").join(v, F.col("id") == F.col("symbol_id"), "left").select("id", F.coalesce("n", F.lit(0)).alias("vectors"))

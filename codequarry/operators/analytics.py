"""Query-log, cache, folder and retrieval analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hits from which a cached query counts as popular.
POPULAR = 3
RETENTION_DAYS = 90


def _times(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")


def percent(part: Column, whole: Column) -> Column:
    """Rounded to two decimals; 0 of nothing is 0."""
    return F.when(whole > 0, F.round(100.0 * part / whole, 2)).otherwise(0.0)


def log_stats(log: DataFrame) -> DataFrame:
    """One row about a log with cache_hit, exact_match, result_count and duration_ms; an empty log gives zeros and a NULL mean."""
    a = log.agg(F.count("*").alias("n_queries"), _times(F.col("cache_hit")).alias("cache_hits"), _times(F.col("exact_match")).alias("exact_matches"), _times(F.col("result_count") == 0).alias("empty"), F.round(F.avg("duration_ms"), 6).alias("avg_ms"))
    return a.withColumn("hit_percent", percent(F.col("cache_hits"), F.col("n_queries"))).withColumn("empty_percent", percent(F.col("empty"), F.col("n_queries")))


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), _times(F.col("cache_valid")).alias("valid"), F.coalesce(F.sum("hit_count"), F.lit(0)).alias("hits"), _times(F.col("hit_count") >= POPULAR).alias("popular"))


def log_to_cache(log: DataFrame) -> DataFrame:
    """Valid log rows by query hash; the results are the latest of all rows, valid or not (ties: the highest log id)."""
    latest = log.groupBy(F.col("query_hash").alias("l_hash")).agg(F.max_by("result_ids", F.struct("executed_at", "log_id")).alias("result_ids"))
    good = log.where("cache_valid").groupBy("query_hash").agg(F.max("query_text").alias("query_text"), F.count("*").alias("hit_count"), F.min("executed_at").alias("first_seen"), F.max("executed_at").alias("last_seen"), F.round(F.avg("duration_ms"), 6).alias("avg_ms"))
    return good.join(latest, F.col("query_hash") == F.col("l_hash")).drop("l_hash")


def upsert_cache(cache: DataFrame, batch: DataFrame) -> DataFrame:
    """The cache after a batch of runs (query_hash, duration_ms): hits counted, integer means truncated.

    ``cache`` has query_hash, hit_count, avg_ms (integers). The batch is summed first: the mean
    over old and new runs is truncated once.
    """
    new = batch.groupBy("query_hash").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("d"))
    both = cache.join(new, "query_hash", "full_outer")
    hits, avg, n, d = (F.coalesce(F.col(c), F.lit(0)) for c in ("hit_count", "avg_ms", "n", "d"))
    both = both.withColumn("_h", (hits + n).cast("long")).withColumn("_t", (avg * hits + d).cast("long"))
    return both.select("query_hash", F.col("_h").alias("hit_count"), F.expr("_t div _h").alias("avg_ms"))


def top_queries(log: DataFrame, n: int = 10) -> DataFrame:
    return log.groupBy("query_text").agg(F.count("*").alias("times")).orderBy(F.col("times").desc(), "query_text").limit(n)


def expired(log: DataFrame, now: Column, days: int = RETENTION_DAYS) -> Column:
    """Rows that retention drops: invalid ones older than ``days``."""
    return ~F.col("cache_valid") & (F.col("executed_at") < now - F.make_interval(days=F.lit(days)))


def retained(log: DataFrame, now: Column, days: int = RETENTION_DAYS) -> DataFrame:
    return log.where(~F.coalesce(expired(log, now, days), F.lit(False)))


def folder_throughput(folders: DataFrame) -> DataFrame:
    """Chunks per second of each row, NULL without a duration."""
    rate = F.when(F.col("duration_seconds") > 0, F.round(F.col("chunks_count").cast("double") / F.col("duration_seconds"), 2))
    return folders.select("folder_path", "indexed_at", "files_count", "chunks_count", "duration_seconds", rate.alias("per_second"))


def folder_totals(folders: DataFrame) -> DataFrame:
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return folders.agg(F.count("*").alias("n_rows"), s("files_count").alias("files"), s("chunks_count").alias("chunks"), s("duration_seconds").alias("seconds"), F.round(F.avg("duration_seconds"), 6).alias("mean_seconds"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Counts by value with their percentage; NULL is a value."""
    counted = df.groupBy(column).agg(F.count("*").alias("n"))
    whole = counted.agg(F.sum("n").alias("all"))
    return counted.crossJoin(F.broadcast(whole)).select(column, "n", F.round(100.0 * F.col("n") / F.col("all"), 4).alias("percent"))


def size_buckets(symbols: DataFrame) -> DataFrame:
    n = F.length("content")
    b = F.when(n.isNull(), "none").when(n < 100, "tiny").when(n < 1000, "small").when(n <= 4000, "medium").otherwise("large")
    return symbols.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


def chunks_per_file(files: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Chunks of every file, 0 for files without any."""
    n = chunks.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("n"))
    return files.join(n, F.col(key) == F.col("_k"), "left").select(key, F.coalesce("n", F.lit(0)).alias("chunks"))


def ir_metrics(results: DataFrame, k: int) -> DataFrame:
    """Precision at k, hit rate and mean reciprocal rank per mode, of (mode, query_id, pos, relevant)."""
    per = results.where(F.col("pos") <= k).groupBy("mode", "query_id").agg(F.sum(F.col("relevant").cast("int")).alias("rel"), F.count("*").alias("n"), F.min(F.when(F.col("relevant"), F.col("pos"))).alias("first"))
    return per.groupBy("mode").agg(F.count("*").alias("queries"), F.round(F.sum("rel") / F.sum("n"), 6).alias("precision"), F.round(F.avg((F.col("rel") > 0).cast("double")), 6).alias("hit_rate"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def tag_sets(df: DataFrame, key: str, csv: str) -> DataFrame:
    """Distinct sorted tags per key, as CSV; '' where there are none."""
    tags = df.select(key, F.explode_outer(F.split(csv, r"\s*,\s*")).alias("tag")).withColumn("tag", F.trim("tag")).distinct()
    return tags.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("tag") != "", F.col("tag")))), ",").alias("tags"))


def running_mean(log: DataFrame, key: str, at: str, tie: str, value: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)
    return log.select(key, tie, F.round(F.avg(value).over(w), 6).alias("mean_so_far"))


def package_report(packages: DataFrame, package_files: DataFrame) -> DataFrame:
    """(package_name, framework, category, files) by name; packages without files count 0."""
    n = package_files.groupBy(F.col("package_name").alias("_p")).agg(F.count("*").alias("n"))
    return packages.join(n, F.col("package_name") == F.col("_p"), "left").select("package_name", "framework", "category", F.coalesce("n", F.lit(0)).alias("files")).orderBy("package_name")


def folder_report(folders: DataFrame) -> DataFrame:
    """The rows of indexed folders, the latest first."""
    return folder_throughput(folders).orderBy(F.col("indexed_at").desc_nulls_last(), "folder_path")


def cache_report(cache: DataFrame) -> DataFrame:
    """Cached queries in the order in which they are checked again: most hits first."""
    return cache.orderBy(F.col("hit_count").desc_nulls_last(), "query_hash")

"""Change capture and hierarchies."""

from __future__ import annotations

from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators import incremental
from codequarry.operators.hierarchy import hierarchy
from codequarry.registry import query
from codequarry.session import shared_folder, table

_KEY = "regexp_replace(lower(replace({0}, '\\', '/')), '(.)/+$', '\\1')"


_STALE = f"""
WITH scans AS (
  SELECT scan_seq, file_hash, {_KEY.format("file_path")} AS k,
         row_number() OVER (PARTITION BY {_KEY.format("file_path")} ORDER BY scanned_at DESC NULLS LAST, scan_seq DESC) AS n
  FROM file_scan WHERE file_path IS NOT NULL
), recorded AS (
  SELECT {_KEY.format("h.file_path")} AS k, h.file_hash,
         row_number() OVER (PARTITION BY {_KEY.format("h.file_path")} ORDER BY h.last_indexed DESC NULLS LAST, h.run_id DESC) AS n
  FROM file_hashes h JOIN index_runs r ON h.run_id = r.run_id WHERE lower(trim(r.status)) = 'success' AND h.file_path IS NOT NULL
)
SELECT 'file' AS record_kind, s.scan_seq AS record_id
FROM scans s LEFT JOIN recorded r ON s.k = r.k AND r.n = 1
WHERE s.n = 1 AND s.file_hash IS NOT NULL AND (r.file_hash IS NULL OR lower(trim(s.file_hash)) <> lower(trim(r.file_hash)))
UNION ALL
SELECT 'symbol', id FROM symbols
WHERE content_hash IS NULL OR trim(content_hash) = '' OR lower(trim(content_hash)) <> md5(coalesce(content, ''))
"""


def _changed(spark: SparkSession, sf: str, sightings: DataFrame, stale: DataFrame) -> DataFrame:
    recorded = incremental.recorded_hashes(table(spark, sf, "file_hashes"), table(spark, sf, "index_runs"))
    files = incremental.changed_files(sightings, recorded).select(F.lit("file").alias("record_kind"), F.col("scan_seq").alias("record_id"))
    return files.unionAll(stale.select(F.lit("symbol").alias("record_kind"), F.col("id").alias("record_id")))


@query("p4_found", _STALE)
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    sightings, stale = incremental.capture(spark, table(spark, sf, "file_scan"), table(spark, sf, "symbols"))
    return _changed(spark, sf, sightings, stale)


@query("p4_after_failure", _STALE)
def p4_after_failure(spark: SparkSession, sf: str) -> DataFrame:
    """The same result by three runs over one log: over what had arrived by half-time, one that dies after its plans, and one over everything.

    In the first run the symbols are in another state: hashes are lost, contents are others, and rows are missing.
    """
    root = shared_folder(spark, "runs")
    scan, symbols = table(spark, sf, "file_scan"), table(spark, sf, "symbols")
    half = scan.select(F.percentile_approx(F.unix_micros("arrived_at"), 0.5).alias("t"))
    early = scan.join(F.broadcast(half), F.unix_micros("arrived_at") <= F.col("t")).drop("t")
    was = symbols.where("id % 13 <> 0").withColumn("content_hash", F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("content_hash"))).withColumn("content", F.when(F.col("id") % 11 == 0, F.lit("other")).otherwise(F.col("content")))
    incremental.capture(spark, early, was, root)

    def dies(rows: DataFrame) -> DataFrame:
        raise ConnectionError("the run ends here")

    with suppress(ConnectionError):
        incremental.files_log(spark, root).run(incremental.sightings_log(scan.join(F.broadcast(half), F.unix_micros("arrived_at") <= F.col("t") + 10**9).drop("t")), dies)
    return _changed(spark, sf, *incremental.capture(spark, scan, symbols, root))


_TREE = f"""
WITH RECURSIVE latest AS (
  SELECT folder_path, {_KEY.format("folder_path")} AS k, CASE WHEN trim(parent_folder_path) <> '' THEN {_KEY.format("parent_folder_path")} END AS pk,
         row_number() OVER (PARTITION BY {_KEY.format("folder_path")} ORDER BY indexed_at DESC NULLS LAST, folder_path DESC) AS n
  FROM indexed_folders WHERE trim(folder_path) <> ''
), nodes AS (
  SELECT a.folder_path, a.k, b.k AS pk FROM (SELECT * FROM latest WHERE n = 1) a LEFT JOIN (SELECT k FROM latest WHERE n = 1) b ON a.pk = b.k
), tree AS (
  SELECT folder_path, k, folder_path AS root_path, 0 AS depth FROM nodes WHERE pk IS NULL
  UNION ALL
  SELECT n.folder_path, n.k, t.root_path, t.depth + 1 FROM nodes n JOIN tree t ON n.pk = t.k
), lost AS (SELECT * FROM nodes WHERE k NOT IN (SELECT k FROM tree)), walk AS (
  SELECT k AS start, k AS at, 0 AS step FROM lost
  UNION ALL
  SELECT w.start, l.pk, w.step + 1 FROM walk w JOIN lost l ON w.at = l.k WHERE w.step < 2 * (SELECT count(*) FROM lost)
), circles AS (
  SELECT w.start, min(l.folder_path) AS root_path FROM walk w JOIN lost l ON w.at = l.k WHERE w.step >= (SELECT count(*) FROM lost) GROUP BY w.start
)
"""


@query(
    "p7_found",
    _TREE
    + """
SELECT folder_path, root_path, CAST(depth AS INTEGER) AS depth FROM tree
UNION ALL
SELECT l.folder_path, c.root_path, -1 FROM lost l JOIN circles c ON l.k = c.start
""",
)
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    tree = hierarchy(table(spark, sf, "indexed_folders"), "folder_path", "parent_folder_path", "indexed_at")
    return tree.select(F.col("path").alias("folder_path"), "root_path", "depth")


@query(
    "p7_descendants",
    _TREE
    + """
, up AS (
  SELECT n.k, n.pk AS above FROM nodes n JOIN tree t ON n.k = t.k WHERE n.pk IS NOT NULL
  UNION ALL
  SELECT u.k, n.pk FROM up u JOIN nodes n ON u.above = n.k WHERE n.pk IS NOT NULL
)
SELECT t.folder_path, CAST(count(u.k) AS BIGINT) AS n_descendants FROM tree t LEFT JOIN up u ON u.above = t.k GROUP BY t.folder_path
""",
)
def p7_descendants(spark: SparkSession, sf: str) -> DataFrame:
    tree = hierarchy(table(spark, sf, "indexed_folders"), "folder_path", "parent_folder_path", "indexed_at")
    return tree.where("depth >= 0").select(F.col("path").alias("folder_path"), "n_descendants")

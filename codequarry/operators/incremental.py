"""What a run must process: files and symbols that are new or changed since the last successful run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions.paths import blank, path_key
from codequarry.session import shared_folder
from codequarry.streaming.changelog import ChangeLog

SUCCESS = "success"


def same_hash(a: Column, b: Column) -> Column:
    """Hash equality; case and outer blanks mean nothing, NULL equals nothing."""
    return F.lower(F.trim(a)) == F.lower(F.trim(b))


def latest_sightings(scan: DataFrame) -> DataFrame:
    """Per file the sighting with the latest ``scanned_at``, then the highest ``scan_seq``; NULL paths and offsets are left out.

    A reduction that can be applied to parts and again to their union. Repeated rows give one.
    """
    row = F.struct("scanned_at", "scan_seq", "file_path", "file_hash")
    return scan.where(F.col("file_path").isNotNull() & F.col("scan_seq").isNotNull()).groupBy(path_key(F.col("file_path")).alias("file_key")).agg(F.max(row).alias("r")).select("file_key", "r.*")


def recorded_hashes(hashes: DataFrame, runs: DataFrame) -> DataFrame:
    """Per file the hash of the latest ``last_indexed`` (then the highest run) among rows of successful runs.

    Status spelling: case and outer blanks mean nothing. Runs that are missing, failed or running don't count.
    """
    good = runs.where(F.lower(F.trim(F.col("status"))) == SUCCESS).select(F.col("run_id").alias("g_run")).distinct()
    rows = hashes.where(F.col("file_path").isNotNull()).join(good, F.col("run_id") == F.col("g_run"), "left_semi")
    return rows.groupBy(path_key(F.col("file_path")).alias("r_key")).agg(F.max(F.struct("last_indexed", "run_id", "file_hash")).alias("r")).select("r_key", F.col("r.file_hash").alias("recorded"))


def changed_files(sightings: DataFrame, recorded: DataFrame) -> DataFrame:
    """Latest sightings whose hash is known and differs from the recorded one (or there is none).

    A recorded row whose hash is NULL counts as a difference; files that are gone (NULL hash) are no change.
    """
    got = sightings.where(F.col("file_hash").isNotNull()).join(recorded, F.col("file_key") == F.col("r_key"), "left")
    return got.where(~F.coalesce(same_hash(F.col("file_hash"), F.col("recorded")), F.lit(False))).select("scan_seq", "file_path", "file_key", "file_hash")


def _stale() -> Column:
    h = F.col("content_hash")
    fits = same_hash(h, F.md5(F.coalesce(F.col("content"), F.lit("")).cast("binary")))
    return F.coalesce(blank(h), F.lit(True)) | ~F.coalesce(fits, F.lit(False))


def stale_symbols(symbols: DataFrame) -> DataFrame:
    """Symbols whose ``content_hash`` is NULL, blank or not the MD5 of ``content`` (NULL content counts as empty)."""
    return symbols.where(_stale())


EDITS = "id long, off long, digest long, stale boolean, was_stale boolean"


def symbol_edits(symbols: DataFrame, before: DataFrame, off: int) -> DataFrame:
    """Log rows, at offset ``off``, of symbols that are new, changed in place or gone since the log ``before``.

    A symbol is known by the digest of its content and hash; one that is gone has none and isn't
    stale. Several rows of an id count as one, stale if any of them is.
    """
    one = F.xxhash64("content", F.col("content").isNull(), "content_hash", F.col("content_hash").isNull())
    now = symbols.where(F.col("id").isNotNull()).select("id", one.alias("d"), _stale().alias("s")).groupBy("id").agg(F.xxhash64(F.array_sort(F.collect_list("d"))).alias("digest"), F.bool_or("s").alias("stale"))
    last = before.groupBy(F.col("id").alias("l_id")).agg(F.max(F.struct("off", "digest", "stale")).alias("l"))
    both = now.join(last, F.col("id") == F.col("l_id"), "full").where(~F.col("digest").eqNullSafe(F.col("l.digest")))
    return both.select(F.coalesce("id", "l_id").alias("id"), F.lit(off).cast("long").alias("off"), "digest", F.coalesce("stale", F.lit(False)).alias("stale"), F.coalesce("l.stale", F.lit(False)).alias("was_stale"))


def capture_symbols(spark: SparkSession, symbols: DataFrame, root: str) -> DataFrame:
    """(id) of stale symbols, by a log of edits: each batch appends what differs from the log so far.

    A batch's edits are written before its plan and stand while the plan waits for its commit, so
    a replay takes the same rows; edits without a plan are written again.
    """
    changes = ChangeLog(spark, root, "id", "off")
    log = lambda upto: spark.read.schema(EDITS).parquet(*[f"{root}/edits/batch={k}" for k in range(upto)]) if upto else spark.createDataFrame([], EDITS)
    # rows that weren't stale and aren't now have nothing to say in the sink
    work = lambda rows: rows.where("stale or was_stale").select("id", "off", "stale")
    if changes.pending():
        changes.run(log(changes.next_batch() + 1), work)
    n = changes.next_batch()
    symbol_edits(symbols, log(n), n).write.mode("overwrite").parquet(f"{root}/edits/batch={n}")
    changes.run(log(n + 1), work)
    return changes.sink().groupBy("id").agg(F.max(F.struct("off", "stale")).alias("r")).where("r.stale").select("id")


def files_log(spark: SparkSession, root: str) -> ChangeLog:
    return ChangeLog(spark, f"{root}/files", "file_key", "scan_seq")


def sightings_log(scan: DataFrame) -> DataFrame:
    return scan.where(F.col("file_path").isNotNull()).select("scan_seq", "file_path", "file_hash", "scanned_at", path_key(F.col("file_path")).alias("file_key"))


def capture(spark: SparkSession, scan: DataFrame, symbols: DataFrame, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Runs what is left of both logs and gives the sinks: latest sightings per file, and stale symbols.

    ``root`` keeps plans, commits and sinks between runs; a new folder means that nothing was taken
    yet. A batch that an earlier run left open is replayed first, then what is new is taken.
    """
    root = root or shared_folder(spark, "capture")
    files, log = files_log(spark, root), sightings_log(scan)
    for _ in range(2 if files.pending() else 1):
        files.run(log, lambda rows: latest_sightings(rows))
    return latest_sightings(files.sink()), capture_symbols(spark, symbols, f"{root}/symbols")

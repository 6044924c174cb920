"""Index maintenance: change classification, upserts, cascades, prefixes, Merkle hashes, cache validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions.paths import path_key
from codequarry.operators.incremental import same_hash
from codequarry.session import cut


def file_status(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(file_key, status) by full join of (file_key, file_hash, modified_at) and (file_key, stored_hash, indexed_at).

    Two stages: not modified since it was indexed: ``skipped``; else by hash: ``unchanged`` or
    ``modified`` (a hash that couldn't be read counts as modified). ``new`` and ``deleted`` have one side only.
    """
    s = stored.withColumnRenamed("file_key", "s_key")
    both = current.join(s, F.col("file_key") == F.col("s_key"), "full_outer")
    status = (
        F.when(F.col("s_key").isNull(), "new")
        .when(F.col("file_key").isNull(), "deleted")
        .when(F.col("modified_at") <= F.col("indexed_at"), "skipped")
        .when(F.coalesce(same_hash(F.col("file_hash"), F.col("stored_hash")), F.lit(False)), "unchanged")
        .otherwise("modified")
    )
    return both.select(F.coalesce("file_key", "s_key").alias("file_key"), status.alias("status"))


LEGACY_KEY = ["name", "file_path", "type"]
FULL_KEY = ["file_path", "full_name", "type", "start_line"]


def upsert_latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last writer wins per key; NULLs in a key are equal. Ordered by ``order``, greatest last."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def stable_id(name: Column, path: Column, kind: Column) -> Column:
    return F.xxhash64(name, path, kind)


def cascade_delete(symbols: DataFrame, vectors: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and vectors that are left once the files in ``gone`` (file_key) are deleted; vectors go with their symbols."""
    dead = symbols.withColumn("_k", path_key(F.col("file_path"))).join(gone.select(F.col("file_key").alias("_k")), "_k", "left_semi").select(F.col("id").alias("_id"))
    return symbols.join(dead, F.col("id") == F.col("_id"), "left_anti"), vectors.join(dead, F.col("symbol_id") == F.col("_id"), "left_anti")


def outside_folder(symbols: DataFrame, folder: str) -> DataFrame:
    """Symbols that don't lie below a folder; a folder whose name merely opens the same is another one."""
    k, p = path_key(F.col("file_path")), path_key(F.lit(folder))
    return symbols.where(~F.coalesce(F.startswith(k, F.concat(p, F.lit("/"))), F.lit(False)))


def longest_prefix(files: DataFrame, folders: DataFrame) -> DataFrame:
    """(file_path, folder_path) of the longest indexed folder above each file, '' if there is none.

    The file's ancestors are joined by equality, so no prefix comparison of all pairs is made.
    Ties between spellings of a folder: the greatest.
    """
    f = files.where(F.col("file_path").isNotNull()).select("file_path").distinct()
    parts = F.split(path_key(F.col("file_path")), "/")
    up = f.select("file_path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("k"))
    known = folders.where(F.col("folder_path").isNotNull()).groupBy(path_key(F.col("folder_path")).alias("k")).agg(F.max("folder_path").alias("folder_path"))
    best = up.join(known, "k").groupBy("file_path").agg(F.max(F.struct(F.length("k").alias("n"), "folder_path")).alias("b"))
    return f.join(best, "file_path", "left").select("file_path", F.coalesce("b.folder_path", F.lit("")).alias("folder_path"))


def merkle(files: DataFrame) -> DataFrame:
    """(folder, hash) bottom-up from (path, hash) with normalised paths: MD5 over all lines of a folder's files and folders.

    Lines fall into 4,096 slots by their own MD5; a slot's digest covers its sorted lines, and the
    folder's hash its sorted slots, so that a folder with very many files is no single task's list.

    A folder's hash covers everything below it and doesn't depend on the order of listing.
    One level a round, from the deepest; the rounds are as many as the deepest path has folders.
    """
    parts = F.split("path", "/")
    level = files.select("path", "hash", F.lit("F").alias("kind"), F.size(parts).alias("depth"))
    level = cut(level)
    deepest = level.agg(F.max("depth")).first()[0] or 0
    name = F.element_at(F.split("path", "/"), -1)
    parent = F.array_join(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), "/")
    done = None
    above = None
    for d in range(deepest, 1, -1):
        here = level.where(F.col("depth") == d)
        if above is not None:
            here = here.unionByName(above)
        line = F.concat_ws(":", "kind", name, F.coalesce("hash", F.lit("")))
        digest = lambda c: F.md5(F.array_join(F.array_sort(F.collect_list(c)), "\n").cast("binary"))
        slots = here.select(parent.alias("path"), line.alias("line")).groupBy("path", F.substring(F.md5(F.col("line").cast("binary")), 1, 3).alias("slot")).agg(digest("line").alias("d"))
        folder = slots.groupBy("path").agg(digest(F.concat("slot", F.lit(":"), "d")).alias("hash"))
        above = cut(folder.select("path", "hash", F.lit("D").alias("kind"), F.lit(d - 1).alias("depth")))
        done = above if done is None else done.unionByName(above)
    if done is None:
        return level.where("false").select(F.col("path").alias("folder"), "hash")
    return done.select(F.col("path").alias("folder"), "hash")


def changed_folders(before: DataFrame, after: DataFrame) -> DataFrame:
    """(folder, status) of folders whose Merkle hash is new, changed or gone; equal hashes prune all below."""
    b = before.select(F.col("folder").alias("b_folder"), F.col("hash").alias("b_hash"))
    both = after.join(b, F.col("folder") == F.col("b_folder"), "full_outer")
    status = F.when(F.col("b_folder").isNull(), "new").when(F.col("folder").isNull(), "deleted").when(F.col("hash") != F.col("b_hash"), "changed")
    return both.select(F.coalesce("folder", "b_folder").alias("folder"), status.alias("status")).where("status is not null")


def deleted_subfolders(folders: DataFrame) -> DataFrame:
    """(folder_path, gone) of names in ``subfolders_list`` for which no row is a child of the folder.

    Names are compared ignoring case; broken JSON and NULL lists name nothing.
    """
    listed = folders.where(F.col("folder_path").isNotNull()).select("folder_path", path_key(F.col("folder_path")).alias("k"), F.explode(F.from_json("subfolders_list", "array<string>")).alias("gone"))
    there = folders.where(F.col("folder_path").isNotNull()).select(path_key(F.col("folder_path")).alias("there")).distinct()
    child = F.when(F.col("gone").rlike(r"[\\/]"), path_key(F.col("gone"))).otherwise(F.concat("k", F.lit("/"), F.lower("gone")))
    return listed.withColumn("c", child).join(there, F.col("c") == F.col("there"), "left_anti").select("folder_path", "gone").distinct()


def validate_cache(cache: DataFrame, symbols: DataFrame) -> DataFrame:
    """(query_hash, still_valid) of entries whose ``result_ids`` is a CSV of id:hash.

    Valid if every id still exists and every hash that is given still fits; an empty list is
    valid if it stands for 0 results (``result_count`` = 0). Ids that are no numbers or 0 are invalid.
    """
    e = cache.select("query_hash", "result_count", F.explode_outer(F.when(F.coalesce(F.trim("result_ids"), F.lit("")) != "", F.split("result_ids", ","))).alias("item"))
    e = e.withColumn("rid", F.expr("try_cast(split(trim(item), ':')[0] as bigint)")).withColumn("rhash", F.expr("try_element_at(split(trim(item), ':'), 2)"))
    s = symbols.select(F.col("id").alias("sid"), "content_hash")
    j = e.join(s, F.col("rid") == F.col("sid"), "left")
    fits = F.col("sid").isNotNull() & (F.col("rid") != 0) & (F.coalesce("rhash", F.lit("")).eqNullSafe("") | F.coalesce(same_hash(F.col("rhash"), F.col("content_hash")), F.lit(False)))
    ok = F.when(F.col("item").isNull(), F.coalesce(F.col("result_count") == 0, F.lit(False))).otherwise(F.coalesce(fits, F.lit(False)))
    return j.groupBy("query_hash").agg(F.min(ok).alias("still_valid"))


def orphans(vectors: DataFrame, symbols: DataFrame) -> DataFrame:
    return vectors.join(symbols.select(F.col("id").alias("_s")), F.col("symbol_id") == F.col("_s"), "left_anti")


def folder_consistency(folders: DataFrame, symbols: DataFrame) -> DataFrame:
    """(folder_path, tracked, actual, difference): chunks tracked in the counting row against symbols directly in the folder."""
    last = folders.where(F.col("folder_path").isNotNull()).groupBy(path_key(F.col("folder_path")).alias("k")).agg(F.max(F.struct("indexed_at", "folder_path", "chunks_count")).alias("r")).select("k", "r.*")
    parent = F.regexp_replace(path_key(F.col("file_path")), "/[^/]*$", "")
    n = symbols.where(F.col("file_path").isNotNull()).groupBy(parent.alias("p")).agg(F.count("*").alias("n"))
    j = last.join(n, F.col("k") == F.col("p"), "left")
    tracked, actual = F.coalesce("chunks_count", F.lit(0)).cast("long"), F.coalesce("n", F.lit(0))
    return j.select("folder_path", tracked.alias("tracked"), actual.alias("actual"), (tracked - actual).alias("difference"))


def compatible(stored: dict[str, str], model: str, dim: int) -> None:
    """Raises if an index was built with another embedding model or dimension; an index without either is free."""
    for key, value in (("embedding_model", model), ("embedding_dimensions", str(dim))):
        if stored.get(key) not in (None, "", value):
            raise ValueError(f"the index has {key} {stored[key]}, not {value}")

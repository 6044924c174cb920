"""An index as versioned Parquet tables in one folder.

Every write makes a new version and then moves the table's pointer, so readers see whole
versions only, a failed write leaves the old one, and no table is read and overwritten at once.
Tables that are kept up to date file by file are cut into buckets by the file's key; a version
then names the folder of each bucket, and an update writes the touched buckets only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions.paths import path_key
from codequarry.schema import TABLES, VERSION, conform
from codequarry.streaming.changelog import Store

#: Buckets of a table that is updated by file; their number is fixed when the table is first written.
BUCKETS = 64


def _key(file_col: str) -> Column:
    return F.coalesce(path_key(F.col(file_col)), F.lit(""))


def _bucket(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("b")


class IndexStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._state = Store(spark, f"{self.root}/_state")

    def _now(self, name: str) -> dict:
        return self._state.read(f"{name}.json") or {"version": 0}

    def version(self, name: str) -> int:
        return self._now(name)["version"]

    def read(self, name: str) -> DataFrame:
        """The current version; an empty table if there is none."""
        return self._read(name, self._now(name))

    def _read(self, name: str, now: dict, only: list[int] | None = None) -> DataFrame:
        v, placed = now["version"], now.get("buckets")
        if placed is not None:
            paths = [f"{self.root}/{name}/v={at}/b={b}" for b, at in placed.items() if only is None or int(b) in only]
        else:
            paths = [f"{self.root}/{name}/v={v}"] if v else []
        if not paths:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*paths)

    def write(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> int:
        """A new version of the whole table; versions before the last one are deleted."""
        now = self._now(name)
        v = now["version"] + 1
        w = conform(df, name).write.mode("overwrite")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{self.root}/{name}/v={v}")
        self._state.write(f"{name}.json", {"version": v, "schema": VERSION})
        if now.get("buckets") is None and v > 2:
            self._state.drop(f"{self.root}/{name}/v={v - 2}")
        return v

    def replace(self, name: str, gone: DataFrame, new: DataFrame, file_col: str = "file_path") -> int:
        """Takes out the rows of files in ``gone`` (file_key) and adds ``new``; only the buckets of these files are read and written.

        Rows without a file share the bucket of the empty key. ``gone`` and ``new`` are read several times; cut them before.
        """
        now = self._now(name)
        if now["version"] and now.get("buckets") is None:
            raise ValueError(f"{name} was written as a whole")
        n = now.get("of", self.buckets)
        new = conform(new, name)
        touched = gone.select(_bucket(F.coalesce("file_key", F.lit("")), n)).union(new.select(_bucket(_key(file_col), n))).distinct()
        only = [r["b"] for r in touched.collect()]  # at most ``n`` numbers
        if not only:
            return now["version"]
        dead = gone.select(F.coalesce("file_key", F.lit("")).alias("_dead")).distinct()
        kept = self._read(name, now, only).join(dead, _key(file_col) == F.col("_dead"), "left_anti")
        return self._place(name, kept.unionByName(new), now, file_col, n, {str(b) for b in only})

    def update(self, name: str, change: Callable[[DataFrame], DataFrame], file_col: str = "file_path") -> int:
        """Changes all rows of a table in buckets; a change must leave ``file_col`` as it is."""
        now = self._now(name)
        if not now["version"]:
            return 0
        return self._place(name, conform(change(self._read(name, now)), name), now, file_col, now["of"], set(now["buckets"]))

    def _place(self, name: str, rows: DataFrame, now: dict, file_col: str, n: int, only: set[str]) -> int:
        v = now["version"] + 1
        at = f"{self.root}/{name}/v={v}"
        # a few tasks a bucket, so that one with a big file is not one task's work
        part = F.pmod(F.xxhash64(F.col(rows.columns[0])), F.lit(4))
        rows.withColumn("b", _bucket(_key(file_col), n)).repartition(F.col("b"), part).write.mode("overwrite").partitionBy("b").parquet(at)
        written = {x[2:] for x in self._state.names(at) if x.startswith("b=")}
        placed = {b: x for b, x in now.get("buckets", {}).items() if b not in only} | {b: v for b in sorted(written)}
        self._state.write(f"{name}.json", {"version": v, "schema": VERSION, "buckets": placed, "of": n})
        return v

    def append(self, name: str, df: DataFrame) -> None:
        """Adds rows to the current version in place; for logs, whose rows never change."""
        v = self.version(name) or 1
        conform(df, name).write.mode("append").parquet(f"{self.root}/{name}/v={v}")
        if not self.version(name):
            self._state.write(f"{name}.json", {"version": v, "schema": VERSION})

"""Structured Streaming: files into the index, and the query log into windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codequarry.functions.paths import path_key
from codequarry.operators import maintain, parser
from codequarry.plans.ingest import to_symbols
from codequarry.plans.store import IndexStore
from codequarry.session import cut


def file_stream(spark: SparkSession, folder: str, glob: str = "*.pas") -> DataFrame:
    """(path, text) of files as they appear below a folder."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return raw.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.decode("content", "UTF-8").alias("text"))


def ingest(stream: DataFrame, store: IndexStore, checkpoint: str):
    """Parses files and upserts their symbols batch by batch; a replayed batch gives the same index."""

    def merge(batch: DataFrame, _: int) -> None:
        batch = cut(batch.select("path", path_key(F.col("path")).alias("file_key"), "text"))
        new = cut(maintain.upsert_latest(to_symbols(parser.parse_units(batch, "path", "text")), ["id"], ["start_line"]))
        if batch.limit(1).count():
            store.replace("symbols", batch.select("file_key"), new)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def parquet_stream(spark: SparkSession, folder: str, glob: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def upsert_stream(stream: DataFrame, key: str, order: str, out: str, checkpoint: str):
    """Keeps the latest row per key in versions below ``out``: batch n holds the state after it; replays overwrite it."""
    spark = stream.sparkSession

    def merge(batch: DataFrame, n: int) -> None:
        if n:
            batch = batch.unionByName(spark.read.parquet(f"{out}/batch={n - 1}"))
        maintain.upsert_latest(batch, [key], [order]).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def query_windows(log: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per window and value; rows later than the watermark are left out once their window is closed."""
    return log.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def run_to_table(df: DataFrame, out: str, checkpoint: str, mode: str = "append", work: Callable[[DataFrame], DataFrame] | None = None):
    """Runs a stream over what is there now, into Parquet below ``out``; in complete mode the last batch is the result."""

    def write(batch: DataFrame, n: int) -> None:
        (work(batch) if work else batch).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Indexing a source folder: listing, change detection, parsing, embedding, upsert and cascade."""

from __future__ import annotations

from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from codequarry.functions import text
from codequarry.functions.paths import path_key
from codequarry.operators import maintain, parser
from codequarry.operators.embed import embed_column
from codequarry.plans.store import IndexStore
from codequarry.session import cut
from codequarry.sources import files as src


def to_symbols(parsed: DataFrame, content_type: str = "code", source_category: str = "user") -> DataFrame:
    """Parsed rows as symbols with stable ids; rows of failed units keep the file's name and the type ``unknown``."""
    name = F.coalesce("name", src.stem(F.col("file_path")))
    s = parsed.withColumn("name", name).withColumn("type", F.coalesce("type", F.lit("unknown"))).withColumn("full_name", F.coalesce("full_name", F.col("name")))
    line = F.coalesce("start_line", F.lit(0)).cast("string")
    return s.select("*", F.xxhash64("file_path", "full_name", "type", "is_declaration", line).alias("id"), F.lit(content_type).alias("content_type"), F.lit(source_category).alias("source_category"), F.md5(F.coalesce("content", F.lit("")).cast("binary")).alias("content_hash"), F.current_timestamp().alias("created_at"))


def index_folder(spark: SparkSession, store: IndexStore, root: str, force: bool = False, dim: int = 0, category: str = "user") -> dict[str, int]:
    """Brings the index up to date with a folder; counts of new, changed, deleted and skipped files.

    Files whose time is not after their last indexing are not read. Rows of changed and deleted
    files go, with their vectors; other rows stay as they are, so cached results stay valid.
    """
    began = datetime.now(timezone.utc)
    here = src.list_files(spark, root)
    listed = cut(here.withColumn("file_key", path_key(F.col("path"))))
    known = store.read("indexed_files").where(F.startswith(path_key(F.col("file_path")), F.concat(path_key(F.lit(root)), F.lit("/"))))
    stored = known.select(path_key(F.col("file_path")).alias("file_key"), F.col("file_hash").alias("stored_hash"), F.col("indexed_at").alias("indexed_at"))
    if force:
        stored = stored.withColumn("indexed_at", F.lit(None).cast("timestamp")).withColumn("stored_hash", F.lit(None).cast("string"))
    fresh = listed.join(stored.select("file_key", "indexed_at"), "file_key", "left").where(F.col("indexed_at").isNull() | (F.col("modified_at") > F.col("indexed_at")))
    texts = cut(src.read_text(spark, fresh.select("path")).withColumn("file_hash", F.md5(F.col("text").cast("binary"))))
    current = listed.join(texts.select("path", "file_hash"), "path", "left").select("file_key", "path", "file_hash", "modified_at", "size")
    status = cut(maintain.file_status(current.select("file_key", "file_hash", "modified_at"), stored))
    counts = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
    todo = status.where(F.col("status").isin("new", "modified")).select("file_key")
    if counts.keys() - {"skipped", "unchanged"} or not store.version("symbols"):
        work = texts.withColumn("file_key", path_key(F.col("path"))).join(todo, "file_key", "left_semi")
        symbols = cut(to_symbols(parser.parse_units(work, "path", "text"), source_category=category))
        new = cut(maintain.upsert_latest(symbols, ["id"], ["start_line"]))
        dead = cut(status.where(F.col("status").isin("new", "modified", "deleted")).select("file_key"))
        store.replace("symbols", dead, new)
        if dim:
            c = F.col
            t = text.embedding_text(c("name"), c("full_name"), c("type"), c("parent_class"), F.array_join("implemented_interfaces", ","), c("file_path"), c("comments"), c("content"))
            made = embed_column(new.select(F.col("id").alias("symbol_id"), F.col("id").cast("string").alias("chunk_id"), t.alias("embedding_text"), "file_path"), "embedding_text", dim).withColumnRenamed("vec", "embedding")
            store.replace("vec_embeddings", dead, cut(made))
        elif store.version("vec_embeddings"):
            store.replace("vec_embeddings", dead, store.read("vec_embeddings").limit(0))
        n = new.groupBy("file_path").agg(F.count("*").alias("chunks_count"))
        rows = current.join(todo, "file_key", "left_semi").join(n, F.col("path") == F.col("file_path"), "left")
        rows = rows.select(F.col("path").alias("file_path"), F.regexp_replace("path", "/[^/]*$", "").alias("folder_path"), "file_hash", F.col("size").alias("file_size"), F.col("modified_at").alias("last_modified"), F.lit(began).alias("indexed_at"), F.coalesce("chunks_count", F.lit(0)).cast("int").alias("chunks_count"))
        store.replace("indexed_files", dead, cut(rows))
        store.update("query_cache", lambda c: c.withColumn("cache_valid", F.lit(False)), "query_hash")
    seconds = int((datetime.now(timezone.utc) - began).total_seconds())
    files = store.read("indexed_files")
    tree = maintain.merkle(files.select(path_key(F.col("file_path")).alias("path"), F.col("file_hash").alias("hash")))
    top = path_key(F.lit(root))
    folders = tree.where((F.col("folder") == top) | F.startswith("folder", F.concat(top, F.lit("/"))))
    per = files.groupBy(path_key(F.col("folder_path")).alias("f_key")).agg(F.count("*").cast("int").alias("files_count"), F.sum("chunks_count").cast("int").alias("chunks_count"))
    made = folders.join(per, F.col("folder") == F.col("f_key"), "left").select(F.col("folder").alias("folder_path"), F.lit(began).alias("indexed_at"), F.lit(seconds).alias("duration_seconds"), "files_count", "chunks_count", F.lit("code").alias("content_type"), F.lit(category).alias("source_category"), F.col("hash").alias("folder_hash"), F.when(F.col("folder") != top, F.regexp_replace("folder", "/[^/]*$", "")).alias("parent_folder_path"))
    others = store.read("indexed_folders").where(~((F.col("folder_path") == top) | F.startswith("folder_path", F.concat(top, F.lit("/")))))
    store.write("indexed_folders", others.unionByName(made, allowMissingColumns=True))
    return counts


def reindex(spark: SparkSession, store: IndexStore, force: bool = False, dim: int = 0) -> dict[str, dict[str, int]]:
    """Brings every root folder of the index up to date, by path, each under its category; counts as ``index_folder`` gives them.

    Roots are the folders without a parent in the index; there are few of them by nature. A root
    that is no longer there is reported with no counts, and its rows stay.
    """
    roots = store.read("indexed_folders").where("parent_folder_path is null").select("folder_path", "source_category").orderBy("folder_path").collect()
    out = {}
    for r in roots:
        spelled = store.read("indexed_files").where((path_key(F.col("folder_path")) == r["folder_path"]) | F.startswith(path_key(F.col("folder_path")), F.lit(r["folder_path"] + "/"))).select("folder_path").limit(1).collect()
        root = spelled[0]["folder_path"][: len(r["folder_path"])] if spelled else r["folder_path"]
        try:
            out[root] = index_folder(spark, store, root, force, dim, r["source_category"] or "user")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            out[root] = {}
    return out


def index_packages(spark: SparkSession, store: IndexStore, root: str) -> None:
    """Package sources below a folder to ``packages`` and ``package_files``, with their frameworks by dependency."""
    from codequarry.operators import intel

    found = src.package_files(spark, root)

    def clauses(batches):
        for b in batches:
            got = [parser.package_clauses(t or "") for t in b.column("text").to_pylist()]
            c = pa.array([{"requires": r, "contains": [{"unit": u, "path": p} for u, p in k], "tag": t} for r, k, t in got], pa.struct([("requires", pa.list_(pa.string())), ("contains", pa.list_(pa.struct([("unit", pa.string()), ("path", pa.string())]))), ("tag", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("text"), c], ["path", "text", "c"])

    read = found.mapInArrow(clauses, "path string, text string, c struct<requires:array<string>,contains:array<struct<unit:string,path:string>>,tag:string>")
    p = cut(read.select(src.stem(F.col("path")).alias("package_name"), F.col("path").alias("package_path"), F.md5(F.col("text").cast("binary")).alias("file_hash"), "c"))
    req = p.select(F.col("package_name").alias("package"), F.posexplode_outer("c.requires").alias("ordinal", "requires"))
    fw = intel.package_frameworks(req.withColumn("ordinal", F.coalesce("ordinal", F.lit(0))), p.where("c.tag is not null").select(F.col("package_name").alias("package"), F.col("c.tag").alias("tag")))
    out = p.join(fw, F.lower("package_name") == F.col("package")).select("package_name", "package_path", "framework", F.lit("requires").alias("detection_method"), F.current_timestamp().alias("last_scanned"), "file_hash", F.col("c.requires").alias("requires"), F.col("c.contains.unit").alias("contains"), F.current_timestamp().alias("created_at"))
    store.write("packages", out)
    store.write("package_files", p.select("package_name", F.explode("c.contains").alias("f")).select("package_name", F.coalesce("f.path", F.concat("f.unit", F.lit(".pas"))).alias("file_path"), F.lit("contains").alias("source_clause")))

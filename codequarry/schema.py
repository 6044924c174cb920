"""Tables of the index and their migrations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Domains of columns.
CONTENT_TYPES = ["code", "help", "markdown", "comment"]
SOURCE_CATEGORIES = ["user", "stdlib", "third_party", "official_help", "project_docs"]
SYMBOL_TYPES = ["class", "interface", "record", "procedure", "function", "constructor", "destructor", "property", "type", "const", "var", "unknown"]
MATCH_TYPES = ["exact_name", "partial_name", "fuzzy_name", "full_text", "vector_similarity", "reranked", "cache_hit", "file_symbol", "line_match", "definition", "reference", "semantic"]

VERSION = 3

_ID_LIST = T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("hash", T.StringType())]))
# no session is needed to know the tables
_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType()), "array<float>": T.ArrayType(T.FloatType()), "idlist": _ID_LIST, "map": T.MapType(T.StringType(), T.StringType())}

TABLES: dict[str, T.StructType] = {
    name: T.StructType([T.StructField(c.split()[0], _TYPES[c.split()[1]]) for c in ddl.split(", ")])
    for name, ddl in {
        "symbols": "id bigint, name string, full_name string, type string, file_path string, content string, enriched_text string, spanish_terms array<string>, domain_tags array<string>, comments string, parent_class string, implemented_interfaces array<string>, visibility string, start_line int, end_line int, content_type string, source_category string, framework string, platforms array<string>, delphi_version string, introduced_version string, deprecated_version string, is_inherited boolean, inherited_from string, content_hash string, created_at timestamp, container string, ancestor string, is_declaration boolean",
        "vec_embeddings": "symbol_id bigint, chunk_id string, embedding_text string, embedding array<float>, file_path string",
        "metadata": "key string, value string",
        "indexed_folders": "folder_path string, indexed_at timestamp, duration_seconds int, files_count int, chunks_count int, content_type string, source_category string, folder_hash string, parent_folder_path string, subfolders array<string>",
        "indexed_files": "file_path string, folder_path string, file_hash string, file_size bigint, last_modified timestamp, indexed_at timestamp, chunks_count int",
        "query_log": "id bigint, executed_at timestamp, query_text string, query_hash string, result_ids idlist, cache_valid boolean, filters map, num_results_requested int, max_distance double, use_semantic_search boolean, use_reranker boolean, candidate_count int, duration_ms bigint, result_count int, exact_match_found boolean, cache_hit boolean",
        "query_cache": "query_hash string, query_text string, result_ids idlist, result_count int, cache_valid boolean, hit_count bigint, first_seen timestamp, last_seen timestamp, avg_duration_ms bigint",
        "packages": "package_name string, package_path string, framework string, detection_method string, category string, last_scanned timestamp, file_hash string, requires array<string>, contains array<string>, created_at timestamp",
        "package_files": "package_name string, file_path string, source_clause string",
    }.items()
}


def conform(df: DataFrame, name: str) -> DataFrame:
    """The table's columns in order: missing ones NULL, types cast, CSV strings split where the table has arrays; others are dropped."""
    out = []
    for f in TABLES[name]:
        if f.name not in df.columns:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(df.schema[f.name].dataType, T.StringType):
            c = F.col(f"`{f.name}`")
            parts = F.when(F.startswith(F.ltrim(c), F.lit("[")), F.from_json(c, "array<string>")).otherwise(F.transform(F.split(c, ","), lambda x: F.trim(x)))
            out.append(F.when(F.trim(c) != "", parts).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name))
    return df.select(*out)


def migrate(tables: dict[str, DataFrame], version: int) -> dict[str, DataFrame]:
    """Tables of an older version brought to this one: 1 adds columns, 2 joins file hashes with folders to ``indexed_files``, 3 builds the cache from the log."""
    from codequarry.operators import analytics, maintain

    out = dict(tables)
    if version < 2 and "file_hashes" in out and "indexed_files" not in out:
        h = out["file_hashes"]
        known = maintain.longest_prefix(h, out["indexed_folders"]) if "indexed_folders" in out else h.select("file_path", F.lit("").alias("folder_path")).distinct()
        out["indexed_files"] = h.join(known, "file_path", "left").withColumnRenamed("last_indexed", "indexed_at").withColumnRenamed("chunk_count", "chunks_count")
    if version < 3 and "query_log" in out and "query_cache" not in out:
        out["query_cache"] = analytics.log_to_cache(out["query_log"].withColumnRenamed("id", "log_id")).withColumnRenamed("avg_ms", "avg_duration_ms")
    return {n: conform(d, n) for n, d in out.items() if n in TABLES}

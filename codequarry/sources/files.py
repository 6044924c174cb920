"""File sources: listing, exclusion, reading, interface truncation, help pages, packages and JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions.paths import file_name

# Folders and file endings that are never indexed.
EXCLUDED_FOLDERS = [".git", ".svn", ".hg", "__history", "__recovery", "backup", "win32", "win64", "debug", "release", "__dcu_cache"]
EXCLUDED_FILES = r"_(tlb|impl)\.pas$"
NO_INDEX = ".noindex"


def excluded(path: Column) -> Column:
    """Whether a path lies in an excluded folder or names a generated unit; NULL is not excluded."""
    p = F.lower(F.translate(path, "\\", "/"))
    return F.coalesce(p.rlike(EXCLUDED_FILES) | F.arrays_overlap(F.split(p, "/"), F.array(*map(F.lit, EXCLUDED_FOLDERS))), F.lit(False))


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it: that of its scheme, or the local one where it has none."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def list_files(spark: SparkSession, root: str, glob: str = "*.pas") -> DataFrame:
    """(path, modified_at, size) of files below a folder, without their content, less the excluded ones.

    Folders with a ``.noindex`` file are left out with all below them. A missing folder raises.
    The folder may lie in any file system that Spark and Arrow know; one without a scheme must
    be mounted at the same place on all nodes.
    """
    read = lambda g: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", g).load(root).select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("size"))
    files = read(glob).withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
    base = root.rstrip("/")
    files = files.where(~excluded(F.expr(f"substring(path, {len(base) + 1})")))
    up = files.select("path", F.explode(_folders(F.col("path"))).alias("folder"))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Spark's own listing passes over files whose names open with a dot
        for b in batches:
            found = []
            for f in b.column("folder").to_pylist():
                where, p = _located(f"{f}/{NO_INDEX}")
                found.append(where.get_file_info(p).type != fs.FileType.NotFound)
            yield b.filter(pa.array(found, pa.bool_()))

    marks = up.select("folder").distinct().mapInArrow(marked, "folder string")
    hidden = up.join(marks, "folder", "left_semi").select("path").distinct()
    return files.join(hidden, "path", "left_anti")


def _folders(path: Column) -> Column:
    parts = F.split(path, "/")
    first = F.when(F.contains(path, F.lit("://")), 4).otherwise(2)  # below a scheme and its host
    return F.transform(F.sequence(F.least(first, F.size(parts) - 1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def read_text(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(path, text) of listed files, decoded as UTF-8 or else Latin-1, without a byte order mark; blank files are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, texts = [], []
            for p in b.column("path").to_pylist():
                where, at = _located(p)
                with where.open_input_stream(at) as f:
                    raw = f.read()
                try:
                    t = raw.decode("utf-8-sig")
                except UnicodeDecodeError:
                    t = raw.decode("latin-1")
                if t.strip():
                    paths.append(p)
                    texts.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], ["path", "text"])

    return files.select("path").mapInArrow(run, "path string, text string")


def scan_sources(spark: SparkSession, root: str, glob: str = "*.pas") -> DataFrame:
    """(path, text) of the sources below a folder that aren't excluded."""
    return read_text(spark, list_files(spark, root, glob))


DIRECTIVE = re.compile(r"'(?:[^'\r\n]|'')*'?|\(\*\$(.*?)\*\)|\{\$(.*?)\}|\{[^}]*\}|\(\*.*?\*\)|//[^\r\n]*|\bimplementation\b", re.I | re.S)


def interface_part(text: str) -> str:
    """A unit up to ``implementation``, unless that word stands within a conditional; else the whole text."""
    depth = 0
    for m in DIRECTIVE.finditer(text):
        d = (m.group(1) or m.group(2) or "").strip().lower()
        if d.startswith(("ifdef", "ifndef", "ifopt", "if ")):
            depth += 1
        elif d.startswith(("endif", "ifend")):
            depth = max(0, depth - 1)
        elif m.group().lower() == "implementation" and depth == 0:
            return text[: m.start()]
    return text


def truncate_interface(text: Column) -> Column:
    """Each unit up to its implementation part; NULL stays NULL."""
    return F.pandas_udf(lambda texts: texts.map(lambda t: None if t is None else interface_part(t)), "string")(text)


def help_pages(spark: SparkSession, root: str) -> DataFrame:
    """(path, html) of ``.htm`` and ``.html`` files below a folder."""
    both = list_files(spark, root, "*.htm*")
    return read_text(spark, both).withColumnRenamed("text", "html")


def package_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of ``.dpk`` package sources below a folder."""
    return scan_sources(spark, root, "*.dpk")


def extraction_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def overrides(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, file, pattern, framework, reason) of a mapping file {overrides: [...]}, in file order."""
    one = spark.read.option("multiLine", True).schema("overrides array<struct<file:string,pattern:string,framework:string,reason:string>>").json(path)
    return one.select(F.posexplode("overrides").alias("ordinal", "o")).select("ordinal", "o.*")


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def write_overrides(entries: DataFrame, path: str) -> None:
    """Writes (ordinal, file, pattern, framework, reason) as one mapping file {overrides: [...]}, in order, without NULL fields."""
    rows = entries.orderBy("ordinal").toLocalIterator()
    where, at = _located(path)
    with where.open_output_stream(at) as f:
        f.write(b'{"overrides": [')
        for i, r in enumerate(rows):
            e = {k: v for k, v in r.asDict().items() if k != "ordinal" and v is not None}
            f.write(((",\n  " if i else "\n  ") + json.dumps(e, ensure_ascii=False)).encode())
        f.write(b"\n]}\n")

"""Parsing, streaming, editor and formatting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.operators import parser, search
from codequarry.plans import editor
from codequarry.plans.lookup import format_results
from codequarry.functions import text
from codequarry.query_sets.search import _EXACT, _NQ, _hybrid, text_queries
from codequarry.registry import query
from codequarry.session import shared_folder, table
from codequarry.streaming import ingest


@query("parse_units")
def parse_units(spark, sf):
    s = table(spark, sf, "symbols").where("lower(file_path) like '%.pas' and content is not null")
    return parser.parse_units(s.select(F.col("id").cast("string").alias("path"), F.col("content").alias("text"))).select("file_path", "parse_status", "full_name", "type", "visibility", "is_declaration", "start_line", "end_line")


_OPENS = r"(?i)^(procedure|function|constructor|destructor)\s+(\w+(?:\.\w+)*)\s*[(;:]"
_UNIT = r"(?i)^\s*unit\s+([\w.]+)\s*;"


@query(
    "parsed_heads",
    f"""
WITH s AS (SELECT id, content FROM symbols WHERE lower(file_path) LIKE '%.pas' AND content IS NOT NULL)
SELECT id, regexp_extract(content, '{_OPENS}', 2) AS name, lower(regexp_extract(content, '{_OPENS}', 1)) AS kind FROM s WHERE regexp_matches(content, '{_OPENS}')
UNION ALL SELECT id, regexp_extract(content, '{_UNIT}', 1), 'unit' FROM s WHERE regexp_matches(content, '{_UNIT}')
""",
)
def parsed_heads(spark, sf):
    """What the parser takes texts for that open with a routine or a unit: the outermost first declaration, or the unit."""
    s = table(spark, sf, "symbols").where("lower(file_path) like '%.pas' and content is not null")
    rows = parser.parse_units(s.select(F.col("id").cast("string").alias("path"), F.col("content").alias("text")))
    first = rows.groupBy(F.col("file_path").cast("long").alias("p_id")).agg(F.max("unit").alias("unit"), F.min(F.struct("start_line", (-F.col("end_line")).alias("e"), "full_name", "type")).alias("r"))
    got = s.join(first, F.col("id") == F.col("p_id"))
    routines = got.where(F.col("content").rlike(_OPENS)).select("id", F.col("r.full_name").alias("name"), F.col("r.type").alias("kind"))
    return routines.unionByName(got.where(F.col("content").rlike(_UNIT)).select("id", F.col("unit").alias("name"), F.lit("unit").alias("kind")))


@query("method_signatures")
def method_signatures(spark, sf):
    """The heading of every routine, long ones too; SQL can't scan past strings and comments, so it has none."""
    short = F.pandas_udf(lambda s: s.map(lambda t: None if t is None else parser.signature(t)), "string")
    return table(spark, sf, "symbols").where("lower(type) in ('function', 'procedure')").select("id", short("content").alias("heading"))


@query("stream_ingest", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def stream_ingest(spark, sf):
    out = shared_folder(spark, "stream")
    schema = table(spark, sf, "events").schema
    stream = ingest.parquet_stream(spark, sf, "events.parquet", schema).select("user_id", "event_id")
    q = ingest.upsert_stream(stream, "user_id", "event_id", f"{out}/table", f"{out}/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{out}/table/batch={q.lastProgress['batchId'] if q.lastProgress else 0}").select("user_id", "event_id")


@query("stream_windows", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, sf):
    out = shared_folder(spark, "windows")
    schema = table(spark, sf, "events").schema
    log = ingest.parquet_stream(spark, sf, "events.parquet", schema).select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    q = ingest.run_to_table(ingest.query_windows(log, "ts", "event_type"), f"{out}/table", f"{out}/checkpoint", "complete")
    q.awaitTermination()
    return spark.read.parquet(f"{out}/table").select(F.unix_micros("start").alias("start_us"), "event_type", "n")


_LSP = " ".join(f"WHEN '{k}' THEN {v}" for k, v in text.LSP_KINDS.items())
_URI = r"CASE WHEN starts_with(replace(file_path, '\', '/'), '/') THEN 'file://' ELSE 'file:///' END || replace(replace(replace(replace(file_path, '\', '/'), '%', '%25'), ' ', '%20'), '#', '%23')"
_LINE = "greatest(coalesce(start_line, 1) - 1, 0)"
# names that sanitizing changes are looked up in their clean form; each has a symbol of that name here
_DEF = f"WITH {_NQ}, d AS ({_EXACT})"


@query("editor_definition", f"{_DEF} SELECT query_id, {_URI} AS uri, {_LINE} AS line FROM d JOIN symbols ON symbol_id = id")
def editor_definition(spark, sf):
    s = table(spark, sf, "symbols")
    q = s.where("id % 50 = 0 and name is not null").select(F.col("id").alias("query_id"), F.col("name").alias("text"))
    return editor.definition(q, s).select("query_id", "uri", F.col("range.start.line").alias("line"))


@query("workspace_symbols", f"WITH h AS ({_hybrid(50)}) SELECT query_id, rank, name, CASE lower(type) {_LSP} ELSE 13 END AS kind, {_URI} AS uri FROM h JOIN symbols ON symbol_id = id")
def workspace_symbols(spark, sf):
    return editor.workspace_symbols(text_queries(spark, sf), table(spark, sf, "symbols")).select("query_id", "rank", "name", "kind", "uri")


@query(
    "editor_hover",
    f"""{_DEF} SELECT query_id, array_to_string(list_filter([
  '```pascal' || chr(10) || array_to_string(list_filter([CASE WHEN trim(visibility) <> '' THEN visibility END, type, coalesce(CASE WHEN trim(full_name) <> '' THEN full_name END, name)], lambda x: x IS NOT NULL), ' ') || chr(10) || '```',
  CASE WHEN coalesce(trim(parent_class), '') <> '' OR coalesce(trim(implemented_interfaces), '') <> '' THEN '(' || array_to_string(list_filter([CASE WHEN trim(parent_class) <> '' THEN parent_class END, regexp_replace(CASE WHEN trim(implemented_interfaces) <> '' THEN implemented_interfaces END, '\\s*,\\s*', ', ', 'g')], lambda x: x IS NOT NULL), ', ') || ')' END,
  CASE WHEN trim(comments) <> '' THEN comments END, '*' || file_path || '*'], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS markdown FROM d JOIN symbols ON symbol_id = id""",
)
def editor_hover(spark, sf):
    s = table(spark, sf, "symbols")
    q = s.where("id % 50 = 0 and name is not null").select(F.col("id").alias("query_id"), F.col("name").alias("text"))
    return editor.hover(q, s)


@query("format_results")
def formatted(spark, sf):
    s, q = table(spark, sf, "symbols"), text_queries(spark, sf)
    got = search.hybrid(q, s, 5).join(s, F.col("symbol_id") == F.col("id"))
    return format_results(got)

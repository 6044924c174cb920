"""What an editor asks: definition, references, hover and symbols, as DataFrames with 0-based positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import text
from codequarry.operators import parser, search


def _range() -> Column:
    start = F.greatest(F.coalesce("start_line", F.lit(1)) - 1, F.lit(0))
    end = F.greatest(F.coalesce("end_line", "start_line", F.lit(1)) - 1, start)
    return F.struct(text.position(start, F.lit(0)).alias("start"), text.position(end, F.lit(0)).alias("end"))


def location(symbols: DataFrame) -> DataFrame:
    return symbols.select("id", text.path_to_uri(F.col("file_path")).alias("uri"), _range().alias("range"))


def at_position(spark: SparkSession, line_text: str, character: int) -> DataFrame:
    """The identifier under the cursor as a query table, empty if there is none."""
    word = parser.identifier_at(line_text, character)[0]
    return spark.createDataFrame([(1, word)] if word else [], "query_id long, text string")


def definition(queries: DataFrame, symbols: DataFrame) -> DataFrame:
    """(query_id, uri, range) of the exact match, or else of the best partial one."""
    got = search.exact(queries, symbols).select("query_id", "symbol_id")
    return got.join(location(symbols), F.col("symbol_id") == F.col("id")).select("query_id", "uri", "range")


def references(queries: DataFrame, symbols: DataFrame, n: int = 100) -> DataFrame:
    got = search.references(queries.select("query_id", F.col("text").alias("name")), symbols, n)
    return got.join(location(symbols), F.col("symbol_id") == F.col("id")).select("query_id", "pos", "match_type", "uri", "range")


def hover(queries: DataFrame, symbols: DataFrame) -> DataFrame:
    """(query_id, markdown): heading, inheritance, comment and place."""
    got = search.exact(queries, symbols).select("query_id", "symbol_id").join(symbols, F.col("symbol_id") == F.col("id"))
    c = F.col
    md = F.concat_ws("\n\n", F.concat(F.lit("```pascal\n"), text.symbol_line(c("type"), c("full_name"), c("name"), c("visibility")), F.lit("\n```")), text.nullif_blank(text.inheritance_line(c("parent_class"), c("implemented_interfaces"))), text.nullif_blank(c("comments")), F.concat(F.lit("*"), c("file_path"), F.lit("*")))
    return got.select("query_id", md.alias("markdown"))


def document_symbols(symbols: DataFrame, path: str) -> DataFrame:
    return search.symbols_in_file(symbols, path).select("name", text.lsp_kind(F.col("type")).alias("kind"), _range().alias("range"))


def workspace_symbols(queries: DataFrame, symbols: DataFrame, n: int = 50) -> DataFrame:
    got = search.hybrid(queries, symbols, n)
    own = symbols.select("id", "name", text.lsp_kind(F.col("type")).alias("kind"), text.path_to_uri(F.col("file_path")).alias("uri"), _range().alias("range"))
    return got.join(own, F.col("symbol_id") == F.col("id")).select("query_id", "rank", "name", "kind", "uri", "range")

"""Scalar functions and predicates over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.functions import paths, text
from codequarry.registry import query
from codequarry.session import table

#: DuckDB: sorted distinct keywords of an expression.
KW = "list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({0}, '\\b([A-Za-z_][A-Za-z0-9_]*)\\b', 1), lambda w: lower(w)), lambda w: length(w) > 2)))"
SIM = f"((CASE WHEN {{0}} <> '' AND contains(lower({{1}}), lower({{0}})) THEN 0.5::DOUBLE ELSE 0::DOUBLE END) + (CASE WHEN len({KW.format('{0}')}) > 0 THEN 0.5::DOUBLE * len(list_intersect({KW.format('{0}')}, {KW.format('{1}')})) / len({KW.format('{0}')}) ELSE 0::DOUBLE END))"


@query("extract_keywords", f"SELECT id, array_to_string({KW.format('content')}, ' ') AS keywords FROM symbols WHERE content IS NOT NULL")
def extract_keywords(spark, sf):
    s = table(spark, sf, "symbols").where("content is not null")
    return s.select("id", F.array_join(text.extract_keywords(F.col("content")), " ").alias("keywords"))


@query("text_similarity", f"SELECT id, round({SIM.format("coalesce(name, '')", "coalesce(comments, '') || ' ' || coalesce(content, '')")}, 6) AS score FROM symbols")
def text_similarity(spark, sf):
    s = table(spark, sf, "symbols")
    whole = F.concat(F.coalesce("comments", F.lit("")), F.lit(" "), F.coalesce("content", F.lit("")))
    return s.select("id", F.round(text.text_similarity(F.col("name"), whole), 6).alias("score"))


@query("sanitize_query", "SELECT item_id, regexp_replace(translate(trim(text), '''\";', ''), ' {2,}', ' ', 'g') AS clean, length(trim(text)) BETWEEN 2 AND 200 AS valid FROM eval_items")
def sanitize_query(spark, sf):
    return table(spark, sf, "eval_items").select("item_id", text.sanitize_query(F.col("text")).alias("clean"), text.valid_query(F.col("text")).alias("valid"))


@query("query_hash", "SELECT item_id, md5(coalesce(text, '') || '|' || coalesce(suite, '') || '|' || coalesce(lang, '') || '|5|1.5') AS hash FROM eval_items")
def query_hash(spark, sf):
    return table(spark, sf, "eval_items").select("item_id", text.query_hash(F.col("text"), F.col("suite"), F.col("lang"), F.lit(5), F.lit(1.5)).alias("hash"))


@query("content_hash", "SELECT id, md5(content) AS hash FROM symbols")
def content_hash(spark, sf):
    return table(spark, sf, "symbols").select("id", text.content_hash(F.col("content")).alias("hash"))


@query(
    "distance_to_score",
    """
WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
d AS (SELECT vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], q) AS cosine, list_distance(embedding::DOUBLE[], q) AS l2 FROM embeddings, q)
SELECT vec_id, round(greatest(0, least(1, 1 - cosine / 2)), 6) AS cosine_score, round(greatest(0, least(1, exp(-l2))), 6) AS l2_score FROM d
""",
)
def distance_to_score(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    got = e.crossJoin(F.broadcast(q))  # one row
    return got.select("vec_id", F.round(text.distance_to_score(text.cosine_distance(F.col("embedding"), F.col("q"))), 6).alias("cosine_score"), F.round(text.distance_to_score(text.l2_distance(F.col("embedding"), F.col("q")), "l2"), 6).alias("l2_score"))


_IDENT = "(regexp_matches(trim({0}), '^[A-Z][a-zA-Z0-9]*$') OR regexp_matches(trim({0}), '^[a-z]+[A-Z][a-zA-Z0-9]*$') OR regexp_matches(trim({0}), '^[TIEF][A-Z][a-zA-Z0-9]*$') OR regexp_matches(trim({0}), '^[a-zA-Z_][a-zA-Z0-9]*_[a-zA-Z0-9_]*$')) AND length(trim({0})) <= 40"


@query("looks_like_identifier", f"SELECT id, coalesce({_IDENT.format('name')}, false) AS ident, (CASE WHEN {_IDENT.format('name')} THEN 'NAME: ' ELSE 'DESCRIPTION: ' END) || name AS query_text FROM symbols")
def looks_like_identifier(spark, sf):
    return table(spark, sf, "symbols").select("id", F.coalesce(text.looks_like_identifier(F.col("name")), F.lit(False)).alias("ident"), text.query_text(F.col("name")).alias("query_text"))


@query(
    "embedding_text",
    """
SELECT id, md5(array_to_string(list_filter([
  CASE WHEN coalesce(content, '') <> '' THEN 'CODE: ' || substr(content, 1, 8192) END, CASE WHEN coalesce(name, '') <> '' THEN 'NAME: ' || name END,
  CASE WHEN coalesce(full_name, '') <> coalesce(name, '') AND coalesce(full_name, '') <> '' THEN 'FULL_NAME: ' || full_name END, CASE WHEN coalesce(type, '') <> '' THEN 'TYPE: ' || type END,
  CASE WHEN coalesce(parent_class, '') <> '' THEN 'INHERITS: ' || parent_class END, CASE WHEN coalesce(implemented_interfaces, '') <> '' THEN 'IMPLEMENTS: ' || implemented_interfaces END,
  CASE WHEN coalesce(file_path, '') <> '' THEN 'FILE: ' || file_path END, CASE WHEN coalesce(comments, '') <> '' THEN 'DESCRIPTION: ' || comments END], lambda x: x IS NOT NULL), chr(10))) AS h FROM symbols
""",
)
def embedding_text(spark, sf):
    c = F.col
    return table(spark, sf, "symbols").select("id", F.md5(text.embedding_text(c("name"), c("full_name"), c("type"), c("parent_class"), c("implemented_interfaces"), c("file_path"), c("comments"), c("content")).cast("binary")).alias("h"))


@query("filter_clause", "SELECT id FROM symbols WHERE content_type = 'code' AND source_category = 'user' AND (framework = 'VCL' OR framework IS NULL) AND contains(coalesce(domain_tags, ''), 'a') AND lower(type) = 'class'")
def filter_clause(spark, sf):
    from codequarry.operators.search import Filters, filtered

    return filtered(table(spark, sf, "symbols"), Filters(content_type="code", source_category="user", framework="VCL", domain_tag="a", kind="class")).select("id")


@query("glob_match", r"SELECT id FROM symbols WHERE regexp_matches(replace(file_path, '\', '/'), '(?i)^.*/Common[^/]*/[^/]*Utils\.pas$')")
def glob_match(spark, sf):
    return table(spark, sf, "symbols").where(F.expr("true") & F.rlike(F.translate("file_path", "\\", "/"), text.glob_to_regex(F.lit("**/Common*/*Utils.pas")))).select("id")


@query("path_key", r"SELECT file_path, regexp_replace(lower(replace(file_path, '\', '/')), '(.)/+$', '\1') AS k, regexp_extract(lower(file_path), '(\.[a-z0-9]+)$', 1) AS ext FROM file_scan")
def path_key(spark, sf):
    return table(spark, sf, "file_scan").select("file_path", paths.path_key(F.col("file_path")).alias("k"), paths.extension(F.col("file_path")).alias("ext"))


@query("excluded_files", r"SELECT file_path FROM (SELECT DISTINCT file_path, lower(replace(file_path, '\', '/')) AS p FROM symbols) WHERE regexp_matches(p, '_(tlb|impl)\.pas$') OR len(list_intersect(string_split(p, '/'), ['.git', '.svn', '.hg', '__history', '__recovery', 'backup', 'win32', 'win64', 'debug', 'release', '__dcu_cache'])) > 0")
def excluded_files(spark, sf):
    from codequarry.sources.files import excluded

    return table(spark, sf, "symbols").select("file_path").distinct().where(excluded(F.col("file_path")))


@query("display_signature", "SELECT id, regexp_extract(content, '(?is)\\b((?:procedure|function|constructor|destructor)\\s+\\w+.*?[;:])', 1) AS sig FROM symbols WHERE content_type = 'code'")
def display_signature(spark, sf):
    return table(spark, sf, "symbols").where("content_type = 'code'").select("id", text.display_signature(F.col("content")).alias("sig"))


@query("clean_whitespace", r"""
SELECT id, md5(array_to_string(list_transform(string_split(regexp_replace(replace(content, chr(9), '  '), '\r\n?', chr(10), 'g'), chr(10)),
  lambda x: regexp_extract(x, '^( *)', 1) || rtrim(regexp_replace(ltrim(x, ' '), ' {2,}', ' ', 'g'), ' ')), chr(10))) AS h FROM symbols WHERE content IS NOT NULL
""")
def clean_whitespace(spark, sf):
    return table(spark, sf, "symbols").where("content is not null").select("id", F.md5(text.clean_whitespace(F.col("content")).cast("binary")).alias("h"))


@query("first_lines", """
SELECT id, CASE WHEN len(string_split(content, chr(10))) > 20 THEN array_to_string(string_split(content, chr(10))[1:20], chr(10)) || chr(10) || '... (' || (len(string_split(content, chr(10))) - 20) || ' more lines)' ELSE content END AS shown
FROM symbols WHERE content IS NOT NULL AND content_type = 'code'
""")
def first_lines(spark, sf):
    return table(spark, sf, "symbols").where("content is not null and content_type = 'code'").select("id", text.first_lines(F.col("content"), 20).alias("shown"))


_LSP = " ".join(f"WHEN '{k}' THEN {v}" for k, v in text.LSP_KINDS.items())


@query("lsp_symbols", rf"""
SELECT id, CASE lower(type) {_LSP} ELSE 13 END AS kind,
  CASE WHEN starts_with(replace(file_path, '\', '/'), '/') THEN 'file://' ELSE 'file:///' END || replace(replace(replace(replace(file_path, '\', '/'), '%', '%25'), ' ', '%20'), '#', '%23') AS uri,
  file_path AS back, greatest(coalesce(start_line, 1) - 1, 0) AS line FROM symbols
""")
def lsp_symbols(spark, sf):
    uri = text.path_to_uri(F.col("file_path"))
    back = F.when(F.contains("file_path", F.lit("\\")), F.translate(text.uri_to_path(uri), "/", "\\")).otherwise(text.uri_to_path(uri))
    return table(spark, sf, "symbols").select("id", text.lsp_kind(F.col("type")).alias("kind"), uri.alias("uri"), back.alias("back"), F.greatest(F.coalesce("start_line", F.lit(1)) - 1, F.lit(0)).alias("line"))


@query("format_lines", """
SELECT id, array_to_string(list_filter([CASE WHEN trim(visibility) <> '' THEN visibility END, type, coalesce(CASE WHEN trim(full_name) <> '' THEN full_name END, name)], lambda x: x IS NOT NULL), ' ')
  AS head, CASE source_category WHEN 'user' THEN 'User code' WHEN 'stdlib' THEN 'Standard library' WHEN 'third_party' THEN 'Third party' WHEN 'official_help' THEN 'Official help' WHEN 'project_docs' THEN 'Project docs' ELSE source_category END AS category,
  CASE WHEN coalesce(trim(parent_class), '') <> '' OR coalesce(trim(implemented_interfaces), '') <> '' THEN '(' || array_to_string(list_filter([CASE WHEN trim(parent_class) <> '' THEN parent_class END,
    regexp_replace(CASE WHEN trim(implemented_interfaces) <> '' THEN implemented_interfaces END, '\\s*,\\s*', ', ', 'g')], lambda x: x IS NOT NULL), ', ') || ')' ELSE '' END AS inherits FROM symbols
""")
def format_lines(spark, sf):
    c = F.col
    return table(spark, sf, "symbols").select("id", text.symbol_line(c("type"), c("full_name"), c("name"), c("visibility")).alias("head"), text.category_label(c("source_category")).alias("category"), text.inheritance_line(c("parent_class"), c("implemented_interfaces")).alias("inherits"))


@query("fit_vector", "SELECT vec_id, CAST(coalesce(len(embedding), -1) AS BIGINT) AS was, round(list_sum(list_transform(list_concat(embedding, list_transform(range(66), lambda i: 0::FLOAT))[1:64], lambda x: CASE WHEN isnan(x) THEN 0::DOUBLE ELSE x::DOUBLE END)), 4) AS total FROM vec_embeddings")
def fit_vector(spark, sf):
    v = text.fit_vector(F.col("embedding"), 64)
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.when(F.isnan(x), F.lit(0.0)).otherwise(x.cast("double")))
    return table(spark, sf, "vec_embeddings").select("vec_id", F.coalesce(F.when(F.col("embedding").isNotNull(), F.size("embedding")), F.lit(-1)).cast("long").alias("was"), F.round(total, 4).alias("total"))


@query("date_math", "SELECT event_id, ts < TIMESTAMP '2024-01-31' - INTERVAL 7 DAY AS old, CAST(floor(epoch(ts)) AS BIGINT) AS unix FROM events")
def date_math(spark, sf):
    return table(spark, sf, "events").select("event_id", (F.col("ts") < F.expr("timestamp_ntz'2024-01-31' - interval 7 days")).alias("old"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("unix"))

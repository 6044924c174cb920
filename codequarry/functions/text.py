"""Scalar functions of search and documents: Column in, Column out.

NULL in gives NULL out unless a docstring says otherwise. ``register`` offers the main ones
to SQL under their own names.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Query lengths accepted, and keyword length.
LEAST_QUERY, MOST_QUERY, LEAST_KEYWORD = 2, 200, 3
_KEYWORD = r"(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]*)"


def nullif_blank(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def sanitize_query(q: Column) -> Column:
    """Trimmed, without quotes and semicolons, runs of blanks collapsed."""
    return F.regexp_replace(F.translate(F.trim(q), "'\";", ""), " {2,}", " ")


def valid_query(q: Column) -> Column:
    """Whether a query has between 2 and 200 characters after trimming; NULL is not valid."""
    return F.coalesce(F.length(F.trim(q)).between(LEAST_QUERY, MOST_QUERY), F.lit(False))


def extract_keywords(text: Column) -> Column:
    """Sorted distinct lower-cased identifiers of more than two characters."""
    words = F.transform(F.regexp_extract_all(text, F.lit(_KEYWORD), F.lit(1)), F.lower)
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: F.length(w) >= LEAST_KEYWORD)))


def text_similarity(query: Column, text: Column) -> Column:
    """Half for containing the query, half for the share of its keywords that the text has; NULL counts as empty, an empty query gives 0."""
    q, t = F.coalesce(query, F.lit("")), F.coalesce(text, F.lit(""))
    k = extract_keywords(q)
    inside = F.when((q != "") & F.contains(F.lower(t), F.lower(q)), 0.5).otherwise(0.0)
    shared = F.when(F.size(k) > 0, 0.5 * F.size(F.array_intersect(k, extract_keywords(t))) / F.size(k)).otherwise(0.0)
    return inside + shared


def ordered_pattern(query: Column) -> Column:
    """The keywords in alphabetical order with anything between them, as a LIKE pattern; NULL without keywords."""
    k = extract_keywords(query)
    escaped = F.transform(k, lambda w: F.replace(w, F.lit("_"), F.lit("\\_")))
    return F.when(F.size(k) > 0, F.concat(F.lit("%"), F.array_join(escaped, "%"), F.lit("%")))


def query_hash(*parts: Column) -> Column:
    """MD5 over all parts that affect a result; NULL counts as empty."""
    return F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))


def content_hash(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in double; NULL if the lengths differ or a vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), 1 - dot(a, b) / norm)


def l2_distance(a: Column, b: Column) -> Column:
    d = F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") - q.cast("double")), F.lit(0.0), lambda s, v: s + v * v)
    return F.when(F.size(a) == F.size(b), F.sqrt(d))


def distance_to_score(d: Column, metric: str = "cosine") -> Column:
    """Cosine: 1 - d / 2; L2: exp(-d); held to [0, 1]."""
    raw = 1 - d / 2 if metric == "cosine" else F.exp(-d)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def fit_vector(v: Column, dim: int) -> Column:
    """Padded with zeros or cut to ``dim``; NULL gives zeros."""
    v = F.coalesce(v.cast("array<float>"), F.array().cast("array<float>"))
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), dim)), 1, dim)


def looks_like_identifier(q: Column) -> Column:
    """One word of up to 40 characters in Pascal, camel, prefixed or snake spelling."""
    t = F.trim(q)
    word = t.rlike(r"^[A-Z][a-zA-Z0-9]*$") | t.rlike(r"^[a-z]+[A-Z][a-zA-Z0-9]*$") | t.rlike(r"^[TIEF][A-Z][a-zA-Z0-9]*$") | t.rlike(r"^[a-zA-Z_][a-zA-Z0-9]*_[a-zA-Z0-9_]*$")
    return word & (F.length(t) <= 40) & ~F.contains(t, F.lit(" "))


def query_text(q: Column) -> Column:
    """The text that is embedded for a query."""
    return F.concat(F.when(looks_like_identifier(q), "NAME: ").otherwise("DESCRIPTION: "), q)


def embedding_text(name: Column, full_name: Column, kind: Column, parent: Column, interfaces: Column, path: Column, comments: Column, content: Column, most: int = 8192) -> Column:
    """The labelled lines that are embedded for a symbol; empty fields leave no line."""
    field = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label + ": "), c))
    own_full = F.when(F.coalesce(full_name, F.lit("")) != F.coalesce(name, F.lit("")), full_name)
    return F.concat_ws("\n", field("CODE", F.substring(content, 1, most)), field("NAME", name), field("FULL_NAME", own_full), field("TYPE", kind), field("INHERITS", parent), field("IMPLEMENTS", interfaces), field("FILE", path), field("DESCRIPTION", comments))


def glob_to_regex(pattern: Column) -> Column:
    """``**`` any text, ``*`` any text without a slash, ``?`` one character; anchored, case-insensitive."""
    p = F.regexp_replace(F.translate(pattern, "\\", "/"), r"([.+(){}\[\]^$|])", r"\\$1")
    p = F.replace(F.replace(F.replace(F.replace(p, F.lit("**"), F.lit("\x01")), F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]")), F.lit("\x01"), F.lit(".*"))
    return F.concat(F.lit("(?i)^"), p, F.lit("$"))


def display_signature(content: Column) -> Column:
    """The routine's heading up to the first colon or semicolon; '' if there is none."""
    return F.regexp_extract(content, r"(?is)\b((?:procedure|function|constructor|destructor)\s+\w+.*?[;:])", 1)


def clean_whitespace(text: Column) -> Column:
    """Tabs to two blanks, blanks within lines collapsed, indentation kept, line ends trimmed."""
    lines = F.split(F.regexp_replace(F.replace(text, F.lit("\t"), F.lit("  ")), "\r\n?", "\n"), "\n")
    return F.array_join(F.transform(lines, lambda x: F.concat(F.regexp_extract(x, "^( *)", 1), F.rtrim(F.regexp_replace(F.ltrim(x), " {2,}", " ")))), "\n")


def first_lines(text: Column, most: int) -> Column:
    """At most so many lines, with a note of how many more there are."""
    lines = F.split(text, "\n")
    more = F.concat(F.lit("\n... ("), (F.size(lines) - most).cast("string"), F.lit(" more lines)"))
    return F.when(F.size(lines) > most, F.concat(F.array_join(F.slice(lines, 1, most), "\n"), more)).otherwise(text)


# Symbol kinds of the editor protocol.
LSP_KINDS = {"class": 5, "interface": 11, "record": 23, "procedure": 12, "function": 12, "constructor": 9, "destructor": 6, "method": 6, "property": 7, "type": 5, "const": 14, "var": 13, "unit": 2}


def lsp_kind(kind: Column) -> Column:
    """Number of a symbol kind; unknown kinds are variables (13)."""
    table = F.create_map(*[F.lit(x) for kv in LSP_KINDS.items() for x in kv])
    return F.coalesce(table[F.lower(kind)], F.lit(13))


def path_to_uri(path: Column) -> Column:
    p = F.translate(path, "\\", "/")
    p = F.replace(F.replace(F.replace(p, F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20")), F.lit("#"), F.lit("%23"))
    return F.concat(F.when(F.startswith(p, F.lit("/")), "file://").otherwise("file:///"), p)


def uri_to_path(uri: Column) -> Column:
    p = F.url_decode(F.replace(F.regexp_replace(uri, "^file://", ""), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(p, "^/([A-Za-z]:)", "$1")


def position(line: Column, character: Column) -> Column:
    return F.struct(line.cast("int").alias("line"), character.cast("int").alias("character"))


def type_rank(kind: Column) -> Column:
    k = F.lower(kind)
    return F.when(k == "class", 1).when(k == "interface", 2).when(k == "function", 3).when(k == "procedure", 4).otherwise(5)


# Labels in formatted results.
CATEGORY_LABELS = {"user": "User code", "stdlib": "Standard library", "third_party": "Third party", "official_help": "Official help", "project_docs": "Project docs"}


def category_label(category: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CATEGORY_LABELS.items() for x in kv])
    return F.coalesce(table[category], category)


def symbol_line(kind: Column, full_name: Column, name: Column, visibility: Column) -> Column:
    return F.concat_ws(" ", nullif_blank(visibility), kind, F.coalesce(nullif_blank(full_name), name))


def inheritance_line(parent: Column, interfaces: Column) -> Column:
    """'(parent, interfaces)'; '' if there is neither."""
    both = F.concat_ws(", ", nullif_blank(parent), F.regexp_replace(nullif_blank(interfaces), r"\s*,\s*", ", "))
    return F.when(both != "", F.concat(F.lit("("), both, F.lit(")"))).otherwise("")


# Platforms and frameworks of documentation.
PLATFORMS = ["Windows", "Android", "iOS", "macOS", "Linux"]
DOC_FRAMEWORKS = ["none", "VCL", "FMX", "RTL", "both"]
DOC_TYPES = ["unknown", "unit", "class", "interface", "record", "procedure", "function", "property", "method", "event", "constant", "type", "language_ref", "conceptual", "example"]


def one_of(value: Column, names: list[str], default: str) -> Column:
    """The name that a value spells, ignoring case, else the default; NULL too."""
    table = F.create_map(*[F.lit(x) for n in names for x in (n.lower(), n)])
    return F.coalesce(table[F.lower(value)], F.lit(default))


def doc_framework_of(value: Column) -> Column:
    return one_of(value, DOC_FRAMEWORKS, "none")


def doc_type_of(value: Column) -> Column:
    return one_of(value, DOC_TYPES, "unknown")


def platform_set(csv: Column) -> Column:
    """The known platforms of a CSV, each once, in their fixed order; others are dropped, NULL gives none."""
    said = F.transform(F.split(F.coalesce(csv, F.lit("")), ","), lambda x: F.lower(F.trim(x)))
    return F.filter(F.array(*map(F.lit, PLATFORMS)), lambda p: F.array_contains(said, F.lower(p)))


def name_matches(name: Column, patterns: Column) -> Column:
    """Whether a name holds what any of the patterns asks for, ignoring case; ``*`` is anything, and patterns needn't cover the whole name."""
    rx = F.transform(patterns, lambda p: F.concat(F.lit("(?is)"), F.array_join(F.transform(F.split(p, r"\*"), lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))), ".*")))
    return F.coalesce(F.exists(rx, lambda r: F.rlike(name, r)), F.lit(False))


def service_url(url: Column, provider: Column, local_provider: str, port: int) -> Column:
    """The URL of an embedding service; that of the local provider gets its default port where it names none."""
    bare = F.regexp_replace(url, "/$", "")
    add = (F.lower(provider) == local_provider) & ~url.rlike(r"://[^/]+:\d+") & (url != "")
    return F.when(F.coalesce(add, F.lit(False)), F.concat(bare, F.lit(f":{port}"))).otherwise(url)


def chunk_json(number: Column, name: Column, full_name: Column, kind: Column, path: Column, parent: Column, visibility: Column, start: Column, end: Column) -> Column:
    """Metadata of a chunk as JSON; kinds that are none of the index's are 'unknown', NULL texts '' and NULL lines 0."""
    from codequarry.schema import SYMBOL_TYPES

    say = lambda c, n: F.coalesce(c, F.lit("")).alias(n)
    return F.to_json(F.struct(F.concat(F.lit("chunk_"), number.cast("string")).alias("chunk_id"), say(name, "name"), say(full_name, "full_name"), one_of(kind, SYMBOL_TYPES, "unknown").alias("type"), say(path, "file_path"), say(parent, "parent_class"), say(visibility, "visibility"), F.coalesce(start, F.lit(0)).alias("start_line"), F.coalesce(end, F.lit(0)).alias("end_line")))


def page_json(name: Column, short: Column, doc_type: Column, framework: Column, parent: Column, unit: Column, platforms: Column, inherited: Column, inherited_from: Column) -> Column:
    """Metadata of a documentation page as JSON; what is empty is left out."""
    return F.to_json(F.struct(name.alias("name"), short.alias("shortName"), doc_type_of(doc_type).alias("type"), doc_framework_of(framework).alias("framework"), nullif_blank(parent).alias("parentClass"), nullif_blank(unit).alias("unit"), F.nullif(F.array_join(platform_set(platforms), ","), F.lit("")).alias("platforms"), F.when(inherited, F.lit(True)).alias("inherited"), F.when(inherited, nullif_blank(inherited_from)).alias("inheritedFrom")))


def register(spark: SparkSession) -> None:
    """SQL functions ``text_similarity``, ``extract_keywords``, ``distance_to_score`` and ``sanitize_query``, as temporary SQL functions."""
    kw = "array_sort(array_distinct(filter(transform(regexp_extract_all({0}, r'(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]*)', 1), w -> lower(w)), w -> length(w) > 2)))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION extract_keywords(t STRING) RETURNS ARRAY<STRING> RETURN {kw.format('t')}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION text_similarity(q STRING, t STRING) RETURNS DOUBLE RETURN (CASE WHEN coalesce(q, '') <> '' AND contains(lower(coalesce(t, '')), lower(q)) THEN 0.5D ELSE 0D END) + (CASE WHEN size(extract_keywords(coalesce(q, ''))) > 0 THEN 0.5D * size(array_intersect(extract_keywords(coalesce(q, '')), extract_keywords(coalesce(t, '')))) / size(extract_keywords(coalesce(q, ''))) ELSE 0D END)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION distance_to_score(d DOUBLE) RETURNS DOUBLE RETURN greatest(0D, least(1D, 1D - d / 2))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION sanitize_query(q STRING) RETURNS STRING RETURN regexp_replace(translate(trim(q), '\\'\";', ''), ' {2,}', ' ')")

"""Help pages, framework intelligence and glossary."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.operators import documents as d
from codequarry.operators import intel as i
from codequarry.query_sets.tracking import _KEY
from codequarry.registry import query
from codequarry.session import table

_PAGES = "p AS (SELECT id, content AS html, file_path FROM symbols WHERE lower(file_path) LIKE '%.htm' AND trim(content) <> '')"
_SUFFIX = "regexp_replace(regexp_replace(trim(regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1)), '(?i) - RAD Studio API Documentation', '', 'g'), '(?i) - RAD Studio', '', 'g')"
_TITLE = rf"coalesce(nullif({_SUFFIX}, ''), nullif(trim(regexp_extract(html, '(?i)<h1[^>]*>([^<]+)</h1>', 1)), ''), regexp_replace(list_last(string_split(replace(file_path, '\', '/'), '/')), '\.[^.]*$', ''))"
_STRIP = "regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g')"
_AREA, _BODY = '(?is)<div[^>]*class="[^"]*content[^"]*"[^>]*>(.*?)</div>', "(?is)<body[^>]*>(.*?)</body>"
_TEXT = f"CASE WHEN regexp_matches({_STRIP}, '{_AREA}') THEN regexp_extract({_STRIP}, '{_AREA}', 1) WHEN regexp_matches({_STRIP}, '{_BODY}') THEN regexp_extract({_STRIP}, '{_BODY}', 1) ELSE {_STRIP} END"
_TEXT = f"regexp_replace({_TEXT}, '(?s)<[^>]+>', ' ', 'g')"
for _e, _t in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"')):
    _TEXT = f"regexp_replace({_TEXT}, '(?i){_e}', '{_t}', 'g')"
_TEXT = f"trim(regexp_replace({_TEXT}, '[ \\t\\r\\n\\f]+', ' ', 'g'))"
_TYPE = "CASE WHEN contains(lower(title), ' property') THEN 'property' WHEN contains(lower(title), ' method') OR contains(lower(title), ' procedure') OR contains(lower(title), ' function') THEN 'method' WHEN contains(lower(title), ' class') THEN 'class' WHEN contains(lower(title), ' event') THEN 'event' WHEN contains(lower(title), 'example') THEN 'example' ELSE 'conceptual' END"


def help_rows(spark, sf):
    return table(spark, sf, "symbols").where("lower(file_path) like '%.htm'").select("id", F.col("content").alias("html"), "file_path")


@query("html_title", f"WITH {_PAGES} SELECT id, {_TITLE} AS title FROM p")
def html_title(spark, sf):
    return d.pages(help_rows(spark, sf), "html", "file_path").select("id", "title")


@query("html_text", f"WITH {_PAGES} SELECT id, md5({_TEXT}) AS h, length({_TEXT}) AS n FROM p")
def html_text(spark, sf):
    return d.pages(help_rows(spark, sf), "html", "file_path").select("id", F.md5(F.col("text").cast("binary")).alias("h"), F.length("text").cast("long").alias("n"))


@query(
    "doc_type",
    f"""WITH {_PAGES}, t AS (SELECT id, {_TITLE} AS title FROM p), k AS (SELECT *, {_TYPE} AS doc_type FROM t)
SELECT id, doc_type, CASE WHEN starts_with(lower(title), 'vcl.') THEN 'VCL' WHEN starts_with(lower(title), 'fmx.') THEN 'FMX' WHEN starts_with(lower(title), 'system.') THEN 'RTL' WHEN doc_type = 'class' THEN 'RTL' ELSE 'none' END AS framework,
 CASE WHEN contains(title, '.') THEN split_part(title, '.', 1) ELSE '' END AS unit_name, split_part(title, '.', -1) AS short_name, translate(lower(title), '. ', '__') || '_' || doc_type AS chunk_id FROM k""",
)
def doc_type(spark, sf):
    p = d.pages(help_rows(spark, sf), "html", "file_path")
    return p.select("id", "doc_type", "framework", "unit_name", "short_name", d.chunk_id(F.col("title"), F.col("doc_type")).alias("chunk_id"))


@query(
    "doc_sections",
    """
WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, length(line) > 0 AND length(line) < 100 AND (regexp_matches(line, '^[0-9]') OR upper(line) = line) AS head FROM l),
s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY pos) - first_value(head::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM h)
SELECT doc_id, CAST(section AS INTEGER) AS section, md5(string_agg(line, chr(10) ORDER BY pos)) AS h FROM s GROUP BY 1, 2
""",
)
def doc_sections(spark, sf):
    s = d.sections(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")
    return s.select("doc_id", "section", F.md5(F.col("content").cast("binary")).alias("h"))


@query("doc_chunks", f"WITH {_PAGES}, t AS (SELECT id, {_TITLE} AS title, {_TEXT} AS txt FROM p) SELECT id, 0 AS chunk, translate(lower(title), '. ', '__') || '_' || {_TYPE} || CASE WHEN {_TYPE} = 'conceptual' AND length(txt) > 5000 THEN '_0' ELSE '' END AS chunk_id, md5(txt) AS h FROM t")
def doc_chunks(spark, sf):
    p = d.pages(help_rows(spark, sf), "html", "file_path")
    return d.chunks(p, "id").select("id", "chunk", "chunk_id", F.md5(F.col("content").cast("binary")).alias("h"))


# ---------------------------------------------------------------- frameworks

OVERRIDES = [(0, "C:/Work/Dolpexkes/Common2/ucStockJournalUtils.pas", None, "RTL"), (1, None, "**/Common*/*.pas", "VCL"), (2, None, "**/Net*/**", "FMX"), (3, None, "**/*Utils.pas", "RTL")]
_OV = "ov AS (SELECT * FROM (VALUES " + ", ".join(f"({o}, {repr(f) if f else 'NULL'}, {repr(g) if g else 'NULL'}, '{w}')" for o, f, g, w in OVERRIDES) + ") v(ordinal, file, pattern, framework))"
_GLOB = r"'(?i)^' || replace(replace(replace(replace(regexp_replace(lower(pattern), '([.+(){}\[\]^$|])', '\\\1', 'g'), '**', chr(1)), '*', '[^/]*'), '?', '[^/]'), chr(1), '.*') || '$'"


def overrides(spark):
    return spark.createDataFrame(OVERRIDES, "ordinal int, file string, pattern string, framework string")


_MAPPED = f"""{_OV}, fl AS (SELECT DISTINCT file_path, {_KEY.format('file_path')} AS k FROM symbols WHERE file_path IS NOT NULL),
mp AS (SELECT file_path, framework, ordinal, row_number() OVER (PARTITION BY file_path ORDER BY ordinal) AS n FROM fl JOIN ov ON lower(replace(file, '\\', '/')) = k OR regexp_matches(k, {_GLOB}))"""


@query("mapping_first_match", f"WITH {_MAPPED} SELECT file_path, framework, ordinal FROM mp WHERE n = 1")
def mapping_first_match(spark, sf):
    return i.mapped(table(spark, sf, "symbols").where("file_path is not null"), overrides(spark)).select("file_path", F.col("mapped").alias("framework"), "ordinal")


_USES = r"list_filter(list_transform(flatten(list_transform(regexp_extract_all(regexp_replace(content, '(?s)\{[^}]*\}|\(\*.*?\*\)|//[^\n]*', ' ', 'g'), '(?is)\buses\s+([^;]*);', 1), lambda c: string_split(c, ','))), lambda n: lower(trim(regexp_replace(regexp_replace(trim(n, chr(10) || chr(13) || chr(9) || ' '), '(?is)\s+in\s+''.*$', ''), '\s+', ' ', 'g')))), lambda n: n <> '')"


@query("uses_units", f"SELECT id, array_to_string({_USES}, ',') AS units FROM symbols WHERE type = 'unit' AND content IS NOT NULL")
def uses_units(spark, sf):
    return table(spark, sf, "symbols").where("type = 'unit' and content is not null").select("id", F.array_join(i.uses_units(F.col("content")), ",").alias("units"))


_FW = "CASE WHEN len(list_filter({u}, lambda x: starts_with(x, 'vcl.') OR starts_with(x, 'fmx.') OR x IN ('forms', 'controls', 'dialogs', 'stdctrls', 'extctrls', 'comctrls'))) > 0 THEN CASE WHEN starts_with(list_filter({u}, lambda x: starts_with(x, 'vcl.') OR starts_with(x, 'fmx.') OR x IN ('forms', 'controls', 'dialogs', 'stdctrls', 'extctrls', 'comctrls'))[1], 'fmx.') THEN 'FMX' ELSE 'VCL' END WHEN len({u}) > 0 THEN 'RTL' END"


@query(
    "framework_coalesce",
    rf"""
WITH {_MAPPED}, un AS (SELECT file_path, content, row_number() OVER (PARTITION BY file_path ORDER BY length(content) DESC NULLS LAST, content DESC) AS n FROM symbols WHERE type = 'unit' AND file_path IS NOT NULL),
t AS (SELECT file_path, nullif(upper(regexp_extract(array_to_string(string_split(content, chr(10))[1:10], chr(10)), '(?i)//\s*FRAMEWORK:\s*(VCL|FMX|RTL)\b', 1)), '') AS t1, {_USES} AS u FROM un WHERE n = 1),
pk AS (SELECT {_KEY.format('file_path')} AS k, max(framework) AS f FROM symbols WHERE framework IS NOT NULL AND file_path IS NOT NULL GROUP BY 1),
j AS (SELECT t.file_path, t1, mp.framework AS t2, pk.f AS t3, {_FW.format(u='u')} AS t4 FROM t LEFT JOIN mp ON t.file_path = mp.file_path AND mp.n = 1 LEFT JOIN pk ON pk.k = {_KEY.format('t.file_path')})
SELECT file_path, coalesce(t1, t2, t3, t4, '') AS framework, CASE WHEN t1 IS NOT NULL THEN 'tag' WHEN t2 IS NOT NULL THEN 'mapping' WHEN t3 IS NOT NULL THEN 'package' WHEN t4 IS NOT NULL THEN 'uses' ELSE 'unknown' END AS tier,
  CASE WHEN t1 = 'RTL' AND t4 IN ('VCL', 'FMX') THEN 'comment_vs_uses' WHEN t1 IS NULL AND t2 <> t3 THEN 'mapping_vs_package' WHEN t1 IS NULL AND t2 IS NULL AND t3 = 'RTL' AND t4 IN ('VCL', 'FMX') THEN 'file_vs_package'
    WHEN t1 IS NULL AND t2 IS NULL AND t3 IS NULL AND t4 IS NOT NULL THEN 'orphaned_file' WHEN t1 IS NULL AND t2 IS NULL AND t3 IS NULL AND t4 IS NULL THEN 'unknown_framework' END AS warning FROM j
""",
)
def framework_coalesce(spark, sf):
    from codequarry.functions.paths import path_key

    s = table(spark, sf, "symbols").where("file_path is not null")
    pk = s.where("framework is not null").groupBy(path_key(F.col("file_path")).alias("file_key")).agg(F.max("framework").alias("package_framework"))
    return i.detect(s.where("type = 'unit'").select("file_path", "content"), overrides(spark), pk)


_EDGES = f"e AS (SELECT DISTINCT lower(name) AS src, unnest({_USES}) AS dst FROM symbols WHERE type = 'unit' AND content IS NOT NULL AND name IS NOT NULL)"


def _edges(spark, sf):
    return i.dependency_pairs(table(spark, sf, "symbols").where("type = 'unit' and content is not null and name is not null"))


@query("unit_closure", f"WITH RECURSIVE {_EDGES}, r AS (SELECT src AS root, dst FROM e UNION SELECT r.root, e.dst FROM r JOIN e ON r.dst = e.src) SELECT root, dst AS unit FROM r WHERE root <> dst")
def unit_closure(spark, sf):
    """All units that each unit needs."""
    return i.reach(_edges(spark, sf)).where("src <> dst").select(F.col("src").alias("root"), F.col("dst").alias("unit"))


@query("unit_circles", f"WITH RECURSIVE {_EDGES}, r AS (SELECT src AS root, dst FROM e UNION SELECT r.root, e.dst FROM r JOIN e ON r.dst = e.src) SELECT root AS unit FROM r WHERE root = dst")
def unit_circles(spark, sf):
    """Units that need themselves in the end."""
    return i.circles(_edges(spark, sf)).select(F.col("src").alias("unit"))


PACKAGES = [("app", 0, "vcl"), ("app", 1, "core"), ("core", 0, "rtl"), ("core", 1, "dbrtl"), ("ui", 0, "core"), ("ui", 1, "fmxbase"), ("mixed", 0, "ui"), ("mixed", 1, "app"), ("odd", 0, "unknownlib"), ("tagged", 0, "unknownlib"), ("tagged", 1, "rtl"), ("a", 0, "b"), ("b", 0, "a"), ("c", 0, "a"), ("c", 1, "app"), ("none", 0, "")]


@query("package_frameworks", "SELECT * FROM (VALUES ('app', 'VCL'), ('core', 'RTL'), ('ui', 'FMX'), ('mixed', 'FMX'), ('odd', ''), ('tagged', 'RTL'), ('a', ''), ('b', ''), ('c', 'VCL'), ('none', '')) t(package, framework)")
def package_frameworks(spark, sf):
    r = spark.createDataFrame(PACKAGES, "package string, ordinal int, requires string")
    return i.package_frameworks(r, spark.createDataFrame([("tagged", "RTL")], "package string, tag string"))


@query("unit_frameworks")
def unit_frameworks(spark, sf):
    """Frameworks of all units as if each were a package that requires the units it uses, in their order."""
    u = table(spark, sf, "symbols").where("type = 'unit' and content is not null and name is not null").groupBy(F.lower("name").alias("package")).agg(F.max(F.struct(F.length("content"), "content")).alias("u"))
    r = u.select("package", F.posexplode_outer(i.uses_units(F.col("u.content"))).alias("ordinal", "requires")).withColumn("ordinal", F.coalesce("ordinal", F.lit(0)))
    return i.package_frameworks(r)


@query(
    "mapped_files",
    f"WITH {_MAPPED} SELECT file_path, coalesce(bool_or(mp.framework IS NOT NULL), false) AS is_mapped FROM fl LEFT JOIN mp USING (file_path) GROUP BY 1",
)
def mapped_files(spark, sf):
    return i.in_overrides(table(spark, sf, "symbols").where("file_path is not null"), overrides(spark))


# ---------------------------------------------------------------- glossary

#: A dozen invented rows; the real glossary is a table that users bring.
GLOSSARY = [("factura", ["invoice"], ["billing"]), ("pedido", ["order"], ["sales"]), ("almacén", ["warehouse"], ["stock"]), ("envío", ["shipment"], ["stock", "sales"]), ("cliente", ["customer"], ["sales"]), ("cobro", ["collection"], ["billing"]), ("pantalla", ["screen"], ["ui"]), ("cierre de mes", ["month end"], ["accounting"]), ("informe", ["report"], ["ui", "accounting"]), ("hilo", ["thread"], ["system"]), ("licencia", ["licence"], ["system"]), ("turno", ["shift"], ["staff"])]
_GL = "gl AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', {tags!r})" for t, _, tags in GLOSSARY) + ") v(term, tags))"
_HIT = f"{_GL}, hit AS (SELECT doc_id, term, tags FROM documents JOIN gl ON regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_])' || term || CASE WHEN contains(term, ' ') THEN '' ELSE '' END))"


@query(
    "glossary_tags",
    f"WITH {_HIT}, f AS (SELECT doc_id, term, unnest(tags) AS tag FROM hit) SELECT d.doc_id, coalesce(CAST(to_json(list_sort(list_distinct(list(f.term) FILTER (f.term IS NOT NULL)))) AS VARCHAR), '[]') AS spanish_terms, coalesce(array_to_string(list_sort(list_distinct(list(f.tag) FILTER (f.tag IS NOT NULL))), ','), '') AS domain_tags, count(DISTINCT f.term) AS n_terms FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id GROUP BY 1",
)
def glossary_tags(spark, sf):
    g = spark.createDataFrame(GLOSSARY, "term string, english array<string>, tags array<string>")
    return i.enrich(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", g)


@query("abbreviations", "SELECT id, CASE lower(type) WHEN 'proc' THEN 'procedure' WHEN 'func' THEN 'function' ELSE type END AS long FROM (SELECT id, CASE type WHEN 'procedure' THEN 'proc' WHEN 'function' THEN 'func' ELSE type END AS type FROM symbols)")
def abbreviations(spark, sf):
    short = F.when(F.col("type") == "procedure", "proc").when(F.col("type") == "function", "func").otherwise(F.col("type"))
    names = F.create_map(F.lit("proc"), F.lit("procedure"), F.lit("func"), F.lit("function"))
    return table(spark, sf, "symbols").select("id", F.coalesce(names[F.lower(short)], short).alias("long"))

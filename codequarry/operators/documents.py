"""Help pages: title, text, kind, framework and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Suffixes of page titles that say nothing of the page.
TITLE_SUFFIXES = [" - RAD Studio API Documentation", " - RAD Studio"]
LONG_PAGE = 5000


def html_title(html: Column, path: Column) -> Column:
    """Text of ``<title>`` without known suffixes, else of ``<h1>``, else the file's name without its ending."""
    title = F.trim(F.regexp_extract(html, r"(?i)<title[^>]*>([^<]+)</title>", 1))
    for s in TITLE_SUFFIXES:
        title = F.regexp_replace(title, "(?i)" + s.replace(".", r"\."), "")
    h1 = F.trim(F.regexp_extract(html, r"(?i)<h1[^>]*>([^<]+)</h1>", 1))
    stem = F.regexp_replace(F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1), r"\.[^.]*$", "")
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(h1, F.lit("")), stem)


def html_text(html: Column) -> Column:
    """The text of the content area, else of the body, else of all: scripts and styles dropped, tags to blanks, five entities decoded, white space collapsed."""
    t = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", "")
    t = F.regexp_replace(t, r"(?is)<style[^>]*>.*?</style>", "")
    area, body = r'(?is)<div[^>]*class="[^"]*content[^"]*"[^>]*>(.*?)</div>', r"(?is)<body[^>]*>(.*?)</body>"
    t = F.when(t.rlike(area), F.regexp_extract(t, area, 1)).when(t.rlike(body), F.regexp_extract(t, body, 1)).otherwise(t)
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    for entity, to in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"')):
        t = F.regexp_replace(t, "(?i)" + entity, to)
    return F.trim(F.regexp_replace(t, r"[ \t\r\n\f]+", " "))


def doc_type(title: Column) -> Column:
    has = lambda w: F.contains(F.lower(title), F.lit(w))
    return F.when(has(" property"), "property").when(has(" method") | has(" procedure") | has(" function"), "method").when(has(" class"), "class").when(has(" event"), "event").when(has("example"), "example").otherwise("conceptual")


def doc_framework(title: Column, kind: Column) -> Column:
    """By the title's prefix; class pages without one count as RTL."""
    t = F.lower(title)
    return F.when(F.startswith(t, F.lit("vcl.")), "VCL").when(F.startswith(t, F.lit("fmx.")), "FMX").when(F.startswith(t, F.lit("system.")), "RTL").when(kind == "class", "RTL").otherwise("none")


def unit_name(title: Column) -> Column:
    return F.when(F.contains(title, F.lit(".")), F.substring_index(title, ".", 1)).otherwise("")


def short_name(title: Column) -> Column:
    return F.substring_index(title, ".", -1)


def chunk_id(name: Column, kind: Column) -> Column:
    return F.concat(F.translate(F.lower(name), ". ", "__"), F.lit("_"), kind)


def is_heading(line: Column) -> Column:
    """A non-empty line of less than 100 characters that opens with a digit or has no lower-case letter."""
    return (F.length(line) > 0) & (F.length(line) < 100) & (line.rlike("^[0-9]") | (F.upper(line) == line))


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, content): texts split before each heading line; sections are numbered from 0.

    The split is made inside each row, so a text never meets another. NULL gives no rows.
    """
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, line: Column) -> Column:
        cut = is_heading(line) & acc["open"].isNotNull()
        done = F.when(cut, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        opened = F.when(acc["open"].isNull() | cut, line).otherwise(F.concat(acc["open"], F.lit("\n"), line))
        return F.struct(done.alias("done"), opened.alias("open"))

    all_ = F.aggregate(lines, start, step, lambda a: F.concat(a["done"], F.when(a["open"].isNotNull(), F.array(a["open"])).otherwise(F.array().cast("array<string>"))))
    return docs.where(F.col(text).isNotNull()).select(key, F.posexplode(all_).alias("section", "content"))


def pages(docs: DataFrame, html_col: str, path_col: str) -> DataFrame:
    """Adds title, text, doc_type, framework, unit_name, short_name; empty pages are dropped."""
    d = docs.where(F.coalesce(F.trim(html_col), F.lit("")) != "").withColumn("title", html_title(F.col(html_col), F.col(path_col)))
    d = d.withColumn("text", html_text(F.col(html_col))).withColumn("doc_type", doc_type(F.col("title")))
    return d.withColumn("framework", doc_framework(F.col("title"), F.col("doc_type"))).withColumn("unit_name", unit_name(F.col("title"))).withColumn("short_name", short_name(F.col("title")))


def chunks(pages_: DataFrame, key: str) -> DataFrame:
    """(key, chunk, chunk_id, doc_type, content): one chunk a page; long conceptual pages by their headings."""
    cid = chunk_id(F.col("title"), F.col("doc_type"))
    long = (F.col("doc_type") == "conceptual") & (F.length("text") > LONG_PAGE)
    one = pages_.where(~long).select(key, F.lit(0).alias("chunk"), cid.alias("chunk_id"), "doc_type", F.col("text").alias("content"))
    cut = sections(pages_.where(long).select(key, "text"), key, "text")
    many = pages_.where(long).select(key, cid.alias("c"), "doc_type").join(cut, key).select(key, F.col("section").alias("chunk"), F.concat("c", F.lit("_"), F.col("section").cast("string")).alias("chunk_id"), "doc_type", "content")
    return one.unionByName(many)


def running_sections(lines: DataFrame, key: str, pos: str, line: str) -> DataFrame:
    """The same numbering for texts that are already one row per line, by a running sum."""
    w = Window.partitionBy(key).orderBy(pos)
    n = F.sum(is_heading(F.col(line)).cast("int")).over(w)
    first = F.first(is_heading(F.col(line)).cast("int")).over(w)
    return lines.withColumn("section", n - first)

"""Source files that nobody on the team wrote by hand.

Three kinds of evidence. Third-party code: its tree or folder, its header, or exact
containment of its lines in a known third-party file, by an inverted index of line hashes
over all trees, so that carried-in and edited copies are found without their headers.
Generated code: what its header says, or rows that are one template over and over.
Minified code and data blobs: token composition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions.paths import path_key
from codequarry.session import cut

# Words with which folders of foreign code, licence heads and generators' heads are marked.
FOREIGN_FOLDERS = ["vendor", "vendors", "vendored", "thirdparty", "third_party", "third-party", "3rd", "3rdparty", "3rd_party", "3rd-party", "contrib", "upstream", "foreign", "bought", "ext", "extern", "externals", "node_modules", "bower_components", "deps"]
FOREIGN_HEAD = re.compile(
    r"licen[sc]ed under|licen[sc]e (?:file|terms)|see licen[sc]e|lizenz siehe|lizenziert unter|bajo (?:la )?licencia|sous (?:la )?licence|the original code is|(?:from|to) upstream|upstream changes|redistributed with permission|(?:stammt|übernommen) (?:aus|von)|copyright \(c\) \d{4}[-\d, ]* (?:by )?the [\w.+-]+ (?:authors|project|contributors)|\b(?:[LA]?GPL|MPL)\b|\b(?:apache|mit|bsd) licen[sc]e"
    # a label only where it opens a line: 'without a licence: ...' is a sentence of the team's own
    r"|^[^\w\n]*(?:spdx-licen[sc]e-identifier|licen[sc]e|lizenz|licencia)[ \t]*:",
    re.I | re.M,
)
GENERATED_HEAD = re.compile(
    r"<auto-?generated|@generated\b|\bauto-?generated\b|(?:file|unit|code|module) (?:was|is|has been) (?:automatically |auto-?)?generated|(?:do not|don't) (?:edit|modify|change)|instead of editing|machine[- ](?:made|generated)|written by the importer|type library import|manual changes will be lost|automatisch (?:erzeugt|generiert|erstellt)|nicht (?:ae|ä)ndern|nicht bearbeiten|(?:generado|creado) autom|no (?:modificar|editar|tocar)|(?:produit|généré|créé) (?:par un outil|automatiquement|par)|ne pas (?:modifier|éditer|toucher)"
    # only where it opens a line or sentence, or is said of something before it: 'prints numbers generated by ...' is none
    r"|(?:^[^\w\n]*|[.;:][ \t]+|\b(?:is|was|been|automatically)[ \t]+)generated (?:by|from|with|automatically|using)\b",
    re.I | re.M,
)
GENERATED_NAME = r"_(tlb|impl)\.(pas|inc)$"

LEAST_LINE = 12  #: Shorter lines, without white space, tell nothing.
LEAST_LINES = 3  #: Files with fewer lines in the index are not judged by containment.
CONTAINED = 0.5  #: Share of a file's lines in one third-party file.
TREE_SHARE, TREE_FILES = 0.6, 8  #: A tree is of a category if this share of at least so many files has it.

HEAD = re.compile(r"\s*(?:\{(?!\$)[^}]*\}|\(\*.*?\*\)|//[^\n]*|/\*.*?\*/|\s+)*", re.S)
#: What stands before a routine's parameters, and a name with a number in it.
HEADING = re.compile(r"[^(;:=\r\n]*")
SERIAL = re.compile(r"[A-Za-z_][A-Za-z_.]*?(?=\d)\d+[A-Za-z_]*")
IDENT = re.compile(r"[A-Za-z_]\w*")
BLOB = re.compile(r"[A-Za-z0-9+/=]{40,}|(?:[$#]?(?:0x)?[0-9A-Fa-f]{1,8}[ \t]*,[ \t\r\n]*){8,}|'[^'\n]{160,}'|(?:#\d{1,3}){12,}")
STRING = re.compile(r"'[^'\n]*'?")
NUMBER = re.compile(r"\$[0-9A-Fa-f]+|(?<!\w)\d[\w.]*")
KEYWORDS = frozenset("and array as asm begin case class const constructor destructor div do downto else end except exit file finally for function goto if implementation in inherited inc dec integer interface is label library mod nil not object of on or out overload packed private procedure program property protected public published raise read record repeat result set shl shr string then threadvar to try type unit until uses var virtual while with write xor boolean double word byte var let new return this typeof true false null char override".split())
SHORT_WORDS = frozenset("do if in is of on or to as".split())
TEMPLATE_ROWS, TEMPLATE_SHARE = 8, 0.35
SERIAL_ROWS, SERIAL_SHARE = 3, 0.6
BLOB_CHARS, BLOB_SHARE = 300, 0.6
SHORT_IDENTS, SHORT_SHARE, SPACE_SHARE = 60, 0.75, 0.2


def h64(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s) - (1 << 63)


def look(kind: str, content: str, comments: str) -> tuple:
    """What a row tells: heads, composition, template, and the hashes of its lines."""
    head = HEAD.match(content).group() if content[:1] in "{(/ \t\r\n" else ""
    top = comments + "\n" + head if comments or head else ""
    generated = bool(top) and GENERATED_HEAD.search(top) is not None
    foreign = (kind == "unit" or head != "" and content[len(head) : len(head) + 5].lower() == "unit ") and bool(top) and FOREIGN_HEAD.search(top) is not None
    lines = []
    for line in content.split("\n"):
        s = "".join(line.split())
        if len(s) >= LEAST_LINE:
            lines.append(h64(s.lower()))
    chars = len(content)
    blob = sum(len(m) for m in BLOB.findall(content)) if chars > 200 else 0
    idents = short = 0
    spaces = content.count(" ") + content.count("\n") + content.count("\t") + content.count("\r")
    if chars > 120 and blob < chars / 2 and spaces < chars * SPACE_SHARE:
        names = IDENT.findall(STRING.sub("", content))
        own = [n for n in names if len(n) > 2 and n.lower() not in KEYWORDS]
        few = [n for n in names if len(n) <= 2 and n not in SHORT_WORDS]
        idents, short = len(own) + len(few), len(few)
    template, stem = 0, None
    if kind != "unit":
        t = NUMBER.sub("9", STRING.sub("S", content))
        t = IDENT.sub(lambda m: m.group().lower() if m.group().lower() in KEYWORDS else "x", t)
        template = h64(t)
        m = SERIAL.search(content, len(head), HEADING.match(content, len(head)).end())
        if m:
            stem = h64(re.sub(r"\d+", "9", m.group()))
    return generated, foreign, chars, blob, idents, short, spaces, template, stem, lines


FIELDS = "file_path string, category string, is_unit boolean, row_hash long, generated boolean, foreign boolean, chars long, blob long, idents long, short long, spaces long, template long, stem long, lines array<long>"


def _rows(symbols: DataFrame) -> DataFrame:
    code = symbols.where(F.lower(F.col("file_path")).rlike(r"\.(pas|inc|js)$")).select("file_path", "type", "content", "comments", "source_category")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.bool_(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        names = ["is_unit", "row_hash", "generated", "foreign", "chars", "blob", "idents", "short", "spaces", "template", "stem", "lines"]
        for b in batches:
            out = [[] for _ in names]
            for kind, content, comments in zip(*(b.column(c).to_pylist() for c in ("type", "content", "comments"))):
                kind, content, comments = (kind or "").lower(), content or "", comments or ""
                for x, v in zip(out, (kind == "unit", h64(f"{kind}\0{content}\0{comments}"), *look(kind, content, comments))):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([b.column("file_path"), b.column("source_category"), *(pa.array(x, t) for x, t in zip(out, kinds))], ["file_path", "category", *names])

    return code.mapInArrow(run, FIELDS)


def tree_categories(files: DataFrame, folders: DataFrame) -> DataFrame:
    """(key, tree_category): the category that most files and folders in a tree carry, for files in third-party or stdlib trees.

    Votes are counted for every folder above a file; the deepest clear one decides.
    """
    votes = files.select(F.col("key"), "category").unionByName(folders.where(F.col("folder_path").isNotNull()).select(F.concat(path_key(F.col("folder_path")), F.lit("/.")).alias("key"), F.col("source_category").alias("category")).distinct())
    up = lambda d: d.withColumn("parts", F.split("key", "/")).withColumn("n", F.explode(F.sequence(F.lit(2), F.greatest(F.size("parts") - 1, F.lit(2)))))
    above = lambda d: up(d).where(F.col("n") < F.size("parts")).withColumn("root", F.array_join(F.slice("parts", 1, F.col("n")), "/"))
    third, std = (F.avg((F.col("category") == c).cast("double")) for c in ("third_party", "stdlib"))
    roots = above(votes).groupBy("root").agg(F.count("*").alias("files"), third.alias("third"), std.alias("std")).where((F.col("files") >= TREE_FILES) & ((F.col("third") >= TREE_SHARE) | (F.col("std") >= TREE_SHARE)))
    roots = roots.select("root", F.when(F.col("third") >= TREE_SHARE, "third_party").otherwise("stdlib").alias("of"))
    return above(files.select("key")).join(roots, "root").groupBy("key").agg(F.max(F.struct("n", "of")).alias("m")).select("key", F.col("m.of").alias("tree_category"))


def foreign_folder(key: Column) -> Column:
    parts = F.slice(F.split(key, "/"), F.lit(1), F.greatest(F.size(F.split(key, "/")) - 1, F.lit(0)))
    return F.arrays_overlap(parts, F.array(*map(F.lit, FOREIGN_FOLDERS)))


def _line_sets(once: DataFrame, fids: DataFrame) -> DataFrame:
    """(fid, lines) with the sorted distinct lines of a file."""
    return once.join(fids, "fid", "left_semi").groupBy("fid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"))


def containment(once: DataFrame, files: DataFrame) -> DataFrame:
    """(fid, owner) of files of which at least ``CONTAINED`` of the distinct lines stand in one third-party file, exactly.

    Third-party files with the same lines are one owner, the lowest of them. Of n lines ``need``
    must be shared, so one of the n - need + 1 rarest is shared with any owner that counts: only
    those are looked up, which leaves out lines that stand everywhere. All owners found that way
    are compared; the largest share decides, then the lowest owner.
    """
    owners = cut(_line_sets(once, files.where("known").select("fid")).groupBy("lines").agg(F.min("fid").alias("owner")).select("owner", F.col("lines").alias("theirs")))
    index = owners.select("owner", F.explode("theirs").alias("line"))
    open_files = files.where(~F.col("known") & ~F.col("std") & (F.col("n_lines") >= LEAST_LINES))
    mine = cut(_line_sets(once, open_files.select("fid")).withColumn("need", F.ceil(F.size("lines") * F.lit(CONTAINED)).cast("int")))
    counts = index.groupBy("line").agg(F.count("*").alias("n"))
    ranked = mine.select("fid", "need", F.explode("lines").alias("line")).join(counts, "line", "left").groupBy("fid", "need").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "line"))).alias("r"))
    rare = ranked.select("fid", F.explode(F.slice("r", F.lit(1), F.size("r") - F.col("need") + 1)).alias("x")).where("x.n > 0").select("fid", F.col("x.line").alias("line"))
    pairs = rare.join(index, "line").select("fid", "owner").distinct()
    both = pairs.join(mine, "fid").join(owners, "owner").where(F.size("theirs") >= F.col("need")).withColumn("shared", F.size(F.array_intersect("lines", "theirs")))
    return both.where(F.col("shared") >= F.col("need")).groupBy("fid").agg(F.max(F.struct("shared", (-F.col("owner").cast("decimal(20,0)")).alias("low"), "owner")).alias("m")).select("fid", "m.owner")


def not_handwritten(symbols: DataFrame, folders: DataFrame) -> DataFrame:
    """(file_path, third_party, contained_in, generated, minified, blob, not_handwritten) for each code file, as spelled.

    ``contained_in`` is the hash of the third-party file that holds most of its lines, the lowest of
    those with the same lines. Rows that are repeated count once. NULL contents and comments count as empty; rows without a path are
    left out; an empty table gives no rows. ``source_category`` only counts as one vote in its tree.
    """
    rows = cut(_rows(symbols))
    once = rows.groupBy("file_path", "row_hash").agg(*(F.any_value(c).alias(c) for c in ("category", "is_unit", "generated", "foreign", "chars", "blob", "idents", "short", "spaces", "template", "stem")), F.any_value("lines").alias("lines"))
    once = cut(once.withColumn("fid", F.xxhash64("file_path")).withColumn("n_lines", F.size("lines")))
    total = lambda c: F.sum(c).alias(c)
    files = once.groupBy("file_path", "fid").agg(F.mode("category").alias("category"), F.max("generated").alias("gen_head"), F.max("foreign").alias("foreign_head"), *map(total, ("chars", "blob", "idents", "short", "spaces", "n_lines")), F.sum((~F.col("is_unit")).cast("long")).alias("parts"), F.count_distinct(F.when(~F.col("is_unit"), F.col("template"))).alias("templates"))
    stems = once.where(F.col("stem").isNotNull() & ~F.col("is_unit")).groupBy("fid", "stem").agg(F.count("*").alias("c")).groupBy(F.col("fid").alias("s_fid")).agg(F.max("c").alias("serial"))
    files = files.withColumn("key", path_key(F.col("file_path"))).join(stems, F.col("fid") == F.col("s_fid"), "left")
    files = cut(files)
    trees = tree_categories(files, folders).withColumnRenamed("key", "t_key")
    files = files.join(trees, F.col("key") == F.col("t_key"), "left").withColumn("std", F.coalesce(F.col("tree_category") == "stdlib", F.lit(False)))
    serial = F.coalesce("serial", F.lit(0))
    generated = (
        F.col("gen_head")
        | F.lower("file_path").rlike(GENERATED_NAME)
        | ((F.col("parts") >= TEMPLATE_ROWS) & (F.col("templates") <= TEMPLATE_SHARE * F.col("parts")))
        | ((F.col("parts") >= SERIAL_ROWS) & (serial >= SERIAL_ROWS) & (serial >= SERIAL_SHARE * F.col("parts")))
    )
    files = cut(
        files.select(
            "file_path",
            "fid",
            "n_lines",
            "std",
            (~F.col("std") & (F.coalesce(F.col("tree_category") == "third_party", F.lit(False)) | foreign_folder(F.col("key")) | F.col("foreign_head"))).alias("known"),
            F.coalesce(generated, F.lit(False)).alias("generated"),
            ((F.col("idents") >= SHORT_IDENTS) & (F.col("short") >= SHORT_SHARE * F.col("idents"))).alias("minified"),
            ((F.col("blob") >= BLOB_CHARS) & (F.col("blob") >= BLOB_SHARE * F.col("chars"))).alias("blob"),
        )
    )
    inside = containment(once, files).select(F.col("fid").alias("i_fid"), F.col("owner").alias("contained_in"))
    out = files.join(inside, F.col("fid") == F.col("i_fid"), "left").withColumn("third_party", F.col("known") | F.col("contained_in").isNotNull())
    return out.select("file_path", "third_party", "contained_in", "generated", "minified", "blob", (F.col("third_party") | F.col("generated") | F.col("minified") | F.col("blob")).alias("not_handwritten"))

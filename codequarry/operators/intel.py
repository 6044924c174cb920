"""Framework intelligence: comment tags, mappings, packages, unit imports, folders; package graph; glossary."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.functions.paths import path_key
from codequarry.functions.text import glob_to_regex
from codequarry.session import cut

# Unit and package names that tell the framework.
VCL_UNITS = ["forms", "controls", "dialogs", "stdctrls", "extctrls", "comctrls"]
VCL_PACKAGES = r"^(vcl|dcl|designide$|rtlvcl$)"
FMX_PACKAGES = r"^fmx"
RTL_PACKAGES = ["rtl", "dbrtl", "xmlrtl", "soaprtl", "inet", "inetdb", "indycore", "indysystem", "indyprotocols"]


def without_comments(code: Column) -> Column:
    return F.regexp_replace(code, r"(?s)\{[^}]*\}|\(\*.*?\*\)|//[^\n]*", " ")


def comment_tag(content: Column) -> Column:
    """VCL, FMX or RTL from ``// FRAMEWORK: X`` in the first ten lines; NULL without one."""
    head = F.array_join(F.slice(F.split(content, "\n"), 1, 10), "\n")
    return F.nullif(F.upper(F.regexp_extract(head, r"(?i)//\s*FRAMEWORK:\s*(VCL|FMX|RTL)\b", 1)), F.lit(""))


def uses_units(content: Column) -> Column:
    """Lower-cased units of all uses clauses, in order, without paths; comments don't count."""
    clauses = F.regexp_extract_all(without_comments(content), F.lit(r"(?is)(?<![\w.])uses\s+([^;]*);"), F.lit(1))
    names = F.flatten(F.transform(clauses, lambda c: F.split(c, ",")))
    return F.filter(F.transform(names, lambda n: F.lower(F.trim(F.regexp_replace(F.regexp_replace(n, r"(?is)\s+in\s+'.*$", ""), r"\s+", " ")))), lambda n: n != "")


def framework_of_units(units: Column) -> Column:
    """The first unit that tells VCL or FMX decides; RTL if there are other units only; NULL without any."""
    tell = F.transform(units, lambda u: F.when(F.startswith(u, F.lit("vcl.")) | u.isin(VCL_UNITS), "VCL").when(F.startswith(u, F.lit("fmx.")), "FMX"))
    first = F.filter(tell, lambda t: t.isNotNull())
    return F.when(F.size(first) > 0, F.element_at(first, 1)).when(F.size(units) > 0, "RTL")


def framework_of_folder(path: Column) -> Column:
    p = path_key(path)
    has = lambda s: F.contains(p, F.lit(s))
    return F.when(has("/source/vcl/"), "VCL").when(has("/source/fmx/"), "FMX").when(has("/source/rtl/") | has("/source/data/"), "RTL")


def mapped(files: DataFrame, overrides: DataFrame) -> DataFrame:
    """(file_path, mapped, ordinal): the first override that names a file, by path or by glob.

    Exact paths are an equi-join; only the globs, a hand-written list, are compared with every file.
    """
    f = files.select("file_path").distinct().withColumn("k", path_key(F.col("file_path")))
    exact = overrides.where("file is not null").select(path_key(F.col("file")).alias("o_k"), "framework", "ordinal")
    a = f.join(exact, F.col("k") == F.col("o_k")).select("file_path", "framework", "ordinal")
    globs = overrides.where("pattern is not null").select(glob_to_regex(F.lower("pattern")).alias("rx"), "framework", "ordinal")
    b = f.join(globs, F.expr("k rlike rx")).select("file_path", "framework", "ordinal")
    return a.unionByName(b).groupBy("file_path").agg(F.min(F.struct("ordinal", "framework")).alias("m")).select("file_path", F.col("m.framework").alias("mapped"), "m.ordinal")


def detect(units: DataFrame, overrides: DataFrame, package_of: DataFrame) -> DataFrame:
    """(file_path, framework, tier, warning) from (file_path, content): tag, mapping, package, uses, folder.

    ``package_of`` has file_key and package_framework (one row a file). Warnings: what a higher
    tier declares against a more restrictive lower one, or a file that no package has.
    """
    t = units.groupBy("file_path").agg(F.max(F.struct(F.length("content").alias("n"), "content")).alias("u")).select("file_path", F.col("u.content").alias("content"))
    t = t.select("file_path", comment_tag(F.col("content")).alias("t1"), framework_of_units(uses_units(F.col("content"))).alias("t4"), framework_of_folder(F.col("file_path")).alias("t5"))
    t = t.join(mapped(t, overrides), "file_path", "left").join(package_of, path_key(F.col("file_path")) == F.col("file_key"), "left")
    t2, t3 = F.col("mapped"), F.nullif(F.col("package_framework"), F.lit(""))
    tier = F.when(F.col("t1").isNotNull(), "tag").when(t2.isNotNull(), "mapping").when(t3.isNotNull(), "package").when(F.col("t4").isNotNull(), "uses").when(F.col("t5").isNotNull(), "folder").otherwise("unknown")
    stricter = F.col("t4").isin("VCL", "FMX")
    warning = (
        F.when((F.col("t1") == "RTL") & stricter, "comment_vs_uses")
        .when(F.col("t1").isNull() & t2.isNotNull() & (t2 != t3), "mapping_vs_package")
        .when(F.col("t1").isNull() & t2.isNull() & (t3 == "RTL") & stricter, "file_vs_package")
        .when((tier == "uses"), "orphaned_file")
        .when(tier == "unknown", "unknown_framework")
    )
    return t.select("file_path", F.coalesce("t1", t2, t3, "t4", "t5", F.lit("")).alias("framework"), tier.alias("tier"), warning.alias("warning"))


#: Most edges of a graph that every task gets whole; larger graphs are joined round by round.
MOST_EDGES = 1_000_000
#: Targets that a task looks for at once.
BLOCK_TARGETS = 1024


def _graph(edges: DataFrame) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Names, and numbers of the ends of each edge."""
    t = edges.toArrow()  # at most MOST_EDGES
    src, dst = (t.column(c).combine_chunks() for c in ("src", "dst"))
    both = pa.chunked_array([src, dst]).combine_chunks().dictionary_encode()
    ends = both.indices.to_numpy()
    return both.dictionary, ends[: len(src)], ends[len(src) :]


def _grouped(keys: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the values of each key from 0 to n - 1 start, and the values by key."""
    return np.concatenate(([0], np.cumsum(np.bincount(keys, minlength=n)))), values[np.argsort(keys, kind="stable")]


def _components(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The number of each node's strongly connected component; edges between components lead to lower numbers."""
    starts, to = (x.tolist() for x in _grouped(src, dst, n))
    seen, low, own = [-1] * n, [0] * n, [-1] * n
    at, stack, met, done = starts[:n], [], 0, 0
    for root in range(n):
        if seen[root] >= 0:
            continue
        path = [root]
        while path:
            x = path[-1]
            if seen[x] < 0:
                seen[x] = low[x] = met
                met += 1
                stack.append(x)
            deeper = False
            while at[x] < starts[x + 1]:
                y = to[at[x]]
                at[x] += 1
                if seen[y] < 0:
                    path.append(y)
                    deeper = True
                    break
                if own[y] < 0:
                    low[x] = min(low[x], seen[y])
            if deeper:
                continue
            path.pop()
            if low[x] == seen[x]:
                while own[x] < 0:
                    own[stack.pop()] = done
                done += 1
            if path:
                low[path[-1]] = min(low[path[-1]], low[x])
    return np.array(own, dtype=np.int64)


def _circular(own: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Of each component whether its nodes reach themselves."""
    out = np.bincount(own) > 1
    out[own[src[src == dst]]] = True
    return out


def reach(edges: DataFrame) -> DataFrame:
    """(src, dst) of everything reachable over one or more edges (src, dst); cycles end by themselves.

    The components of a graph of at most MOST_EDGES edges go to every task, which finds by sets of
    bits who reaches a block of its nodes, in time of the edges; nothing is shuffled. A larger graph
    takes path doubling: as many rounds as the logarithm of the longest path. The closure of a
    package graph is what is wanted, so its size is that of the result.
    """
    pairs = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    n = pairs.count()
    if 0 < n <= MOST_EDGES:
        return _reach_by_bits(pairs)
    while n:
        more = pairs.alias("a").join(pairs.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src"), F.col("b.dst"))
        pairs = cut(pairs.unionByName(more).distinct())
        now = pairs.count()
        if now == n:
            break
        n = now
    return pairs


def _reach_by_bits(edges: DataFrame) -> DataFrame:
    spark = edges.sparkSession
    names, src, dst = _graph(edges)
    own = _components(len(names), src, dst)
    n = int(own.max()) + 1
    between = np.unique(np.stack([own[src], own[dst]])[:, own[src] != own[dst]], axis=1)
    members, succ = _grouped(own, np.arange(len(own)), n), _grouped(between[0], between[1], n)
    targets = np.unique(dst)
    targets = targets[np.argsort(own[targets], kind="stable")]  # what reaches a block has no lower number than its first
    shared = spark.sparkContext.broadcast((names, own, members, succ, targets, _circular(own, src, dst)))
    width = BLOCK_TARGETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, own, (m_at, m), (s_at, s), targets, circular = shared.value
        for block in (x for b in batches for x in b.column("id").to_pylist()):
            wanted = targets[block * width : (block + 1) * width]
            low = own[wanted[0]]
            has = np.zeros((n - low, width // 8), dtype=np.uint8)  # of each component the targets in it
            col = np.arange(len(wanted))
            np.bitwise_or.at(has, (own[wanted] - low, col // 8), (128 >> (col % 8)).astype(np.uint8))
            got = np.zeros_like(has)
            starts, to = s_at[low:].tolist(), s - low
            for c in range(n - low):
                nxt = to[starts[c] : starts[c + 1]]
                nxt = nxt[nxt >= 0]
                if len(nxt):
                    got[c] = np.bitwise_or.reduce(got[nxt] | has[nxt], axis=0)
                if circular[c + low]:
                    got[c] |= has[c]
            for lo in range(0, n - low, 512):
                c, t = np.nonzero(np.unpackbits(got[lo : lo + 512], axis=1)[:, : len(wanted)])
                first = m_at[c + lo + low]
                size = m_at[c + lo + low + 1] - first
                for a in range(0, len(c), 50_000):  # a component may have many members
                    f, k, w = first[a : a + 50_000], size[a : a + 50_000], wanted[t[a : a + 50_000]]
                    for step in range(int(k.max())):
                        here = k > step
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(m[f[here] + step])), names.take(pa.array(w[here]))], ["src", "dst"])

    blocks = -(-len(targets) // width)
    return spark.range(0, blocks, 1, blocks).mapInArrow(run, "src string, dst string")


def circles(edges: DataFrame) -> DataFrame:
    """(src) of the nodes that reach themselves."""
    pairs = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    if not 0 < pairs.count() <= MOST_EDGES:
        return reach(pairs).where("src = dst").select("src")
    names, src, dst = _graph(pairs)
    own = _components(len(names), src, dst)
    return pairs.sparkSession.createDataFrame([(x,) for x in names.filter(pa.array(_circular(own, src, dst)[own])).to_pylist()], "src string")


def package_frameworks(requires: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """(package, framework, method) from (package, ordinal, requires), lower-cased names.

    In list order the first requirement that is, or leads to, VCL or FMX decides. If all
    requirements are known to be RTL, so is the package; with an RTL tag unknown ones may be too.
    No requirements, or unknown ones, give ''. Each round settles what the rounds before allow;
    packages in circles that nothing settles stay unknown.
    """
    r = requires.select(F.lower(F.trim("package")).alias("package"), "ordinal", F.lower(F.trim("requires")).alias("req"))
    direct = F.when(F.col("req").rlike(VCL_PACKAGES), "VCL").when(F.col("req").rlike(FMX_PACKAGES), "FMX").when(F.col("req").isin(RTL_PACKAGES), "RTL")
    r = cut(r.withColumn("direct", direct))
    names = r.select("package").distinct()
    tag = tags.select(F.lower(F.trim("package")).alias("t_package"), F.upper("tag").alias("tag")) if tags is not None else names.select(F.col("package").alias("t_package"), F.lit(None).cast("string").alias("tag")).limit(0)
    known = cut(names.select("package", F.lit(None).cast("string").alias("framework")))
    before = -1
    while True:
        k = known.select(F.col("package").alias("k_package"), F.col("framework").alias("k_framework"))
        j = r.join(k, F.col("req") == F.col("k_package"), "left").withColumn("of", F.coalesce("direct", "k_framework"))
        real = F.col("req").isNotNull() & (F.col("req") != "")
        # a strong requirement counts once none before it is still open
        agg = j.groupBy("package").agg(
            F.min(F.when(F.col("of").isin("VCL", "FMX"), F.struct("ordinal", "of"))).alias("strong"),
            F.min(F.when(real & F.col("of").isNull() & F.col("k_package").isNotNull(), F.col("ordinal"))).alias("open"),
            F.sum((real & F.coalesce(F.col("of") == "RTL", F.lit(False))).cast("int")).alias("rtl"),
            F.sum((real & F.col("of").isNull() & F.col("k_package").isNull()).cast("int")).alias("foreign"),
            F.sum((real & F.coalesce(F.col("of") == "", F.lit(False))).cast("int")).alias("unsure"),
            F.sum(real.cast("int")).alias("n"),
            F.min(F.when(F.col("direct").isin("VCL", "FMX"), F.struct("ordinal", "direct"))).alias("marked"),
        )
        agg = agg.join(tag, F.col("package") == F.col("t_package"), "left")
        settled = (
            F.when(F.col("marked").isNotNull(), F.col("marked.direct"))
            .when(F.col("strong").isNotNull() & (F.col("open").isNull() | (F.col("open") > F.col("strong.ordinal"))), F.col("strong.of"))
            .when(F.col("open").isNotNull(), F.lit(None).cast("string"))
            .when(F.col("n") == 0, "")
            .when((F.col("rtl") == F.col("n")) | ((F.col("tag") == "RTL") & (F.col("rtl") + F.col("foreign") + F.col("unsure") == F.col("n"))), "RTL")
            .otherwise("")
        )
        known = cut(agg.select("package", settled.alias("framework")))
        now = known.where("framework is not null").count()
        if now == before:
            break
        before = now
    # what is open now stands in circles: a strong requirement still decides
    k = known.select(F.col("package").alias("k_package"), F.col("framework").alias("k_framework"))
    last = r.join(k, F.col("req") == F.col("k_package"), "left").withColumn("of", F.coalesce("direct", "k_framework")).groupBy(F.col("package").alias("l_package")).agg(F.min(F.when(F.col("of").isin("VCL", "FMX"), F.struct("ordinal", "of"))).alias("s"))
    return known.join(last, F.col("package") == F.col("l_package")).select("package", F.coalesce("framework", "s.of", F.lit("")).alias("framework"))


def glossary_terms(texts: DataFrame, key: str, text: str, glossary: DataFrame) -> DataFrame:
    """(key, term, english, tags) for glossary terms that open a word of a text, ignoring case.

    Words and all their prefixes of a term's possible lengths are joined by equality; terms of
    several words are compared word by word through their first one. The glossary, a hand-written
    list, is broadcast, so that texts and their words stay where they are.
    """
    g = glossary.select(F.lower("term").alias("g_term"), "term", "english", "tags").withColumn("g_first", F.element_at(F.split("g_term", " "), 1)).withColumn("one", ~F.contains("g_term", F.lit(" ")))
    lengths = [r["n"] for r in g.select(F.length("g_first").alias("n")).distinct().collect()]  # lengths of words, a few dozen at most
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), F.lower))
    w = texts.select(key, F.col(text).alias("_t"), F.explode(words).alias("word"))
    cutting = F.array_distinct(F.filter(F.transform(F.array(*map(F.lit, sorted(lengths))), lambda n: F.when(F.length("word") >= n, F.expr("word").substr(F.lit(1), n))), lambda p: p.isNotNull()))
    p = w.select(key, "_t", "word", F.explode(cutting).alias("prefix"))
    hit = p.join(F.broadcast(g), F.col("prefix") == F.col("g_first")).where(F.col("one") | (F.col("word") == F.col("g_first")) & F.contains(F.lower("_t"), F.col("g_term")))
    return hit.select(key, "term", "english", "tags").distinct()


def enrich(texts: DataFrame, key: str, text: str, glossary: DataFrame) -> DataFrame:
    """(key, spanish_terms, domain_tags, n_terms): detected terms as sorted JSON, tags as sorted CSV; texts without terms get '[]' and ''."""
    hits = glossary_terms(texts, key, text, glossary)
    terms = hits.groupBy(key).agg(F.to_json(F.array_sort(F.collect_set("term"))).alias("terms"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))), ",").alias("tags"), F.count_distinct("term").alias("n"))
    return texts.select(key).join(terms, key, "left").select(key, F.coalesce("terms", F.lit("[]")).alias("spanish_terms"), F.coalesce("tags", F.lit("")).alias("domain_tags"), F.coalesce("n", F.lit(0)).alias("n_terms"))


def dependency_pairs(units: DataFrame) -> DataFrame:
    """(src, dst) of unit imports from (name, content)."""
    return units.select(F.lower("name").alias("src"), F.explode(uses_units(F.col("content"))).alias("dst")).where("src is not null").distinct()


def transitive_uses(edges: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """(root, unit, distance) of all units reachable from roots (root); breadth first, each unit once, so circles end.

    ``most`` limits the levels; by default all are taken.
    """
    front = cut(roots.select("root", F.col("root").alias("unit"), F.lit(0).alias("distance")).distinct())
    seen = front
    for d in count(1) if most is None else range(1, most):
        nxt = front.join(edges, F.col("unit") == F.col("src")).select("root", F.col("dst").alias("unit")).distinct().join(seen.select("root", "unit"), ["root", "unit"], "left_anti")
        front = cut(nxt.withColumn("distance", F.lit(d)))
        if not front.limit(1).count():
            break
        seen = cut(seen.unionByName(front))
    return seen


def first_by(df: DataFrame, key: str, *order: Column) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def orphan_mappings(detected: DataFrame, overrides: DataFrame) -> DataFrame:
    """(ordinal, file, pattern, framework, reason) to add for files that only their imports or folders tell and that no override names.

    ``detected`` comes from ``detect``. Entries are numbered after the last override, by path.
    """
    last = overrides.agg(F.coalesce(F.max("ordinal"), F.lit(-1)).alias("last"))
    todo = detected.where(F.col("tier").isin("uses", "folder")).select(F.translate("file_path", "\\", "/").alias("file"), "framework", F.concat(F.lit("detected from "), "tier").alias("reason"))
    # numbered within sorted partitions, to which the counts of those before are added
    parts = cut(todo.repartitionByRange("file").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("part").agg(F.count("*").alias("k")).select(F.col("part").alias("s_part"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))  # one row a partition
    inner = F.row_number().over(Window.partitionBy("part").orderBy("file"))
    numbered = parts.join(F.broadcast(starts), F.col("part") == F.col("s_part")).withColumn("n", F.col("start") + inner)
    return numbered.crossJoin(F.broadcast(last)).select((F.col("last") + F.col("n")).cast("int").alias("ordinal"), "file", F.lit(None).cast("string").alias("pattern"), "framework", "reason")


def in_overrides(files: DataFrame, overrides: DataFrame) -> DataFrame:
    """(file_path, is_mapped) of files: whether an override names them, by path or by glob."""
    hit = mapped(files, overrides).select(F.col("file_path").alias("_f"))
    return files.select("file_path").distinct().join(hit, F.col("file_path") == F.col("_f"), "left").select("file_path", F.col("_f").isNotNull().alias("is_mapped"))


def add_override(overrides: DataFrame, framework: str, reason: str, file: str | None = None, pattern: str | None = None) -> DataFrame:
    """The overrides with one more at the end, for a path or for a glob."""
    if (file is None) == (pattern is None):
        raise ValueError("an override has a file or a pattern")
    last = overrides.agg((F.coalesce(F.max("ordinal"), F.lit(-1)) + 1).cast("int").alias("ordinal"))
    text = lambda v: F.lit(v).cast("string")
    return overrides.unionByName(last.select("ordinal", text(file).alias("file"), text(pattern).alias("pattern"), text(framework).alias("framework"), text(reason).alias("reason")), allowMissingColumns=True)


def load_glossary(spark: SparkSession, path: str) -> DataFrame:
    """(term, english, tags) of a JSON glossary: a list of {term, english: [], domain_tags: []}; terms that repeat are merged."""
    raw = spark.read.option("multiLine", True).schema("term string, english array<string>, domain_tags array<string>").json(path)
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>"))))))
    return raw.where(F.trim("term") != "").groupBy(F.trim("term").alias("term")).agg(every("english").alias("english"), every("domain_tags").alias("tags"))


def expand_abbreviations(text: Column, table: DataFrame | dict[str, str]) -> Column:
    """Words of a text that are abbreviations, ignoring case, in full; the table is a hand-written list."""
    pairs = table if isinstance(table, dict) else {r["short"]: r["long"] for r in table.select("short", "long").collect()}
    out = text
    for short, full in sorted(pairs.items()):
        out = F.regexp_replace(out, rf"(?i)(?<![A-Za-z0-9_])\Q{short}\E(?![A-Za-z0-9_])", full)
    return out

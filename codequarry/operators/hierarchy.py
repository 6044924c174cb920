"""Full hierarchies from parent-child rows.

Heavy-path decomposition after cycle separation. Pointer doubling (as many rounds as the
logarithm of the depth) yields subtree sizes and the rows that lead into a circle; each
parent's largest subtree continues its chain, so a path to the root meets at most log2(n)
chains. Paths are concatenated chain segments; a chain's nodes are numbered in a row, so
the descendants of a node are an interval of preorder numbers.

No step gathers a parent's children in one task: sums are pre-aggregated by Spark, and
sibling offsets use two-level prefix sums over salted groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions.paths import blank, path_key
from codequarry.session import cut

#: Salted groups per parent in the prefix sums over siblings.
SIBLING_SALTS = 64


def _id_of(nodes: DataFrame, key: str, salt: int) -> Column:
    return F.xxhash64(F.col(key), F.lit(salt))


def _numbered(nodes: DataFrame) -> DataFrame:
    """Adds 64-bit ids that are distinct for distinct keys (another salt is taken on a collision)."""
    for salt in range(8):
        out = cut(nodes.withColumn("id", _id_of(nodes, "key", salt)).withColumn("pid", _id_of(nodes, "parent_key", salt)))
        if not out.groupBy("id").count().where("count > 1").limit(1).count():
            return out
    raise ValueError("keys collide under every salt")


def _active(state: DataFrame) -> int:
    return state.where(F.col("jump").isNotNull()).count()


def _doubled(state: DataFrame, sizes: bool) -> DataFrame:
    """One round: every pointer jumps twice as far; sizes gain what lies exactly one jump below."""
    t = state.select(F.col("id").alias("t_id"), F.col("jump").alias("t_jump"), F.col("top").alias("t_top"), F.col("steps").alias("t_steps"))
    s = state.join(t, F.col("jump") == F.col("t_id"), "left")
    cols = [
        "id",
        F.col("t_jump").alias("jump"),
        F.when(F.col("jump").isNull(), F.col("top")).otherwise(F.col("t_top")).alias("top"),
        (F.col("steps") + F.coalesce("t_steps", F.lit(0))).alias("steps"),
    ]
    if not sizes:
        return s.select(*cols)
    gain = state.where(F.col("jump").isNotNull()).groupBy(F.col("jump").alias("g_id")).agg(F.sum("size").alias("gain"))
    return s.join(gain, F.col("id") == F.col("g_id"), "left").select(*cols, (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size"))


def _climb(state: DataFrame, sizes: bool) -> DataFrame:
    """Doubles until every row has its top, or until the rest leads into circles (then ``jump`` stays set)."""
    state = cut(state)
    left = _active(state)
    while left:
        state = cut(_doubled(state, sizes))
        now = _active(state)
        if now == left:  # a round in which no row ends: only rows that lead into circles are left
            break
        left = now
    return state


def _circles(nodes: DataFrame) -> DataFrame:
    """For rows that lead into a circle: ``circle``, the smallest path on it."""
    n = nodes.count()
    if not n:
        return nodes.select("id", F.col("path").alias("circle"))
    m = cut(nodes.select("id", F.col("pid").alias("jump"), F.col("path").alias("low")))
    reach = 1
    while reach < n:
        t = m.select(F.col("id").alias("t_id"), F.col("jump").alias("t_jump"), F.col("low").alias("t_low"))
        m = cut(m.join(t, F.col("jump") == F.col("t_id")).select("id", F.col("t_jump").alias("jump"), F.least("low", "t_low").alias("low")))
        reach *= 2
    t = m.select(F.col("id").alias("t_id"), F.col("low").alias("circle"))
    return m.join(t, F.col("jump") == F.col("t_id")).select("id", "circle")


def _sibling_offsets(light: DataFrame) -> DataFrame:
    """Preorder offset of each light child among its light siblings, by two-level prefix sums."""
    salted = light.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SIBLING_SALTS)))
    sums = salted.groupBy("pid", "salt").agg(F.sum("size").alias("part"))
    before = Window.partitionBy("pid").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("pid").alias("b_pid"), F.col("salt").alias("b_salt"), F.coalesce(F.sum("part").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("pid", "salt").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    own = salted.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    return own.join(sums, (F.col("pid") == F.col("b_pid")) & (F.col("salt") == F.col("b_salt"))).select("id", (F.col("base") + F.col("inner")).alias("offset"))


def hierarchy(rows: DataFrame, path_col: str, parent_col: str, latest_col: str | None = None) -> DataFrame:
    """One row per distinct folder.

    Columns: ``path`` (as spelled in the counting row), ``parent_path`` (NULL for roots),
    ``root_path``, ``depth`` (-1 if going up never ends; ``root_path`` is then the smallest
    path on the circle), ``names`` (folder names from the root down), ``n_descendants``,
    ``preorder`` and ``last_preorder`` (the descendants of a node are the rows of the same
    root with a preorder in that interval). The last four are NULL for rows in or below circles.

    Several rows of a folder: the greatest ``latest_col`` counts, then the greatest path. Rows
    without a path are left out. Parents that are NULL, blank or not in the table make roots.
    Paths agree by ``path_key``. An empty table gives an empty result. Other columns are ignored.
    """
    p, q = F.col(f"`{path_col}`"), F.col(f"`{parent_col}`")
    at = F.col(f"`{latest_col}`") if latest_col else F.lit(0)
    rows = rows.where(~blank(p)).select(path_key(p).alias("key"), F.struct(at.alias("at"), p.alias("path"), F.when(~blank(q), path_key(q)).alias("parent_key")).alias("row"))
    nodes = rows.groupBy("key").agg(F.max("row").alias("row")).select("key", "row.path", "row.parent_key")
    nodes = _numbered(nodes).select("id", "path", F.when(F.col("parent_key").isNotNull(), F.col("pid")).alias("pid"))
    known = nodes.select(F.col("id").alias("k_id"))
    nodes = cut(nodes.join(known, F.col("pid") == F.col("k_id"), "left").select("id", "path", F.col("k_id").alias("pid")))

    start = nodes.select("id", F.col("pid").alias("jump"), F.when(F.col("pid").isNull(), F.col("id")).alias("top"), F.when(F.col("pid").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.lit(1).cast("long").alias("size"))
    state = _climb(start, sizes=True)
    tree = state.where(F.col("jump").isNull()).select(F.col("id").alias("s_id"), "size")
    tree = cut(nodes.join(tree, F.col("id") == F.col("s_id")).select("id", "pid", "path", "size"))
    lost = nodes.join(state.where(F.col("jump").isNotNull()).select("id"), "id", "left_semi")

    # chains: each parent's largest subtree carries its chain on
    best = tree.where(F.col("pid").isNotNull()).groupBy("pid").agg(F.max(F.struct("size", "path", "id")).alias("h")).select(F.col("pid").alias("h_pid"), F.col("h.id").alias("heavy"), F.col("h.size").alias("heavy_size"))
    linked = cut(tree.join(best, F.col("pid") == F.col("h_pid"), "left").withColumn("is_heavy", F.coalesce(F.col("heavy") == F.col("id"), F.lit(False))).select("id", "pid", "path", "size", "is_heavy", "heavy_size"))
    up = linked.select("id", F.when(F.col("is_heavy"), F.col("pid")).alias("jump"), F.when(~F.col("is_heavy"), F.col("id")).alias("top"), F.when(F.col("is_heavy"), 1).otherwise(0).cast("long").alias("steps"))
    chains = _climb(up, sizes=False).select(F.col("id").alias("c_id"), F.col("top").alias("head"), F.col("steps").alias("pos"))
    placed = cut(linked.join(chains, F.col("id") == F.col("c_id")).drop("c_id"))

    name = F.element_at(F.split(path_key_keep_case(F.col("path")), "/"), -1)
    segments = placed.groupBy("head").agg(F.array_sort(F.collect_list(F.struct("pos", name.alias("name")))).alias("seg")).select("head", F.col("seg.name").alias("segment"))
    light = placed.where(~F.col("is_heavy") & F.col("pid").isNotNull())
    offsets = _sibling_offsets(light.select("id", "pid", "size"))
    parents = placed.select(F.col("id").alias("p_id"), F.col("head").alias("p_head"), F.col("pos").alias("p_pos"))
    heads = light.join(offsets.withColumnRenamed("id", "o_id"), F.col("id") == F.col("o_id")).join(parents, F.col("pid") == F.col("p_id"))
    heads = cut(heads.select(F.col("id").alias("head"), "p_head", "p_pos", (F.col("heavy_size") + F.col("offset") + 1).alias("skip")))

    roots = placed.where(F.col("pid").isNull())
    level = cut(roots.select(F.col("id").alias("head"), F.col("path").alias("root_path"), F.lit(0).cast("long").alias("pre"), F.lit(0).cast("long").alias("base"), F.array().cast("array<string>").alias("prefix")))
    levels = level
    while True:
        above = level.join(segments, "head").select(F.col("head").alias("a_head"), "root_path", "pre", "base", "prefix", "segment")
        level = heads.join(above, F.col("p_head") == F.col("a_head")).select(
            "head", "root_path", (F.col("pre") + F.col("p_pos") + F.col("skip")).alias("pre"), (F.col("base") + F.col("p_pos") + 1).alias("base"), F.concat("prefix", F.expr("slice(segment, 1, int(p_pos) + 1)")).alias("prefix")
        )
        level = cut(level)
        if not level.limit(1).count():
            break
        levels = levels.unionByName(level)
    whole = placed.join(levels.join(segments, "head"), "head")
    spelled = nodes.select(F.col("id").alias("n_id"), F.col("path").alias("parent_path"))
    found = whole.join(spelled, F.col("pid") == F.col("n_id"), "left").select(
        "path",
        "parent_path",
        "root_path",
        (F.col("base") + F.col("pos")).cast("int").alias("depth"),
        F.concat("prefix", F.expr("slice(segment, 1, int(pos) + 1)")).alias("names"),
        (F.col("size") - 1).alias("n_descendants"),
        (F.col("pre") + F.col("pos")).alias("preorder"),
        (F.col("pre") + F.col("pos") + F.col("size") - 1).alias("last_preorder"),
    )
    none = F.lit(None)
    circles = lost.join(_circles(lost), "id").join(spelled, F.col("pid") == F.col("n_id"), "left").select(
        "path", "parent_path", F.col("circle").alias("root_path"), F.lit(-1).alias("depth"), none.cast("array<string>").alias("names"), none.cast("long").alias("n_descendants"), none.cast("long").alias("preorder"), none.cast("long").alias("last_preorder")
    )
    return found.unionByName(circles)


def path_key_keep_case(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), "(?<=.)/+$", "")


def descendants(tree: DataFrame, of: DataFrame) -> DataFrame:
    """(path, descendant) for the folders in ``of`` (a column ``path``), by preorder intervals of the same root.

    Folders on or below circles have no interval and give no rows.
    """
    a = tree.join(of.select("path").distinct(), "path", "left_semi").select("path", F.col("root_path").alias("a_root"), F.col("preorder").alias("lo"), F.col("last_preorder").alias("hi"))
    b = tree.select(F.col("path").alias("descendant"), "root_path", "preorder")
    return a.join(b, (F.col("a_root") == F.col("root_path")) & (F.col("preorder") > F.col("lo")) & (F.col("preorder") <= F.col("hi"))).select("path", "descendant")

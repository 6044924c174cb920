"""Search stages and fusion over symbols and vectors.

Query sets: every symbol and every vector whose id is divisible by 50. Names are looked up as
they are; searches inside texts take the first words of every other symbol's comments.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.functions import text
from codequarry.operators import analytics, fts, search, vectors
from codequarry.query_sets.scalar import KW, SIM
from codequarry.registry import SQL, query
from codequarry.session import shared_folder, table

_TEXTS = "SELECT query_id, text FROM (SELECT id AS query_id, CASE WHEN id % 100 = 50 AND len(w) >= 2 THEN array_to_string(w[1:3], ' ') ELSE name END AS text FROM (SELECT id, name, regexp_extract_all(coalesce(comments, ''), '([A-Za-z]+)', 1) AS w FROM symbols WHERE id % 50 = 0)) WHERE text IS NOT NULL"
_TQ = f"text_queries AS ({_TEXTS})"
_CLEAN = "regexp_replace(translate(trim({0}), '''\";', ''), ' {{2,}}', ' ', 'g')"
_FIT = "length(trim({0})) BETWEEN 2 AND 200"
_NQ = "name_queries AS (SELECT id AS query_id, regexp_replace(translate(trim(name), '''\";', ''), ' {2,}', ' ', 'g') AS q FROM symbols WHERE id % 50 = 0 AND length(trim(name)) BETWEEN 2 AND 200)"
_RANK = "CASE lower(type) WHEN 'class' THEN 1 WHEN 'interface' THEN 2 WHEN 'function' THEN 3 WHEN 'procedure' THEN 4 ELSE 5 END"


def name_queries(spark, sf):
    return table(spark, sf, "symbols").where("id % 50 = 0 and name is not null").select(F.col("id").alias("query_id"), F.col("name").alias("text"))


def text_queries(spark, sf):
    s = table(spark, sf, "symbols").where("id % 50 = 0")
    words = F.regexp_extract_all(F.coalesce("comments", F.lit("")), F.lit("([A-Za-z]+)"), F.lit(1))
    phrase = F.when((F.col("id") % 100 == 50) & (F.size(words) >= 2), F.array_join(F.slice(words, 1, 3), " ")).otherwise(F.col("name"))
    return s.select(F.col("id").alias("query_id"), phrase.alias("text")).where("text is not null")


def part_queries(spark, sf):
    return name_queries(spark, sf).withColumn("text", F.substring("text", 2, 6))


_EXACT = f"SELECT query_id, symbol_id FROM (SELECT query_id, id AS symbol_id, row_number() OVER (PARTITION BY query_id ORDER BY {_RANK}, id) AS n FROM name_queries JOIN symbols ON upper(q) = upper(name)) WHERE n = 1"


@query("exact_name", f"WITH {_NQ} {_EXACT}")
def exact_name(spark, sf):
    return search.exact(name_queries(spark, sf), table(spark, sf, "symbols")).where("is_exact").select("query_id", "symbol_id")


_PART_Q = f"parts AS (SELECT * FROM (SELECT id AS query_id, {_CLEAN.format('substr(name, 2, 6)')} AS q FROM symbols WHERE id % 50 = 0 AND {_FIT.format('substr(name, 2, 6)')}) WHERE length(q) >= 2)"


@query(
    "partial_name",
    f"""
WITH {_PART_Q}, hit AS (SELECT DISTINCT query_id FROM parts JOIN symbols ON upper(q) = upper(name))
SELECT query_id, symbol_id FROM (SELECT query_id, id AS symbol_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN starts_with(lower(name), lower(q)) THEN 0 ELSE 1 END, length(name), id) AS n
FROM parts JOIN symbols ON contains(lower(name), lower(q)) WHERE query_id NOT IN (SELECT query_id FROM hit)) WHERE n = 1
""",
)
def partial_name(spark, sf):
    return search.exact(part_queries(spark, sf), table(spark, sf, "symbols")).where("not is_exact").select("query_id", "symbol_id")


@query(
    "fuzzy_name",
    f"""
WITH {_PART_Q}, hits AS (SELECT query_id, q, id AS symbol_id, name,
  row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN lower(name) = lower(q) THEN 0 WHEN starts_with(lower(name), lower(q)) THEN 1 WHEN contains(lower(full_name), lower(q)) THEN 2 ELSE 3 END, length(name) NULLS FIRST, id) AS pos
  FROM parts JOIN symbols ON contains(lower(coalesce(name, '') || chr(1) || coalesce(full_name, '') || chr(1) || coalesce(parent_class, '')), lower(q)))
SELECT query_id, symbol_id, round({SIM.format('q', "coalesce(name, '')")}, 6) AS score, pos FROM hits WHERE pos <= 10
""",
)
def fuzzy_name(spark, sf):
    got = search.fuzzy(part_queries(spark, sf), table(spark, sf, "symbols"), 10)
    return got.select("query_id", "symbol_id", F.round("score", 6).alias("score"), F.col("pos").cast("long").alias("pos"))


def _full(hit: str, tiers: str) -> str:
    return f"""
WITH {_TQ}, tq AS (SELECT query_id, {_CLEAN.format('text')} AS q, {KW.format(_CLEAN.format('text'))} AS k FROM text_queries WHERE {_FIT.format('text')}),
hits AS (SELECT query_id, q, id AS symbol_id, coalesce(comments, '') || ' ' || coalesce(content, '') AS t, row_number() OVER (PARTITION BY query_id ORDER BY {tiers}, id) AS pos FROM tq JOIN symbols ON len(k) > 0 AND ({hit}))
SELECT query_id, symbol_id, round({SIM.format('q', 't')}, 6) AS score, pos FROM hits WHERE pos <= 10
"""


_LIKE = "coalesce(lower({0}) LIKE '%' || replace(array_to_string(k, '%'), '_', '\\_') || '%' ESCAPE '\\', false)"
_ALL = "len(list_filter(k, lambda w: NOT contains(lower(coalesce({0}, '')), w))) = 0"


def _stage(df):
    return df.select("query_id", "symbol_id", F.round("score", 6).alias("score"), F.col("pos").cast("long").alias("pos"))


@query("full_text_ordered", _full(" OR ".join(_LIKE.format(c) for c in ("name", "comments", "content")), f"CASE WHEN {_LIKE.format('name')} THEN 0 WHEN {_LIKE.format('comments')} THEN 1 ELSE 2 END"))
def full_text_ordered(spark, sf):
    return _stage(search.full_text(text_queries(spark, sf), table(spark, sf, "symbols"), 10))


@query("full_text_all_terms", _full(_ALL.format("coalesce(name, '') || chr(1) || coalesce(comments, '') || chr(1) || coalesce(content, '')"), f"CASE WHEN {_ALL.format('name')} THEN 0 WHEN {_ALL.format('comments')} THEN 1 ELSE 2 END"))
def full_text_all_terms(spark, sf):
    return _stage(search.full_text(text_queries(spark, sf), table(spark, sf, "symbols"), 10, mode="all_terms"))


_USABLE = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"


def _knn(distance: str, score: str, k: int, where: str = "") -> str:
    return f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM vec_embeddings WHERE {_USABLE}), d AS (
  SELECT q.vec_id AS query_id, v.vec_id AS symbol_id, round({distance}, 6) + 0.0 AS distance FROM v q JOIN v ON true WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, symbol_id) AS pos FROM d)
SELECT query_id, symbol_id, distance, round({score}, 8) AS score, pos FROM r WHERE pos <= {k} {where}
"""


def _vecs(spark, sf):
    v = table(spark, sf, "vec_embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return v.where("id % 50 = 0").withColumnRenamed("id", "query_id"), v


def _pos(df):
    return df.withColumn("pos", F.col("pos").cast("long"))


@query("knn_cosine", _knn("1 - list_cosine_similarity(q.e, v.e)", "greatest(0, least(1, 1 - distance / 2))", 10))
def knn_cosine(spark, sf):
    return _pos(vectors.knn(*_vecs(spark, sf), 10))


@query("knn_l2", _knn("list_distance(q.e, v.e)", "greatest(0, least(1, exp(-distance)))", 10))
def knn_l2(spark, sf):
    return _pos(vectors.knn(*_vecs(spark, sf), 10, "l2"))


@query("knn_threshold", _knn("1 - list_cosine_similarity(q.e, v.e)", "greatest(0, least(1, 1 - distance / 2))", 20, "AND 1 - distance / 2 >= 1 - 0.4 / 2"))
def knn_threshold(spark, sf):
    return _pos(vectors.knn(*_vecs(spark, sf), 20, max_distance=0.4))


@query("approx_knn")
def approx_knn(spark, sf):
    q, v = _vecs(spark, sf)
    return vectors.InvertedFile.fit(v, 32).search(q, v, 10, 12)


@query("approx_recall", f"SELECT count(*) AS n_queries, true AS reached FROM vec_embeddings WHERE vec_id % 50 = 0 AND {_USABLE}")
def approx_recall(spark, sf):
    """Whether ``approx_knn`` holds nine in ten of the neighbours of the exact search."""
    q, v = _vecs(spark, sf)
    true = vectors.knn(q, v, 10).select("query_id", "symbol_id")
    got = vectors.InvertedFile.fit(v, 32).search(q, v, 10, 12).select("query_id", "symbol_id", F.lit(1).alias("hit"))
    both = true.join(got, ["query_id", "symbol_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("n_queries"), (F.sum(F.coalesce("hit", F.lit(0))) >= 0.9 * F.count("*")).alias("reached"))


@query(
    "knn_symbols",
    f"""
WITH v AS (SELECT vec_id, symbol_id, embedding::DOUBLE[] AS e FROM vec_embeddings WHERE {_USABLE}), d AS (
  SELECT q.vec_id AS query_id, v.vec_id, v.symbol_id, round(1 - list_cosine_similarity(q.e, v.e), 6) + 0.0 AS distance FROM v q JOIN v ON true WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS pos FROM d)
SELECT query_id, r.vec_id, s.id, s.name, s.type FROM r JOIN symbols s ON r.symbol_id = s.id WHERE pos <= 10
""",
)
def knn_symbols(spark, sf):
    got = vectors.knn(*_vecs(spark, sf), 10).withColumnRenamed("symbol_id", "vec_id")
    owner = table(spark, sf, "vec_embeddings").select("vec_id", "symbol_id")
    return got.join(owner, "vec_id").join(table(spark, sf, "symbols").select("id", "name", "type"), F.col("symbol_id") == F.col("id")).select("query_id", "vec_id", "id", "name", "type")


@query(
    "symbols_in_file",
    r"""
WITH one AS (SELECT file_path FROM symbols WHERE id = (SELECT min(id) FROM symbols WHERE file_path IS NOT NULL))
SELECT id, name, start_line FROM symbols, one WHERE lower(replace(symbols.file_path, '\', '/')) = lower(replace(one.file_path, '\', '/'))
""",
)
def symbols_in_file(spark, sf):
    s = table(spark, sf, "symbols")
    path = s.where("file_path is not null").orderBy("id").select("file_path").first()[0]
    return search.symbols_in_file(s, path).select("id", "name", "start_line")


@query(
    "symbol_at_line",
    r"""
WITH p AS (SELECT id AS pos_id, lower(replace(file_path, '\', '/')) AS k, (start_line + 1) AS pos_line FROM symbols WHERE id % 50 = 0 AND start_line IS NOT NULL),
r AS (SELECT pos_id, s.id AS symbol_id, row_number() OVER (PARTITION BY pos_id ORDER BY s.start_line DESC, s.id) AS n FROM p JOIN symbols s ON lower(replace(s.file_path, '\', '/')) = p.k AND s.start_line <= pos_line AND (s.end_line >= pos_line OR s.end_line IS NULL))
SELECT pos_id, symbol_id FROM r WHERE n = 1
""",
)
def symbol_at_line(spark, sf):
    s = table(spark, sf, "symbols")
    p = s.where("id % 50 = 0 and start_line is not null").select(F.col("id").alias("pos_id"), "file_path", F.col("start_line").alias("line"))
    return search.symbol_at_line(p, s)


_REF = """
WITH q AS (SELECT DISTINCT lower(name) AS q FROM symbols WHERE id % 50 = 0 AND name IS NOT NULL), terms AS (
  SELECT DISTINCT id, unnest(list_concat({split}, [lower(coalesce(name, ''))])) AS term FROM symbols),
r AS (SELECT q.q AS name, s.id AS symbol_id, CASE WHEN lower(s.name) = q.q THEN 'definition' ELSE 'reference' END AS match_type,
  row_number() OVER (PARTITION BY q.q ORDER BY CASE WHEN lower(s.name) = q.q THEN 0 ELSE 1 END, s.file_path NULLS FIRST, s.start_line NULLS FIRST, s.id) AS pos
  FROM q JOIN terms t ON q.q = t.term JOIN symbols s ON s.id = t.id)
SELECT name, symbol_id, match_type, pos FROM r WHERE pos <= 100
"""


@query("references", _REF.format(split="list_transform(regexp_extract_all(coalesce(content, ''), '\\b([A-Za-z_][A-Za-z0-9_]*)\\b', 1), lambda w: lower(w))"))
def references(spark, sf):
    s = table(spark, sf, "symbols")
    q = s.where("id % 50 = 0 and name is not null").select(F.lower("name").alias("query_id"), F.lower("name").alias("name")).distinct()
    return search.references(q, s).select(F.col("query_id").alias("name"), "symbol_id", "match_type", F.col("pos").cast("long").alias("pos"))


# ---------------------------------------------------------------- fusion

_HQ = "SELECT id, name, full_name, parent_class, comments, content, type, source_category FROM symbols"


def _hybrid(n: int, boost: str = "1.0") -> str:
    like = " OR ".join(_LIKE.format(c) for c in ("name", "comments", "content"))
    fq = "coalesce(name, '') || chr(1) || coalesce(full_name, '') || chr(1) || coalesce(parent_class, '')"
    return f"""
WITH {_TQ}, tq AS (SELECT * FROM (SELECT query_id, {_CLEAN.format('text')} AS q, {KW.format(_CLEAN.format('text'))} AS k FROM text_queries WHERE {_FIT.format('text')}) WHERE length(q) >= 2),
e1 AS (SELECT query_id, id AS symbol_id, true AS is_exact, 1.0::DOUBLE AS score, 1 AS pos, row_number() OVER (PARTITION BY query_id ORDER BY {_RANK}, id) AS n FROM tq JOIN symbols ON upper(q) = upper(name)),
e2 AS (SELECT query_id, id AS symbol_id, false AS is_exact, 0.8::DOUBLE AS score, 1 AS pos, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN starts_with(lower(name), lower(q)) THEN 0 ELSE 1 END, length(name), id) AS n
  FROM tq JOIN symbols ON contains(lower(name), lower(q)) WHERE query_id NOT IN (SELECT query_id FROM e1)),
f AS (SELECT query_id, id AS symbol_id, false AS is_exact, {SIM.format('q', "coalesce(name, '')")} AS score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN lower(name) = lower(q) THEN 0 WHEN starts_with(lower(name), lower(q)) THEN 1 WHEN contains(lower(full_name), lower(q)) THEN 2 ELSE 3 END, length(name) NULLS FIRST, id) AS pos
  FROM tq JOIN symbols ON contains(lower({fq}), lower(q))),
t AS (SELECT query_id, id AS symbol_id, false AS is_exact, {SIM.format('q', "coalesce(comments, '') || ' ' || coalesce(content, '')")} AS score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN {_LIKE.format('name')} THEN 0 WHEN {_LIKE.format('comments')} THEN 1 ELSE 2 END, id) AS pos
  FROM tq JOIN symbols ON len(k) > 0 AND ({like})),
u AS (SELECT query_id, symbol_id, is_exact, score, pos, 0 AS stage, 'exact_name' AS match_type FROM e1 WHERE n = 1 UNION ALL SELECT query_id, symbol_id, is_exact, score, pos, 0, 'partial_name' FROM e2 WHERE n = 1
  UNION ALL SELECT query_id, symbol_id, is_exact, score, pos, 1, 'fuzzy_name' FROM f WHERE pos <= {n} UNION ALL SELECT query_id, symbol_id, is_exact, score, pos, 2, 'full_text' FROM t WHERE pos <= {n}),
b AS (SELECT u.query_id, u.symbol_id, u.is_exact, u.score * {boost} AS score, u.match_type, u.stage, u.pos FROM u JOIN symbols s ON s.id = u.symbol_id),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id, symbol_id ORDER BY is_exact DESC, score DESC, stage, pos DESC) AS r FROM b),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY is_exact DESC, score DESC, symbol_id) AS rank FROM d WHERE r = 1)
SELECT query_id, symbol_id, match_type, is_exact, round(score, 6) AS score, rank FROM o WHERE rank <= {n}
"""


def _ranked(df):
    return df.select("query_id", "symbol_id", "match_type", "is_exact", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("batch_hybrid", _hybrid(10))
def batch_hybrid(spark, sf):
    return _ranked(search.hybrid(text_queries(spark, sf), table(spark, sf, "symbols"), 10))


@query("hybrid_search", _hybrid(5))
def hybrid_search(spark, sf):
    return _ranked(search.hybrid(text_queries(spark, sf), table(spark, sf, "symbols"), 5))


@query("prefer_boost", _hybrid(10, "CASE WHEN s.source_category = 'third_party' THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END"))
def prefer_boost(spark, sf):
    return _ranked(search.hybrid(text_queries(spark, sf), table(spark, sf, "symbols"), 10, preferred="third_party"))


@query("hybrid_semantic")
def hybrid_semantic(spark, sf):
    from codequarry.operators.embed import embed_column

    s = table(spark, sf, "symbols")
    q = text_queries(spark, sf)
    v = embed_column(s.select("id", F.concat_ws(" ", "name", "comments").alias("t")), "t", 64).select("id", "vec")
    near = vectors.as_stage(vectors.knn(embed_column(q, "text", 64).select("query_id", "vec"), v, 20))
    return _ranked(search.hybrid(q, s, 10, vectors=near))


@query(
    "rerank_lexical",
    f"""
WITH h AS ({_hybrid(50)}), t AS (SELECT query_id, {_CLEAN.format('text')} AS q FROM ({_TEXTS})),
c AS (SELECT h.*, q, s.name, count(*) OVER (PARTITION BY h.query_id) AS n_all, CASE WHEN s.name IS NULL THEN coalesce(s.content, '') WHEN s.content IS NULL THEN s.name ELSE s.name || chr(10) || s.content END AS doc FROM h JOIN t ON h.query_id = t.query_id JOIN symbols s ON s.id = h.symbol_id),
f AS (SELECT query_id, symbol_id, is_exact, CASE WHEN n_all <= 5 THEN match_type ELSE 'reranked' END AS match_type, n_all, rank AS old, CASE WHEN n_all <= 5 THEN score ELSE {SIM.format('q', 'doc')} * 0.5 + {SIM.format('q', "coalesce(name, '')")} * 0.5 END AS score FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n_all <= 5 THEN -old ELSE round(score, 9) END DESC, symbol_id) AS n FROM f)
SELECT query_id, symbol_id, match_type, is_exact, round(score, 6) AS score, n AS rank FROM r WHERE n <= 5
""",
)
def rerank_lexical(spark, sf):
    s, q = table(spark, sf, "symbols"), text_queries(spark, sf)
    return _ranked(search.rerank(q, search.hybrid(q, s, 50), s, 5))


@query(
    "dedup_best",
    """
WITH c AS (SELECT o_custkey AS query_id, o_orderkey % 7 AS symbol_id, o_totalprice / 1000 AS score, o_orderkey AS pos FROM orders),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id, symbol_id ORDER BY score DESC, pos DESC) AS r FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, symbol_id) AS rank FROM d WHERE r = 1)
SELECT query_id, symbol_id, round(score, 6) AS score, rank FROM o WHERE rank <= 3
""",
)
def dedup_best(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), (F.col("o_orderkey") % 7).alias("symbol_id"), F.lit("x").alias("match_type"), F.lit(False).alias("is_exact"), (F.col("o_totalprice") / 1000).alias("score"), F.col("o_orderkey").alias("pos"))
    return _ranked(search.merge([o], 3)).drop("match_type", "is_exact")


# ---------------------------------------------------------------- tokenised index

_BM25 = f"""
WITH {_TQ}, toks AS (SELECT id AS symbol_id, list_transform(regexp_extract_all(coalesce(name, '') || ' ' || coalesce(content, ''), '([A-Za-z0-9_]+)', 1), lambda w: lower(w)) AS t FROM symbols),
coll AS (SELECT count(*) AS n, avg(len(t)) AS m FROM toks), post AS (SELECT term, symbol_id, n_tokens, count(*) AS tf FROM (SELECT symbol_id, len(t) AS n_tokens, unnest(t) AS term FROM toks) GROUP BY ALL),
q AS (SELECT DISTINCT query_id, unnest(list_transform(regexp_extract_all(text, '([A-Za-z0-9_]+)', 1), lambda w: lower(w))) AS term FROM text_queries),
w AS (SELECT query_id, count(*) AS wanted FROM q GROUP BY 1), df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
s AS (SELECT q.query_id, p.symbol_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_tokens / m))), 6) AS score, count(*) AS terms
  FROM q JOIN post p USING (term) JOIN df USING (term), coll GROUP BY 1, 2),
r AS (SELECT s.query_id, symbol_id, score, row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, symbol_id) AS pos FROM s JOIN w ON s.query_id = w.query_id WHERE {{0}})
SELECT query_id, symbol_id, round(score, 4) AS score FROM r WHERE pos <= 10
"""


_STORED: dict[tuple, fts.StoredIndex] = {}


def stored_index(spark, sf):
    """The full-text index of a folder's symbols, built at its first use in a session and again when the files change."""
    s = table(spark, sf, "symbols")
    files = s.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    key = (spark.sparkContext.applicationId, *sorted(map(tuple, files.collect())))
    if key not in _STORED:
        whole = F.concat(F.coalesce("name", F.lit("")), F.lit(" "), F.coalesce("content", F.lit("")))
        _STORED[key] = fts.StoredIndex(spark, shared_folder(spark, "postings")).add(s, "id", whole)
    return _STORED[key]


def _rounded(c, n):
    """A positive double to ``n`` decimals as SQL rounds it: halves are those of the product, where Spark's ``round`` takes those of the decimal digits."""
    p = c * F.lit(10.0**n)
    return (F.floor(p) + F.when(p - F.floor(p) >= 0.5, 1).otherwise(0)) / F.lit(10.0**n)


def _bm25(spark, sf, every):
    found = stored_index(spark, sf).search(text_queries(spark, sf), 10, every)
    return found.select("query_id", "symbol_id", _rounded(F.col("score"), 4).alias("score"))


@query("fts_bm25", _BM25.format("true"))
def fts_bm25(spark, sf):
    return _bm25(spark, sf, False)


@query("fts_match", _BM25.format("terms = wanted"))
def fts_match(spark, sf):
    return _bm25(spark, sf, True)


# ---------------------------------------------------------------- quality and lookups by kind

@query(
    "retrieval_quality",
    f"""
WITH f AS (SELECT query_id, symbol_id, pos FROM ({SQL['fuzzy_name']})),
r AS (SELECT f.*, coalesce(len(list_filter([substr(lower(q.name), 1, 3), right(lower(q.name), 3)], lambda p: contains(lower(s.name), p))) > 0, false) AS relevant FROM f JOIN symbols q ON q.id = f.query_id JOIN symbols s ON s.id = f.symbol_id),
p AS (SELECT query_id, sum(relevant::INT) AS rel, count(*) AS n, min(CASE WHEN relevant THEN pos END) AS first FROM r GROUP BY 1)
SELECT 'fuzzy' AS mode, count(*) AS queries, round(sum(rel)::DOUBLE / sum(n), 6) AS precision, round(avg((rel > 0)::INT::DOUBLE), 6) AS hit_rate, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM p
""",
)
def retrieval_quality(spark, sf):
    """Precision, hit rate and rank of fuzzy lookups, by patterns of the first and last letters of the name looked up."""
    s = table(spark, sf, "symbols")
    got = search.fuzzy(part_queries(spark, sf), s, 10).select("query_id", "symbol_id", "pos")
    asked = s.select(F.col("id").alias("query_id"), F.col("name").alias("asked"))
    names = s.select(F.col("id").alias("symbol_id"), "name")
    patterns = F.array(F.concat(F.lit("*"), F.substring("asked", 1, 3), F.lit("*")), F.concat(F.lit("*"), F.right("asked", F.lit(3)), F.lit("*")))
    told = got.join(asked, "query_id").join(names, "symbol_id").select(F.lit("fuzzy").alias("mode"), "query_id", "pos", text.name_matches(F.col("name"), patterns).alias("relevant"))
    return analytics.ir_metrics(told, 10)


@query("chunks_by_type", "SELECT id, name FROM symbols WHERE lower(type) = 'function'")
def chunks_by_type(spark, sf):
    return search.chunks_by_type(table(spark, sf, "symbols"), "Function").select("id", "name")


@query("embeddings_of", "SELECT chunk_id, len(embedding) AS n FROM vec_embeddings WHERE vec_id % 50 = 0")
def embeddings_of(spark, sf):
    v = table(spark, sf, "vec_embeddings")
    return search.embeddings_of(v, v.where("vec_id % 50 = 0").select("chunk_id")).select("chunk_id", F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("long").alias("n"))


@query("platform_sets", "SELECT id, array_to_string(list_filter(['Windows', 'Android', 'iOS', 'macOS', 'Linux'], lambda p: list_contains(list_transform(string_split(coalesce(platforms, ''), ','), lambda x: lower(trim(x))), lower(p))), ',') AS platforms FROM symbols")
def platform_sets(spark, sf):
    return table(spark, sf, "symbols").select("id", F.array_join(text.platform_set(F.col("platforms")), ",").alias("platforms"))


@query("chunk_json", "SELECT id, 'chunk_' || id AS chunk_id, coalesce(name, '') AS name, CASE WHEN lower(type) IN ('class', 'interface', 'record', 'procedure', 'function', 'constructor', 'destructor', 'property', 'type', 'const', 'var') THEN lower(type) ELSE 'unknown' END AS type, CAST(coalesce(start_line, 0) AS BIGINT) AS start_line FROM symbols")
def chunk_json(spark, sf):
    """Chunks' metadata as JSON, read back."""
    c = F.col
    j = table(spark, sf, "symbols").select("id", text.chunk_json(c("id"), c("name"), c("full_name"), c("type"), c("file_path"), c("parent_class"), c("visibility"), c("start_line"), c("end_line")).alias("j"))
    return j.select("id", F.from_json("j", "chunk_id string, name string, type string, start_line long").alias("o")).select("id", "o.*")

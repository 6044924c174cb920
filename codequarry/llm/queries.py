"""Queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm import contamination, handwritten, markup, mixing, neighbours, pairs, repetition, splitting
from codequarry.operators.vectors import knn
from codequarry.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@query("p8_found")
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return contamination.contamination(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id").distinct()


#: The share that p10_found asks for.
REPEATED = 0.30


@query(
    "p10_found",
    r"""
WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\p{L}+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) > 5),
g AS (SELECT doc_id, i, min(i) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 4], ' ')) AS first FROM i),
m AS (SELECT doc_id, count(DISTINCT i + o) AS c FROM g, (SELECT unnest(range(0, 5)) AS o) WHERE i > first GROUP BY 1)
SELECT t.doc_id FROM t JOIN m ON t.doc_id = m.doc_id WHERE c::DOUBLE / len(w) >= 0.3
""",
)
def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    shares = repetition.repetition(table(spark, sf, "documents"), "doc_id", "text", [F.col("lang"), F.col("source")])
    # the cutoff at which each group reaches the share leaves few texts for the exact check
    return repetition.flag_repetitive(shares, target=REPEATED).where("repetitive").where(F.col("share") >= REPEATED).select("doc_id")


@query("p5_found")
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.function_pairs(table(spark, sf, "symbols")).select("id", "func_name")


@query("p6_found", "SELECT id FROM symbols WHERE length(content) > 4000")
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf, "symbols")).where("piece = 0").select("id")


@query("p6_pieces")
def p6_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf, "symbols"))


@query("p6_whole", "SELECT id, md5(content) AS h, true AS within FROM symbols WHERE length(content) > 4000")
def p6_whole(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of each row put together again, and whether all keep to the limit, the overlap and growing line ranges."""
    p = splitting.split_oversized(table(spark, sf, "symbols"))
    fits = (F.length("content") <= splitting.LIMIT) & (F.col("overlap") <= splitting.OVERLAP) & (F.col("start_line") <= F.col("end_line"))
    row = F.struct("piece", F.expr("substring(content, overlap + 1)").alias("t"))
    whole = p.groupBy("id").agg(F.array_sort(F.collect_list(row)).alias("r"), F.min(fits).alias("within"))  # one row's own pieces
    return whole.select("id", F.md5(F.array_join(F.col("r.t"), "").cast("binary")).alias("h"), "within")


@query("p3_plain", r"SELECT id, md5(content) AS h FROM symbols WHERE NOT coalesce(regexp_matches(lower(file_path), '\.(pas|inc|js)$'), false) AND regexp_full_match(content, '[A-Za-z ,.;:()\r\n]*')")
def p3_plain(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that hold none of the signs of any markup, which must come out as they are."""
    s = table(spark, sf, "symbols").where(F.col("content").rlike(r"^[A-Za-z ,.;:()\r\n]*\z")).select(F.col("id").alias("s_id"))
    return markup.clean(table(spark, sf, "symbols")).where("n_pieces = 0").join(s, F.col("id") == F.col("s_id"), "left_semi").select("id", F.md5(F.col("text").cast("binary")).alias("h"))


@query("p3_found")
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return markup.clean(table(spark, sf, "symbols")).where("n_pieces > 0").select("id")


@query("p3_clean")
def p3_clean(spark: SparkSession, sf: str) -> DataFrame:
    return markup.clean(table(spark, sf, "symbols")).select("id", "n_pieces", "text")


@query("p2_found")
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, sf, "symbols"), table(spark, sf, "indexed_folders")).where("not_handwritten").select("file_path")


@query(
    "p1_found",
    """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM vec_embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS sim FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS n FROM s WHERE sim >= 0.9)
SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM r WHERE n <= 10
""",
)
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    near = neighbours.similar(table(spark, sf, "vec_embeddings"), k=10, least=0.90, recall=0.999)
    return near.select(F.least("src", "dst").alias("vec_a"), F.greatest("src", "dst").alias("vec_b")).distinct()


def _asking(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf, "vec_embeddings")
    return v, v.where("vec_id % 50 = 0").select("vec_id")


@query("p1_top10")
def p1_top10(spark: SparkSession, sf: str) -> DataFrame:
    """The ten most similar of each vector whose id is divisible by 50, whatever their similarity."""
    v, q = _asking(spark, sf)
    return neighbours.similar(v, k=10, queries=q)


_FINE = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"


@query("p1_recall", f"SELECT count(*) AS n_queries, true AS reached FROM vec_embeddings WHERE vec_id % 50 = 0 AND {_FINE}")
def p1_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Whether ``p1_top10`` holds nine in ten of the neighbours that an exact search in blocks gives."""
    v, q = _asking(spark, sf)
    near = neighbours.similar(v, k=10, queries=q).select("src", F.round(1 - F.col("similarity"), 6).alias("d"))
    rows = v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    # one more than ten, as each vector is its own nearest
    true = knn(rows.where("id % 50 = 0").withColumnRenamed("id", "query_id"), rows, 11).where("symbol_id <> query_id")
    last = true.where("pos <= 11").groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list("distance")), 1, 10).alias("ds"))
    got = last.join(near, F.col("query_id") == F.col("src"), "left").groupBy("query_id", "ds").agg(F.count(F.when(F.col("d") <= F.element_at("ds", -1) + 1e-6, 1)).alias("hits"))
    return got.agg(F.count("*").alias("n_queries"), (F.sum("hits") >= 0.9 * F.sum(F.size("ds"))).alias("reached"))


@query("p9_mix")
def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_plan"))


@query("p9_shares")
def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    plan = table(spark, sf, "mix_plan")
    mixed, outcomes = mixing.mix_and_outcomes(table(spark, sf, "documents"), plan)
    return mixing.shares(mixed, plan, outcomes)


@query("p9_kept", "SELECT DISTINCT mix_id, coalesce(replace(replace(lower(trim(source)), '-', '_'), ' ', '_'), '') AS source, true AS caps_kept, true AS tokens_reached, true AS solved FROM mix_plan")
def p9_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Whether no text is used too often, and every source has its tokens, within a hundredth and one text, or all it may give."""
    plan = table(spark, sf, "mix_plan")
    mixed, outcomes = mixing.mix_and_outcomes(table(spark, sf, "documents"), plan)
    caps = plan.groupBy("mix_id", mixing.clean_source(F.col("source")).alias("source")).agg(F.max("max_repeats").alias("cap"))
    longest = mixed.groupBy("mix_id", "source").agg(F.max("n_tokens").alias("longest"), F.min("copies").alias("fewest"))
    told = mixing.shares(mixed, plan, outcomes).join(caps, ["mix_id", "source"]).join(longest, ["mix_id", "source"], "left")
    slack = 0.01 + F.coalesce(F.col("longest") * F.col("reached") / F.nullif(F.col("n_tokens"), F.lit(0)), F.lit(0.0))
    full = F.when(F.col("outcome") == "cap_reached", F.col("fewest") == F.col("cap")).when(F.col("outcome") == "no_texts", F.col("n_tokens") == 0).otherwise(F.coalesce(F.abs(F.col("reached") - 1) <= slack, F.lit(True)))
    return told.select("mix_id", "source", (F.col("most_copies") <= F.col("cap")).alias("caps_kept"), full.alias("tokens_reached"), (F.col("outcome") != "unsolved").alias("solved"))


@query("p5_pairs")
def p5_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.function_pairs(table(spark, sf, "symbols"))


@query("p8_spans")
def p8_spans(spark: SparkSession, sf: str) -> DataFrame:
    return contamination.contamination(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


_LABEL = "coalesce(replace(lower(trim({0})), '-', '_'), '')"


@query("p10_groups", f"SELECT {_LABEL.format('lang')} AS lang, {_LABEL.format('source')} AS source, count(*) AS n_texts, true AS close FROM documents GROUP BY ALL")
def p10_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each group's cutoff from its sketch is its 95 % quantile, by exact ranks, within two parts in a hundred and one text."""
    shares = repetition.repetition(table(spark, sf, "documents"), "doc_id", "text", [F.col("lang"), F.col("source")])
    flagged = repetition.flag_repetitive(shares, least=1)
    below, upto = (F.avg((c).cast("double")) for c in (F.col("share") < F.col("cutoff"), F.col("share") <= F.col("cutoff")))
    n = flagged.groupBy(repetition.clean_label("lang").alias("lang"), repetition.clean_label("source").alias("source")).agg(F.count("*").alias("n_texts"), below.alias("below"), upto.alias("upto"))
    slack = 0.02 + 1 / F.col("n_texts")
    return n.select("lang", "source", "n_texts", ((F.col("below") - slack <= 0.95) & (F.col("upto") + slack >= 0.95)).alias("close"))


@query("p10_cutoffs")
def p10_cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    shares = repetition.repetition(table(spark, sf, "documents"), "doc_id", "text", [F.col("lang"), F.col("source")])
    return repetition.flag_repetitive(shares).select("doc_id", "share", "cutoff", "repetitive")


@query("p8_verbatim", "SELECT doc_id, item_id FROM documents d JOIN eval_items i ON contains(d.text, i.text) WHERE len(regexp_extract_all(i.text, '[A-Za-z]+')) >= 40")
def p8_verbatim(spark: SparkSession, sf: str) -> DataFrame:
    """Of the leaks found, those of items that stand in the text letter by letter."""
    docs, items = table(spark, sf, "documents"), table(spark, sf, "eval_items")
    found = contamination.contamination(docs, items).select("doc_id", "item_id").distinct()
    long = items.where(F.size(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))) >= 40).select("item_id", F.col("text").alias("item"))
    return found.join(long, "item_id").join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "item")).select("doc_id", "item_id")


@query("p8_clean")
def p8_clean(spark: SparkSession, sf: str) -> DataFrame:
    return contamination.remove_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))

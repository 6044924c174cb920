"""Tokenised full-text index: postings, stored once and added to, and BM25."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.operators.search import blocks

K1, B = 1.2, 0.75
#: Postings that a task scores at once; documents are kept whole.
SCORED_ROWS = 500_000
#: Most query terms that are pushed down to the scan of the postings; more are joined.
PUSHED_TERMS = 1000


def tokens(c: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and underscores; NULL gives none."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([A-Za-z0-9_]+)"), F.lit(1)), F.lower)


def postings(docs: DataFrame, id_col: str, text: Column, terms: DataFrame | None = None) -> DataFrame:
    """(term, symbol_id, n_tokens, tf): one row per term and document; with ``terms`` (term) of those terms only. Texts are counted where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re
        from collections import Counter

        find = re.compile("[A-Za-z0-9_]+").findall
        schema = pa.schema([("term", pa.string()), ("symbol_id", pa.int64()), ("n_tokens", pa.int32()), ("tf", pa.int64())])
        for batch in batches:
            words, ids, sizes, counts = [], [], [], []
            for symbol, t in zip(batch.column("symbol_id").to_pylist(), batch.column("t").to_pylist()):
                found = find(t.lower()) if t and t.isascii() else [w.lower() for w in find(t or "")]
                c = Counter(found)
                words += c.keys()
                counts += c.values()
                ids += [symbol] * len(c)
                sizes += [len(found)] * len(c)
                if len(words) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((words, ids, sizes, counts), schema)], schema=schema)
                    words, ids, sizes, counts = [], [], [], []
            if words:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((words, ids, sizes, counts), schema)], schema=schema)

    each = docs.select(F.col(id_col).cast("long").alias("symbol_id"), text.alias("t")).mapInArrow(run, "term string, symbol_id long, n_tokens int, tf long")
    return each if terms is None else each.join(terms.select("term").distinct(), "term", "left_semi")


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select(F.explode(tokens(F.col("text"))).alias("term")).distinct()


def bm25(queries: DataFrame, index: DataFrame, n_docs: int, mean_tokens: float, n: int, every: bool = False) -> DataFrame:
    """(query_id, symbol_id, score, pos) of the best ``n``; ``every`` wants all terms of the query.

    Only the queries' terms are read from the index; scores are rounded to 6 decimals.
    """
    q = queries.select("query_id", F.array_join(F.array_sort(F.array_distinct(tokens(F.col("text")))), " ").alias("words")).where("words <> ''")
    scored = None
    for lists in blocks(q, "words"):
        got = _scores(index, lists, n_docs, mean_tokens, n, every)
        scored = got if scored is None else scored.unionByName(got)
    w = Window.partitionBy("words").orderBy(F.col("score").desc(), "symbol_id")
    top = scored.withColumn("score", F.round("score", 6)).withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)
    return q.join(top, "words").select("query_id", "symbol_id", "score", "pos")


def _scores(index: DataFrame, lists: list[str], n_docs: int, mean_tokens: float, n: int, every: bool) -> DataFrame:
    """(words, symbol_id, score): for each list of terms the best ``n`` documents of each task, not rounded.

    The postings of these terms are brought together by document, once for all lists; what lists and
    documents have in common is added up there.
    """
    spark = index.sparkSession
    words = sorted({w for x in lists for w in x.split(" ")})
    asked = F.broadcast(spark.createDataFrame(pa.table({"term": pa.array(words, pa.string()), "tid": pa.array(range(len(words)), pa.int32())})))
    used = index.join(asked, "term").select("tid", "symbol_id", "n_tokens", F.col("tf").cast("int").alias("tf"))
    sizes = used.groupBy("tid").agg(F.count("*").alias("df")).toArrow()  # one row a term of the block
    df = np.zeros(len(words))
    df[sizes.column("tid").to_numpy()] = sizes.column("df").to_numpy()
    shared = spark.sparkContext.broadcast((lists, words, np.log(1 + (n_docs - df + 0.5) / (df + 0.5))))
    rows_at_once = SCORED_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, words, idf = shared.value
        number = {w: i for i, w in enumerate(words)}
        terms = [[number[w] for w in x.split(" ")] for x in lists]
        of = [[] for _ in words]
        for i, ts in enumerate(terms):
            for t in ts:
                of[t].append(i)
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        edge = np.full(len(lists), -np.inf)  # no lower score is among the best

        def score(tid: np.ndarray, symbol: np.ndarray, n_tokens: np.ndarray, tf: np.ndarray) -> None:
            part = idf[tid] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n_tokens / mean_tokens))
            docs, at = np.unique(symbol, return_inverse=True)
            order = np.argsort(tid, kind="stable")
            tid, at, part = tid[order], at[order], part[order]
            here = np.unique(tid)
            starts = dict(zip(here.tolist(), zip(np.searchsorted(tid, here).tolist(), np.searchsorted(tid, here, "right").tolist())))
            for i in {i for t in starts for i in of[t]}:
                spans = [starts[t] for t in terms[i] if t in starts]
                if every and len(spans) < len(terms[i]):
                    continue
                if len(spans) == 1:
                    lo, hi = spans[0]
                    d, s = at[lo:hi], part[lo:hi]
                else:
                    d, where = np.unique(np.concatenate([at[lo:hi] for lo, hi in spans]), return_inverse=True)
                    s = np.bincount(where, np.concatenate([part[lo:hi] for lo, hi in spans]))
                    if every:
                        whole = np.bincount(where) == len(spans)
                        d, s = d[whole], s[whole]
                r = np.round(s, 6)
                if len(r) > n:
                    edge[i] = max(edge[i], np.partition(r, len(r) - n)[len(r) - n])
                fit = r >= edge[i]
                if fit.any():
                    d, s = docs[d[fit]], s[fit]
                    if i in best:
                        d, s = np.concatenate((best[i][0], d)), np.concatenate((best[i][1], s))
                    if len(d) > n:
                        first = np.lexsort((d, -np.round(s, 6)))[:n]
                        d, s = d[first], s[first]
                        edge[i] = max(edge[i], np.round(s[-1], 6))
                    best[i] = d, s

        kept: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            if b.num_rows:
                kept.append(tuple(b.column(c).to_numpy() for c in ("tid", "symbol_id", "n_tokens", "tf")))
            if sum(len(x[0]) for x in kept) >= rows_at_once:
                all_ = [np.concatenate(x) for x in zip(*kept)]
                end = int(np.searchsorted(all_[1], all_[1][-1]))  # the last document may go on
                if end:
                    score(*(x[:end] for x in all_))
                kept = [tuple(x[end:] for x in all_)]
        if kept:
            score(*(np.concatenate(x) for x in zip(*kept)))
        for i, (d, s) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([lists[i]] * len(d), pa.string()), pa.array(d), pa.array(s)], ["words", "symbol_id", "score"])

    return used.repartition("symbol_id").sortWithinPartitions("symbol_id").mapInArrow(run, "words string, symbol_id long, score double")


def collection(docs: DataFrame, text: Column) -> tuple[int, float]:
    """Number of documents and mean tokens."""
    r = docs.select(F.size(tokens(text)).alias("n")).agg(F.count("*").alias("c"), F.avg("n").alias("m")).first()
    return r["c"], float(r["m"] or 1.0)


class StoredIndex:
    """Postings below ``root``, one folder a batch of documents; files are sorted by term, so that a scan skips what no query asks.

    A document belongs to one batch; ids that come again are the caller's mistake. NULL and empty
    texts count as documents without tokens.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def add(self, docs: DataFrame, id_col: str, text: Column, batch: int = 0) -> StoredIndex:
        """Tokenises a batch once; adding the same batch again replaces it."""
        postings(docs, id_col, text).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{self.root}/postings/batch={batch}")
        docs.agg(F.count("*").alias("n_docs")).write.mode("overwrite").parquet(f"{self.root}/docs/batch={batch}")
        return self

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/postings").drop("batch")

    def collection(self) -> tuple[int, float]:
        n = self.spark.read.parquet(f"{self.root}/docs").agg(F.sum("n_docs")).first()[0] or 0
        total = self.postings().agg(F.sum("tf")).first()[0] or 0
        return n, total / n if total else 1.0

    def search(self, queries: DataFrame, n: int, every: bool = False) -> DataFrame:
        terms = query_terms(queries)
        some = [r["term"] for r in terms.limit(PUSHED_TERMS + 1).collect()]
        all_postings = self.postings()
        used = all_postings.where(F.col("term").isin(some)) if len(some) <= PUSHED_TERMS else all_postings
        n_docs, mean = self.collection()
        return bm25(queries, used, n_docs, mean, n, every)

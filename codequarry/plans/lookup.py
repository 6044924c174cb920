"""One lookup from request to text: cache, search, log, format."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import text
from codequarry.operators import search, vectors
from codequarry.operators.embed import embed_column
from codequarry.plans.store import IndexStore

# Lines shown of comments and code.
COMMENT_LINES, CODE_LINES = 10, 20


@dataclass(frozen=True)
class SearchRequest:
    """A request; numbers are held to their ranges by ``checked``."""

    query: str
    n: int = 5
    filters: search.Filters = search.Filters()
    preferred: str | None = None
    semantic: bool = False
    max_distance: float = 1.5
    reranked: bool = False
    candidates: int = 50

    def checked(self) -> SearchRequest:
        q = self.query.strip()
        if not text.LEAST_QUERY <= len(q) <= text.MOST_QUERY:
            raise ValueError(f"a query has {text.LEAST_QUERY} to {text.MOST_QUERY} characters")
        return SearchRequest(q, min(max(self.n, 1), 100), self.filters, self.preferred, self.semantic, min(max(self.max_distance, 0.1), 10.0), self.reranked, min(max(self.candidates, 10), 200))

    def hash(self) -> str:
        """Over everything that affects the result."""
        f = self.filters
        parts = (self.query, f.content_type, f.source_category, f.domain_tag, f.kind, f.framework, self.preferred, self.semantic, self.reranked, self.n, self.max_distance, self.candidates)
        return hashlib.md5("|".join("" if p is None else str(p) for p in parts).encode()).hexdigest()


#: Seconds for which the vector of a query is kept.
VECTOR_SECONDS = 3600


class Lookup:
    """Lookups over one store. ``embed`` turns (text) rows into vectors, ``scorer`` reranks; either may be a service that fails.

    Without vectors a lookup goes on with its other stages, without a scorer it keeps its ranking;
    what went wrong is in ``warnings`` of the last run.
    """

    def __init__(self, spark: SparkSession, store: IndexStore, dim: int = 64, embed: Callable[[DataFrame, str, int], DataFrame] = embed_column, scorer: Callable = search.lexical_score):
        self.spark, self.store, self.dim, self.embed, self.scorer = spark, store, dim, embed, scorer
        self.warnings: list[str] = []
        self._vectors: dict[str, tuple[float, list[float]]] = {}

    def vector(self, q: str) -> list[float]:
        """The query's vector, asked for once an hour."""
        at, v = self._vectors.get(q, (0.0, []))
        if time.time() - at > VECTOR_SECONDS:
            v = list(self.embed(self.spark.createDataFrame([(q,)], "text string"), "text", self.dim).first()["vec"])
            if len(v) != self.dim:
                raise ValueError(f"the vector has {len(v)} numbers, the index {self.dim}")
            self._vectors[q] = (time.time(), v)
        return v

    def plan(self, r: SearchRequest) -> DataFrame:
        """The ranked results as a plan: (query_id, symbol_id, match_type, is_exact, score, rank)."""
        symbols = self.store.read("symbols").withColumn("domain_tags", F.array_join("domain_tags", ","))
        q = self.spark.createDataFrame([(1, r.query)], "query_id long, text string")
        n = r.candidates if r.reranked else r.n
        near, vec = None, None
        self.warnings = []
        if r.semantic:
            try:
                vec = self.vector(r.query)
            except Exception as e:  # a service that fails takes no result away
                self.warnings.append(f"no vectors: {e}")
        if vec is not None:
            # filters narrow the vectors too; twice the results, as both sides lose some in the merge
            kept = search.filtered(symbols, r.filters).select(F.col("id").alias("_s"))
            v = self.store.read("vec_embeddings").join(kept, F.col("symbol_id") == F.col("_s"), "left_semi").select(F.col("symbol_id").alias("id"), F.col("embedding").alias("vec"))
            near = vectors.as_stage(vectors.knn(self.spark.createDataFrame([(1, vec)], "query_id long, vec array<double>"), v, 4 * n, dim=self.dim, max_distance=r.max_distance))
        got = search.hybrid(q, symbols, n, r.filters, near, r.preferred)
        if not r.reranked:
            return got
        try:
            return search.rerank(q, got, symbols, r.n, self.scorer)
        except Exception as e:
            self.warnings.append(f"not reranked: {e}")
            return got.where(F.col("rank") <= r.n)

    def cached(self, key: str) -> list[Row] | None:
        """The symbols of a valid cache entry, or None; an entry with a lost or changed symbol doesn't count. No results are a hit too."""
        e = self.store.read("query_cache").where((F.col("query_hash") == key) & F.col("cache_valid")).select("result_count", F.posexplode_outer("result_ids").alias("pos", "r"))
        s = self.store.read("symbols")
        rows = e.join(s, F.col("r.id") == F.col("id"), "left").orderBy("pos").limit(201).collect()
        if not rows:
            return None
        if len(rows) == 1 and rows[0]["r"] is None:
            return [] if rows[0]["result_count"] == 0 else None
        if any(x["id"] is None or (x["r"]["hash"] and x["r"]["hash"] != x["content_hash"]) for x in rows):
            return None
        return rows

    def run(self, request: SearchRequest) -> list[Row]:
        """At most 200 rows of symbols with match type, score and rank; logs the run and keeps it in the cache."""
        r = request.checked()
        began, key = time.time(), r.hash()
        got = self.cached(key)
        hit = got is not None
        if not hit:
            ranked = self.plan(r)
            got = ranked.join(self.store.read("symbols"), F.col("symbol_id") == F.col("id")).orderBy("rank").limit(200).collect()
        self._log(r, key, got, int((time.time() - began) * 1000), hit)
        return got

    def _log(self, r: SearchRequest, key: str, rows: list[Row], ms: int, hit: bool) -> None:
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        ids = [(x["id"], x["content_hash"]) for x in rows]
        exact = any("is_exact" in x.asDict() and x["is_exact"] for x in rows)
        log = self.spark.createDataFrame([(int(time.time() * 1e6), now, r.query, key, ids, True, r.n, r.max_distance, r.semantic, r.reranked, r.candidates, ms, len(rows), exact, hit)], "id bigint, executed_at timestamp, query_text string, query_hash string, result_ids array<struct<id:bigint,hash:string>>, cache_valid boolean, num_results_requested int, max_distance double, use_semantic_search boolean, use_reranker boolean, candidate_count int, duration_ms bigint, result_count int, exact_match_found boolean, cache_hit boolean")
        self.store.append("query_log", log)
        old = self.store.read("query_cache")
        mine = old.where(F.col("query_hash") == key).limit(1).collect()
        m = mine[0].asDict() if mine else {"hit_count": 0, "avg_duration_ms": 0, "first_seen": now}
        hits = m["hit_count"] or 0
        row = self.spark.createDataFrame([(key, r.query, ids, len(rows), True, hits + 1, m["first_seen"], now, ((m["avg_duration_ms"] or 0) * hits + ms) // (hits + 1))], old.schema)
        self.store.replace("query_cache", row.select(F.col("query_hash").alias("file_key")), row, "query_hash")


def format_results(rows: DataFrame) -> DataFrame:
    """(id, shown): header, place, classification, inheritance, relevance, some lines of comments and code."""
    c = F.col
    line = lambda label, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(label + ": "), v))
    head = text.symbol_line(c("type"), c("full_name"), c("name"), c("visibility"))
    inherits = text.inheritance_line(c("parent_class"), c("implemented_interfaces"))
    shown = F.concat_ws(
        "\n",
        F.concat(head, F.when(inherits != "", F.concat(F.lit(" "), inherits)).otherwise("")),
        line("File", F.concat_ws(":", c("file_path"), c("start_line").cast("string"))),
        line("Class", F.concat_ws(", ", text.category_label(c("source_category")), c("framework"))),
        F.concat(F.lit("Relevance: "), F.format_string("%.2f", c("score")), F.lit(" ("), c("match_type"), F.lit(")")),
        text.first_lines(text.nullif_blank(c("comments")), COMMENT_LINES),
        text.first_lines(text.clean_whitespace(c("content")), CODE_LINES),
        F.lit("-" * 40),
    )
    return rows.select("id", shown.alias("shown"))


def revalidate(cache: DataFrame, symbols: DataFrame, log: DataFrame, days: int = 30) -> DataFrame:
    """The cache with ``cache_valid`` checked against today's symbols; entries not seen for ``days`` go."""
    e = cache.where(F.col("last_seen") >= F.current_timestamp() - F.make_interval(days=F.lit(days)))
    item = e.select("query_hash", "result_count", F.explode_outer("result_ids").alias("r"))
    s = symbols.select(F.col("id").alias("s_id"), F.col("content_hash").alias("s_hash"))
    fine = F.when(F.col("r").isNull(), F.col("result_count") == 0).otherwise(F.col("s_id").isNotNull() & (F.coalesce("r.hash", F.lit("")).isin("") | F.coalesce(F.col("r.hash") == F.col("s_hash"), F.lit(False))))
    ok = item.join(s, F.col("r.id") == F.col("s_id"), "left").groupBy("query_hash").agg(F.min(F.coalesce(fine, F.lit(False))).alias("ok"))
    return e.join(ok, "query_hash", "left").withColumn("cache_valid", F.coalesce("cache_valid", F.lit(False)) & F.coalesce("ok", F.lit(False))).drop("ok")

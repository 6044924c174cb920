import math
import random
from collections import Counter

from pyspark.sql import functions as F

from codequarry.operators import fts
from codequarry.queries import QUERIES
from codequarry.query_sets import search


def test_tasks_keep_the_best_documents_of_each_list(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(12)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for i in range(300)] + [(400, None), (401, "É W1_x w1")]
    asked = [" ".join(rng.sample(words, rng.randrange(1, 4))) for _ in range(30)] + ["none w1", "none", "", "W1 w1"]
    toks = {i: [] if t is None else [w for w in t.lower().replace("é", "").split()] for i, t in docs}
    n, mean = len(docs), sum(map(len, toks.values())) / len(docs)
    df = Counter(w for t in toks.values() for w in set(t))
    idf = lambda w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
    d = spark.createDataFrame(docs, "id long, t string").repartition(3)
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    index = fts.postings(d, "id", F.col("t"))
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan  # texts are counted where they are
    for rows in (fts.SCORED_ROWS, 50):
        monkeypatch.setattr(fts, "SCORED_ROWS", rows)
        for every in (False, True):
            want = set()
            for k, a in enumerate(asked):
                a = set(a.lower().split())
                hits = []
                for i, t in toks.items():
                    c = Counter(t)
                    both = a & c.keys()
                    if both and (not every or both == a):
                        hits.append((-round(sum(idf(w) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in both), 6), i))
                want |= {(k, i, p + 1) for p, (_, i) in enumerate(sorted(hits)[:6])}
            got = fts.bm25(q, index, n, mean, 6, every).collect()
            assert {(r["query_id"], r["symbol_id"], r["pos"]) for r in got} == want


def test_scores_are_rounded_as_sql_rounds_them(spark, monkeypatch):
    import duckdb

    scores = [32.61635, 20.27275, 12.31745, 1.00005, 0.0, 7.123449, *((k * 100 + 50) / 1e6 for k in range(2000))]

    class Found:
        def search(self, queries, n, every):
            return spark.createDataFrame([(k, k, s, 1) for k, s in enumerate(scores)], "query_id long, symbol_id long, score double, pos int")

    monkeypatch.setattr(search, "stored_index", lambda spark, sf: Found())
    monkeypatch.setattr(search, "text_queries", lambda spark, sf: None)
    want = [duckdb.execute("SELECT round(?::DOUBLE, 4)", [s]).fetchone()[0] for s in scores]
    got = QUERIES["fts_match"](spark, "").orderBy("query_id")
    assert got.dtypes == [("query_id", "bigint"), ("symbol_id", "bigint"), ("score", "double")]
    assert [r["score"] for r in got.collect()] == want

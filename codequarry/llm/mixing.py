"""Mixing sources to target shares of tokens.

Each text gets a rate, how often it should be used. Rates are the ones nearest to using each
text once, in relative entropy, that give every source its tokens and leave its mean length
as it is; they tilt exponentially with the length, and a cap bounds them. The dual of this is
convex and has two unknowns a source; Newton iterations solve it, each with sums that Spark
makes over a histogram of lengths. Rates are then rounded to copies by systematic rounding,
which keeps the sums of every group.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern of the public byte-level tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ITERATIONS, CLOSE = 40, 1e-6
#: Texts of one group of systematic rounding.
GROUP = 20_000


def clean_source(c: Column) -> Column:
    """Spellings of a source fall together: case, outer blanks, ``-`` for ``_``; NULL is ''."""
    return F.coalesce(F.translate(F.lower(F.trim(c)), "- ", "__"), F.lit(""))


def token_counts(docs: DataFrame, id_col: str, text_col: str, keep: list[Column] | tuple = (), tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, *keep, text_hash, n_tokens) of texts that aren't blank; the tokenizer is a public one, from a .tiktoken file."""
    with open(tokenizer, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    src = docs.where(F.col(f"`{text_col}`").isNotNull() & (F.trim(F.col(f"`{text_col}`")) != "")).select(F.col(f"`{id_col}`"), *keep, F.md5(F.col(f"`{text_col}`").cast("binary")).alias("text_hash"), F.col(f"`{text_col}`").alias("_text"))
    rest = [c for c in src.columns if c != "_text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "_text") + ", n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        coder = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(coder.encode_ordinary(t.as_py())) for t in b.column("_text")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(n, pa.int64())], [*rest, "n_tokens"])

    return src.mapInArrow(run, schema)


def texts(docs: DataFrame, tokenizer: str = TOKENIZER) -> tuple[DataFrame, int]:
    """Distinct texts (doc_id, source, n_tokens), each under its first id, and the tokens of all documents."""
    counted = cut(token_counts(docs, "doc_id", "text", [clean_source(F.col("source")).alias("source")], tokenizer))
    total = counted.agg(F.sum("n_tokens")).first()[0] or 0
    one = counted.groupBy("text_hash").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("t")).select("t.*")
    return cut(one), total


def rates(hist: DataFrame, plan: list[dict], total: int, outcomes: dict[tuple, str] | None = None) -> dict[tuple, tuple[float, float, float]]:
    """(a, b, mean) by (mix_id, source): the rate of a text of n tokens is min(cap, exp(a + b * n / mean)).

    ``outcomes``, if given, is filled with how each source fared: ``solved``, ``cap_reached`` (all
    its texts as often as allowed are too few), ``no_texts``, or ``unsolved`` after ITERATIONS.

    ``hist`` has source, n_tokens and count. A source whose cap can't reach its tokens gets its cap (a is infinite).
    The plan is a small table by nature, one row per mix and source.
    """
    spark = hist.sparkSession
    sums = {r["source"]: r for r in hist.groupBy("source").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("n_tokens")).alias("w")).where(F.col("source").isin([p["source"] for p in plan])).collect()}
    out, todo = {}, {}
    fared = {} if outcomes is None else outcomes
    for p in plan:
        key, s = (p["mix_id"], p["source"]), sums.get(p["source"])
        want = p["target_share"] * p["total_factor"] * total
        if s is None or not s["w"] or want <= 0:
            out[key] = (-math.inf, 0.0, 1.0)
            fared[key] = "no_texts" if want > 0 else "solved"
        elif want >= p["max_repeats"] * s["w"] * (1 - 1e-12):
            out[key] = (math.inf, 0.0, s["w"] / s["n"])
            fared[key] = "cap_reached"
        else:
            mean = s["w"] / s["n"]
            # constraints in units of the mean length: tokens, and texts
            todo[key] = {"cap": float(p["max_repeats"]), "mean": mean, "want": want / mean, "n": want / mean, "x": [0.0, 0.0]}
    for _ in range(ITERATIONS):
        open_ = {k: t for k, t in todo.items() if k not in out}
        if not open_:
            break
        rows = [(k[0], k[1], t["cap"], t["mean"], *t["x"]) for k, t in open_.items()]
        duals = spark.createDataFrame(rows, "mix_id int, d_source string, cap double, mean double, a double, b double")
        z = F.col("n_tokens") / F.col("mean")
        raw = F.exp(F.least(F.col("a") + F.col("b") * z, F.lit(60.0)))
        free = (raw < F.col("cap")).cast("double")
        r = F.least(raw, F.col("cap"))
        c = F.col("count")
        # the dual's value needs the tilted mass, and where the cap holds its linear continuation
        mass = c * F.when(raw < F.col("cap"), raw).otherwise(F.col("cap") * (1 + F.col("a") + F.col("b") * z - F.log("cap")))
        got = hist.join(F.broadcast(duals), F.col("source") == F.col("d_source")).groupBy("mix_id", "source").agg(F.sum(c * r).alias("s0"), F.sum(c * r * z).alias("s1"), F.sum(c * r * free).alias("h0"), F.sum(c * r * z * free).alias("h1"), F.sum(c * r * z * z * free).alias("h2"), F.sum(mass).alias("mass")).collect()
        for g in got:
            key = (g["mix_id"], g["source"])
            t = todo[key]
            e0, e1 = g["s0"] - t["n"], g["s1"] - t["want"]
            value = g["mass"] - t["x"][0] * t["n"] - t["x"][1] * t["want"]
            if "old" in t and value > t["old"] + 1e-9 * abs(t["old"]) + 1e-12 and t["step"] > 1e-4:  # not down: half the step
                t["step"] /= 2
                t["x"] = [o + t["step"] * d for o, d in zip(t["from"], t["way"])]
                continue
            if abs(e1) <= CLOSE * t["want"] and abs(e0) <= CLOSE * t["n"]:
                out[key] = (*t["x"], t["mean"])
                fared[key] = "solved"
                continue
            h0, h1, h2 = g["h0"] + 1e-9, g["h1"], g["h2"] + 1e-9
            det = h0 * h2 - h1 * h1
            if det <= 1e-12 * h0 * h2:  # all texts are of one length: only the tokens count
                way = [-e1 / max(h1, 1e-9), 0.0]
            else:
                way = [-(h2 * e0 - h1 * e1) / det, -(h0 * e1 - h1 * e0) / det]
            big = max(abs(way[0]), abs(way[1]))
            way = [w * min(1.0, 5.0 / big) if big else 0.0 for w in way]
            t.update(old=value, **{"from": t["x"]}, way=way, step=1.0, x=[o + d for o, d in zip(t["x"], way)])
    for key, t in todo.items():
        if key not in out:
            out[key] = (*t["x"], t["mean"])
            fared[key] = "unsolved"
    return out


def _goals(plan: DataFrame) -> DataFrame:
    return plan.where(F.col("mix_id").isNotNull()).groupBy("mix_id", clean_source(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"), F.max("total_factor").alias("total_factor"))


def mix(docs: DataFrame, plan: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(mix_id, doc_id, source, n_tokens, copies) of the texts each mix uses.

    A text that stands in several documents counts once, under its first id, and is used
    ``max_repeats`` times at most. NULL and blank texts are never used. Spellings of a source
    fall together. Plan rows that are repeated count once; sources without texts and shares of
    0 give no rows.
    """
    return mix_and_outcomes(docs, plan, tokenizer)[0]


def mix_and_outcomes(docs: DataFrame, plan: DataFrame, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """``mix``, and (mix_id, source, outcome, wanted_tokens) of each row of the plan, as ``rates`` tells them."""
    spark = docs.sparkSession
    rows = [r.asDict() for r in _goals(plan).where("target_share is not null and max_repeats is not null and total_factor is not null").collect()]
    one, total = texts(docs, tokenizer)
    hist = cut(one.groupBy("source", "n_tokens").agg(F.count("*").alias("count")))
    outcomes: dict[tuple, str] = {}
    got = rates(hist, rows, total, outcomes)
    told = spark.createDataFrame([(p["mix_id"], p["source"], outcomes[p["mix_id"], p["source"]], p["target_share"] * p["total_factor"] * total) for p in rows], "mix_id int, source string, outcome string, wanted_tokens double")
    caps = {(p["mix_id"], p["source"]): float(p["max_repeats"]) for p in rows}
    table = [(k[0], k[1], caps[k], min(a, 1e6), b, m) for k, (a, b, m) in got.items() if a > -math.inf]
    duals = spark.createDataFrame(table, "mix_id int, d_source string, cap double, a double, b double, mean double")
    used = one.join(F.broadcast(duals), F.col("source") == F.col("d_source"))
    used = used.withColumn("rate", F.least(F.exp(F.least(F.col("a") + F.col("b") * F.col("n_tokens") / F.col("mean"), F.lit(60.0))), F.col("cap")))
    sizes = hist.groupBy(F.col("source").alias("z_source")).agg(F.ceil(F.sum("count") / GROUP).cast("int").alias("groups"))
    used = used.join(sizes, F.col("source") == F.col("z_source")).withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.col("groups")))
    w = Window.partitionBy("mix_id", "source", "grp").orderBy("n_tokens", F.xxhash64("doc_id"), "doc_id")
    # each text takes the whole numbers that its piece of the running sum passes
    upto = F.sum("rate").over(w.rowsBetween(Window.unboundedPreceding, 0))
    shift = F.pmod(F.xxhash64("mix_id", "source", "grp"), F.lit(1000)) / 1000.0
    used = used.withColumn("upto", F.round(upto, 9)).withColumn("before", F.coalesce(F.lag("upto").over(w), F.lit(0.0)))
    copies = (F.floor(F.col("upto") + shift) - F.floor(F.col("before") + shift)).cast("int")
    used = used.withColumn("copies", F.least(copies, F.col("cap").cast("int"))).where("copies > 0")
    return used.select("mix_id", "doc_id", "source", "n_tokens", "copies"), told


def shares(mixed: DataFrame, plan: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """(mix_id, source, target_share, actual_share, n_texts, n_tokens, most_copies) of every row of the plan.

    With ``outcomes`` also ``outcome`` and ``reached``, the tokens used over those wanted: where all
    sources are solved it is 1 throughout, and a source at its cap leaves the others' shares too high.
    """
    goal = _goals(plan).select("mix_id", "source", "target_share")
    sums = mixed.groupBy("mix_id", "source").agg(F.count("*").alias("n_texts"), F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"), F.max("copies").alias("most_copies"))
    whole = sums.groupBy("mix_id").agg(F.sum("n_tokens").alias("all_tokens"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = goal.join(sums, ["mix_id", "source"], "left").join(whole, "mix_id", "left").select("mix_id", "source", "target_share", F.coalesce(F.col("n_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"), zero("n_texts"), zero("n_tokens"), zero("most_copies"))
    if outcomes is None:
        return out
    return out.join(outcomes, ["mix_id", "source"], "left").withColumn("reached", F.col("n_tokens") / F.nullif(F.col("wanted_tokens"), F.lit(0.0))).drop("wanted_tokens")
